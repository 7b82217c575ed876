"""The pipeline against its stages run by hand, on a small table, and each stage against what it must do."""

import __spark_entry__ as entry
import corpus_pipeline as C
from lorewell.llm import langid, packing, simhash, spans, toxicity

from . import cases
from .test_packing import brute as packed
from .test_simhash import brute_groups
from .test_spans import brute as cut


def test_stages():
    assert [n for n, _ in C.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    assert C.ORACLE_SQL is None or isinstance(C.ORACLE_SQL, str)


def test_run_against_plain_versions(spark, data):
    """Each stage's plain version in turn gives the rows of ``run``."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scorer = toxicity.corpus_scorer(spark, data)
    rows = {d: t for d, t in rows.items() if scorer(t)[3] < toxicity.THRESHOLD}
    model = langid.train(docs.where(docs.doc_id.isin(list(rows))))
    rows = {d: t for d, t in rows.items() if not model.predict(t)[5]}
    sigs = {d: s for d, s in zip(rows, simhash.signatures(list(rows.values()))) if s}
    root = brute_groups(sigs)
    rows = {d: t for d, t in rows.items() if root.get(d, d) == d}
    rows = cut({d: t for d, t in rows.items() if t})
    want = packed(sorted(rows.items()), packing.CAPACITY)
    out = C.run(spark, data).collect()
    got = {(r["doc_id"], r["piece"]): (r["bin_id"], r["bin_offset"]) for r in out if r["n_words"]}
    assert got == want
    assert {r["doc_id"] for r in out} == set(rows)


def test_stages_keep_columns_and_stand_all_cases(spark, data, tmp_path):
    df = cases.clashing(cases.docs(spark, cases.ROWS + [(30, "you pathetic idiot", "en", "a", 18)]))
    for number, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, df, data)
        if number < len(C.STAGES) - 1:
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{number}")
        df = spark.read.parquet(f"{tmp_path}/{number}")
    ids = {r["doc_id"] for r in df.collect()}
    assert {1, 7} <= ids and not {2, 3, 4, 5, 8, 30} & ids


def test_empty_table(spark, data, tmp_path):
    df = cases.docs(spark, [])
    for number, (_, stage) in enumerate(C.STAGES):
        stage(spark, df, data).write.parquet(f"{tmp_path}/{number}")
        df = spark.read.parquet(f"{tmp_path}/{number}")
    assert df.count() == 0


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


