"""Cases of the second round of findings."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.plans import ORACLES, QUERIES

from .oracle import same

SHARED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages", "benchmark", "labels", "conversations")


def folder_with(spark, data, path, docs):
    """The tables of ``data`` with ``docs(doc_id, text, lang, source)`` as documents."""
    for t in SHARED:
        (path / f"{t}.parquet").symlink_to(f"{data}/{t}.parquet")
    docs.coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["kns_signature", "fnv_ids"])
def test_empty_and_missing_texts(spark, data, tmp_path, name):
    rows = [(1, "", "en", "src1"), (2, None, "en", "src1"), (3, "", "en", "src1"), (4, "!?", "en", "src1"), (5, "a b", "en", "src1"), (6, None, "en", "src1")]
    same(QUERIES[name](spark, folder_with(spark, data, tmp_path, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))), ORACLES[name], str(tmp_path))


@pytest.mark.parametrize("name", ["graph_edges", "graph_index", "graph_cap"])
def test_labels_of_one_id(spark, data, tmp_path, name):
    """yiijsv and ktodoe have the same 32-bit hash, and so have the claims about them."""
    rows = [(1, "[yiijsv](x) and [ktodoe](x).", "en", "src1"), (2, "[urswmb](y) and [ktodoe](y).", "en", "src1")]
    assert same(QUERIES[name](spark, folder_with(spark, data, tmp_path, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))), ORACLES[name], str(tmp_path))


def test_jaccard_of_texts(spark):
    texts = ["", "abc", "abcd", "abcde", "the cat sat on the mat", "the cat sat on a mat", "\U00010400 the cat", "".join(map(chr, range(0x4E00, 0x7000)))]
    rows = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(rows, "a string, b string").select(T.text_jaccard(F.col("a"), F.col("b")).alias("x"), T.jaccard(T.ngrams(F.col("a")), T.ngrams(F.col("b"))).alias("y"))
    assert all(r["x"] == r["y"] for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["tok_counts", "postings_terms", "graph_triples"])
def test_no_text_goes_through_python(spark, data, name):
    assert "Python" not in plan_of(QUERIES[name](spark, data))


def test_terms_of_every_character(spark):
    """As Python's decomposition has them; characters that its tables don't know may be newer ones of ICU."""
    known = [c for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co") and (c < 0x3400 or unicodedata.decomposition(chr(c)))]
    rows = [(f"A{chr(c)}b {chr(c)}\u0301\u0323 -{chr(c)}",) for c in known] + [(None,), ("",), (" a-b -- c",)]
    bare = F.udf(lambda t: t and "".join(x for x in unicodedata.normalize("NFKD", t)), "string")
    df = spark.createDataFrame(rows, "t string").withColumn("d", F.regexp_replace(bare("t"), r"\p{M}", ""))
    want = F.filter(F.split(F.regexp_replace(F.lower("d"), r"[^\p{L}\p{N}\s-]", " "), r"\s+"), lambda x: x != "")
    assert df.where(~T.tokenize("t").eqNullSafe(want)).count() == 0


@pytest.mark.parametrize("live", [False, True])
def test_ids_are_met_before_texts_are_taken_apart(spark, data, live):
    from lorewell.operators import live as L
    from lorewell.plans import knowledge, retrieval

    index = L.live_index(*knowledge.overlay(spark, data)) if live else retrieval.index(spark, data)
    few = index.only(index.blocks.select("block_id").where("block_id % 100 = 3"))
    assert few.orderBy("block_id").collect() == index.blocks.where("block_id % 100 = 3").orderBy("block_id").collect() and few.count() > 0
    lines = plan_of(index.only(spark.createDataFrame([(3,)], "block_id long"))).split("\n")
    assert min(i for i, x in enumerate(lines) if "split(" in x) < min(i for i, x in enumerate(lines) if "LeftSemi" in x)


def test_hashes_of_many_texts(spark):
    texts = ["", "a", "yiijsv", "ktodoe", "\U00010400\U0002070e x", "long " * 300, "longer \U00010400" * 300] + [f"label {i} " * (i % 7) for i in range(100)]
    assert T.fnv32s(texts) == [T.plain_fnv32(t) for t in texts] and T.fnv32s([]) == []
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", T.fnv32(F.col("t")).alias("h")).collect()
    assert all(r["h"] == (None if r["t"] is None else f"{T.plain_fnv32(r['t']):08x}") for r in rows)


def test_graph_takes_texts_apart_once(spark, data):
    from lorewell.operators import graph as G
    from lorewell.plans import knowledge

    nodes, edges = G.build(knowledge.noted(spark, data))
    assert all("documents" not in plan_of(df) and "regexp" not in plan_of(df) for df in (nodes, edges))
