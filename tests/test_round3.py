"""Cases of the findings that were open after the second round."""

import pytest

from lorewell.operators import index as I
from lorewell.plans import QUERIES


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_of_a_block_exchange_nothing(spark, data):
    blocks = I.blocks(I.documents(spark, data)).unionByName(I.blocks(spark.createDataFrame([(-1, "b a b"), (-2, ""), (-3, None), (-4, "one")], "block_id long, text string")))
    blocks = spark.createDataFrame(blocks.toPandas().pipe(lambda d: d.assign(tokens=d["tokens"].map(list))), blocks.schema)
    made = I.block_postings(blocks)
    order = ["term", "block_id"]
    assert made.orderBy(*order).collect() == I.postings(blocks).select(*made.columns).orderBy(*order).collect() and made.count() > 1000
    assert "Exchange" not in executed(made)


def test_stored_index_holds_a_text_once(spark, tmp_path):
    docs = spark.createDataFrame([(0, "plain text"), (1, "# *marked* text"), (2, None)], "block_id long, text string")
    index = I.build(docs, markdown=True)
    I.save(index, str(tmp_path))
    columns = ["block_id", "text", "raw", "tokens", "len"]
    again = I.load(spark, str(tmp_path))
    assert again.blocks.select(*columns).orderBy("block_id").collect() == index.blocks.select(*columns).orderBy("block_id").collect()
    assert [r["raw"] for r in spark.read.parquet(f"{tmp_path}/blocks").orderBy("block_id").collect()] == [None, "# *marked* text", None]
    order = ["term", "block_id"]
    assert again.postings.orderBy(*order).collect() == index.postings.orderBy(*order).collect()


def test_holding_does_not_list_runs(spark):
    from lorewell.operators import evaluate as E

    texts = ["", None, "!?", "a b", "X one two three four Y and on", "one two three four", "xx one two three four yy", "z one two three four five six z", "one two three five six seven", "Ünder \U00010400 ÄRGER über alles hin", "a b a b a b a b a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "block_id long, text string")
    asked = ["", None, "!?", "b", "a b a b a b a b", "X one two three four Y", "x one two three four y", "e one two three four five", "two three four f", "ne two three four five s", "ne two three four five six z", "nder \U00010400 ÄRGER über alles hi", "Ünder \U00010400 ärger über alles hin"]
    items = spark.createDataFrame(list(enumerate(asked)), "query_id int, q string")
    found = E.holding(docs, items)
    want = {(i, j) for i, q in enumerate(asked) for j, t in enumerate(texts) if q is not None and t is not None and q in t}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sorted(map(tuple, E.holding(docs, items, sent=0).collect())) == sorted(want)
    assert "Generate" not in executed(found) and dict(found.dtypes) == {"query_id": "int", "block_id": "bigint"}
    assert E.holding(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["prf_terms", "service_search", "context_patch", "kns_boost"])
def test_texts_stay_where_they_are(spark, data, name):
    """However large they are: Spark isn't to guess that a side is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin [block_id" not in executed(QUERIES[name](spark, data))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_blocks_near_the_best(spark, data, monkeypatch):
    """More of them than are broadcast, as common terms have in a large corpus: texts stay where they are."""
    from lorewell import shared
    from lorewell.operators import retrieve as R

    rows = QUERIES["prf_rescore"](spark, data)
    want = sorted(map(tuple, rows.collect()))
    for module in (R, shared):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 40)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    read = []
    monkeypatch.setattr(R.scan, "scored", lambda blocks, *more, real=R.scan.scored: read.append(blocks) or real(blocks, *more))
    try:
        assert sorted(map(tuple, QUERIES["prf_rescore"](spark, data).collect())) == want
        assert len(read) == 4 and not any("SortMergeJoin [block_id" in b._jdf.queryExecution().executedPlan().toString() for b in read)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
