import pytest

from lorewell.plans import ORACLES, QUERIES

from .oracle import same


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 50


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, data, name):
    same(QUERIES[name](spark, data), ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_numbers_at_any_partition_count(spark):
    """Term and block ids are dense and in order with many partitions that nothing coalesces."""
    from pyspark.sql import functions as F

    from lorewell.operators import index as I
    from lorewell.operators import live as L

    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 200_000
        rows = spark.range(n).select(F.col("id").alias("block_id"), F.array(F.concat(F.lit("t"), (F.col("id") % 150_000).cast("string")), F.lit("same")).alias("tokens"))
        ids = I.term_ids(rows).withColumn("k", F.expr("try_cast(substring(term, 2, 9) as long)"))
        # t0 is the first term of block 0, "same" the second, t1 the third
        wrong = ids.where("(term = 'same' and term_id <> 2) or (k = 0 and term_id <> 1) or (k > 0 and term_id <> k + 2)")
        assert ids.count() == 150_001 and wrong.count() == 0
        docs = spark.range(n).select(F.format_string("d%07d", F.when(F.col("id") % 4 > 0, F.col("id"))).alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit(None).cast("string").alias("heading"), F.lit("x").alias("namespace"))
        docs = docs.withColumn("doc_id", F.when(F.col("text").cast("long") % 4 > 0, F.col("doc_id")))
        placed = L.placed(docs)
        assert placed.agg(F.countDistinct("block_id"), F.min("block_id"), F.max("block_id")).first()[:] == (n, 0, n - 1)
        named = placed.where("doc_id is not null")
        assert named.agg(F.max("block_id")).first()[0] == n * 3 // 4 - 1
        assert named.where("block_id <> floor(cast(text as long) / 4) * 3 + cast(text as long) % 4 - 1").count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
