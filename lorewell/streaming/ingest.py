"""Incremental index over arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as I


def ingest(spark: SparkSession, docs: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Appends blocks and postings of each batch below ``path``; batches are applied in order, one at a time.

    A batch is written under its number and overwritten if it is tried again, so
    a restart after a failure counts nothing twice.
    """

    def write(df: DataFrame, batch: int) -> None:
        b = I.blocks(df)
        b.write.mode("overwrite").parquet(f"{path}/blocks/batch={batch}")
        saved = spark.read.parquet(f"{path}/blocks/batch={batch}")
        I.postings(saved).write.mode("overwrite").parquet(f"{path}/postings/batch={batch}")

    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def load(spark: SparkSession, path: str) -> I.Index:
    """The index over all batches so far; document frequencies are counted over all of them."""
    blocks, postings = spark.read.parquet(f"{path}/blocks").drop("batch"), spark.read.parquet(f"{path}/postings").drop("batch")
    row = blocks.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    return I.Index(blocks, postings, I.lexicon(postings), row["n"], row["avg"] or 1.0)
