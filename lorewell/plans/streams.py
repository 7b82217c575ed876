"""Streaming queries, drained to the end, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..streaming import ingest, replay
from . import knowledge, sql


def _folder(spark: SparkSession) -> str:
    """A new folder in the place that the cluster shares."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_memory_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory log written as files, replayed as a stream in several batches."""
    folder = _folder(spark)
    ops = knowledge.memory_ops(spark, sf_dir)
    ops.repartition(6).write.parquet(f"{folder}/ops")
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/ops")
    replay.run_once(spark, stream, f"{folder}/out", f"{folder}/checkpoint")
    last = replay.latest(spark.read.parquet(f"{folder}/out"))
    return last.select("id", "kind", "text", F.array_join("labels", "|").alias("labels"), "ts", "actor", F.array_join("links", "|").alias("links"))


def stream_file_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arriving as files; the index over all batches counts as one built at once."""
    folder = _folder(spark)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("block_id"), "text", F.col("lang").alias("namespace"))
    d.repartition(4).write.parquet(f"{folder}/docs")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/docs")
    ingest.ingest(spark, stream, f"{folder}/index", f"{folder}/checkpoint").awaitTermination()
    index = ingest.load(spark, f"{folder}/index")
    return index.lexicon.select("term", "df").withColumn("blocks", F.lit(index.n).cast("long"))


QUERIES = {"stream_memory_replay": stream_memory_replay, "stream_file_ingest": stream_file_ingest}
ORACLES = {
    "stream_memory_replay": f"WITH {knowledge._MEM} SELECT id, kind, text, array_to_string(labels, '|') AS labels, ts, actor, coalesce(links, '') AS links FROM m",
    "stream_file_ingest": f"WITH {sql.TOK}, {sql.POST} SELECT term, count(*) AS df, (SELECT count(*) FROM tok) AS blocks FROM post GROUP BY term",
}
