"""The folder that all executors share, and results stored in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only where the setting is absent in a local session, as in tests, a folder of
    this machine is made and kept for the rest of the session. On a cluster each
    executor would write to a disk of its own, so there the setting is required.
    """
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lorewell-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder: later plans start from it, and it outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """``df`` with ``name``, the place of each row in ``order``, from ``first`` on.

    Rows are ranged by the order and stored before they are counted: a range
    exchange that is planned twice may cut differently. The driver holds two numbers
    a partition.
    """
    part, row, base, offset = (f"{name}__{x}" for x in ("part", "row", "base", "offset"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = checkpointed(ranged.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()))
    counts = stored.groupBy(part).agg(F.count("*").alias("n"), F.min(row).alias("base")).orderBy(part).collect()
    total, rows = first, []
    for r in counts:
        rows.append((r[part], r["base"], total))
        total += r["n"]
    where = df.sparkSession.createDataFrame(rows or [(0, 0, 0)], f"`{part}` int, `{base}` long, `{offset}` long")
    return stored.join(F.broadcast(where), part).withColumn(name, F.col(row) - F.col(base) + F.col(offset)).drop(part, row, base, offset)


#: Rows of a side that is broadcast; beyond, the join exchanges both.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows``, which the caller has counted or bounded, are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
