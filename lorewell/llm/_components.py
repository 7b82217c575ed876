"""Connected components of an edge table, with Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of ``edges`` and the smallest node it is connected to.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until no edge
    changes; each round is written to the shared folder, which cuts the lineage
    and outlives executors. The driver holds two numbers a round.
    """
    links = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v > u").distinct()
    links = checkpointed(links)
    state = None
    while True:
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v > u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select("v", "u", "m")
        small = small.where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u"))).distinct()
        links = checkpointed(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = links.select("u").distinct().join(links.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
    return links.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
