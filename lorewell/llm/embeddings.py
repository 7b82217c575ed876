"""Operator 6: embeddings that have near-duplicates, at a cosine of ``COSINE`` or more.

``linked`` gives one row a vector: its class (the smallest id that links lead to) and
the number of vectors it is linked with. Equal vectors are joined once, as one with a
weight. ``near_pairs`` gives the pairs themselves.

On unit vectors that is a range join with radius r = sqrt(2 - 2 * COSINE), and
exact. Each vector belongs to the cell of its nearest pivot. A partner y of x in
another cell j is nearer to pivot j than to x's own pivot i, so the triangle
inequality bounds d(x, p_j) - d(x, p_i) by 2r; the vector space allows the
sharper form that x is within r of the plane between the two pivots,
(d(x, p_j)^2 - d(x, p_i)^2) / (2 d(p_i, p_j)) <= r. Vectors for which both hold
are replicated to cell j, in one direction only (from the higher cell to the
lower), so every pair meets in exactly one cell. Cells join independently; a
cell with more than ``BLOCK`` rows on a side is cut into blocks of own rows x
visiting rows, each a task's work, so no task grows with the data. Vectors are placed once and stored
with the list of their cells; copies are made from that.

Pivots are the ``vectors / CELL`` rows (at most ``PIVOTS``) with the smallest
hash of their id. Their number changes the cost, never the result.

In 64 dimensions the radius is about twice the spread of distances of unrelated
vectors, so on such data most vectors are near most borders and the work
approaches all pairs, at matrix-product speed.

The join runs once for each width found.

Cases: vectors that are null, empty, zero or that hold nulls or NaN have no
direction and no partners, are classes of their own, and vectors of different widths don't pair; equal vectors pair
with cosine 1; of rows that repeat a ``vec_id`` the smallest vector counts; rows
with a null id are left out; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpointed, pick, table
from ._components import components

COSINE = 0.95
CELL = 4096
PIVOTS = 1024
BLOCK = 16384

SCHEMA = "vec_a long, vec_b long, cosine double"


def unit(rows: pa.Array, width: int) -> np.ndarray:
    """(rows, width) float64 vectors of length 1."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, width) of the vectors that have a direction."""
    rows = pick(vectors, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    e = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)
    good = rows.where((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & (norm > 0) & (norm < float("inf")))
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("width", F.size("embedding"))


def near_pairs(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(vec_a, vec_b, cosine) of every pair, vec_a < vec_b, once."""
    rows = checkpointed(valid(vectors).withColumn("copies", F.lit(1).cast("long")))
    return _joined(rows, cosine, cell, block, pairs, SCHEMA)


def linked(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(vec_id, class_id, n_links) of every id. No pair leaves a task: links are counted, and only what connects is passed on."""
    rows = checkpointed(valid(vectors))
    one = checkpointed(rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).withColumn("width", F.size("embedding")))
    met = checkpointed(_joined(one, cosine, cell, block, degrees, "vec_id long, n long, root long"))
    roots = components(met.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    count = met.groupBy("vec_id").agg(F.sum("n").alias("n"))
    own = one.select("embedding", F.col("vec_id").alias("first"), "copies").join(count.withColumnRenamed("vec_id", "first"), "first", "left").join(roots.withColumnRenamed("node", "first"), "first", "left")
    found = rows.join(own, "embedding").select("vec_id", F.coalesce("root", "first").alias("class_id"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    ids = pick(vectors, "vec_id").where("vec_id is not null").distinct()
    return ids.join(found, "vec_id", "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def pairs(a: np.ndarray, b: np.ndarray, cosine: np.ndarray, weight: dict) -> pa.Table:
    return pa.table({"vec_a": np.minimum(a, b), "vec_b": np.maximum(a, b), "cosine": np.round(cosine, 4)})


def degrees(a: np.ndarray, b: np.ndarray, cosine: np.ndarray, weight: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """Of a task's pairs: each vector's links, weighted by copies, and the smallest id that they lead to."""
    ids, copies = weight
    both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    held = copies[np.searchsorted(ids, both)]
    n = np.bincount(x, held[y], len(both)) + np.bincount(y, held[x], len(both))
    label = np.arange(len(both))
    while len(x) and (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
    return pa.table({"vec_id": both, "n": n.astype(np.int64), "root": both[label]})


def _joined(rows: DataFrame, cosine: float, cell: int, block: int, out, schema: str) -> DataFrame:
    widths = rows.groupBy("width").count().where("count > 1").orderBy("width").collect()
    if not widths:
        return rows.sparkSession.createDataFrame([], schema)
    found = [_of_width(rows.where(F.col("width") == w["width"]).select("vec_id", "embedding", "copies"), w["width"], w["count"], cosine, cell, block, out, schema) for w in widths]
    return reduce(DataFrame.unionByName, found)


def _of_width(rows: DataFrame, width: int, n: int, cosine: float, cell: int, block: int, out, schema: str) -> DataFrame:
    """What ``out`` makes of the pairs of ``n`` valid vectors of one width."""
    spark = rows.sparkSession
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(PIVOTS, n // cell))).toArrow()
    pivots = unit(chosen["embedding"].combine_chunks(), width)
    radius = sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6  # for rounding; pairs are checked exactly
    between = np.sqrt(np.maximum(0, ((pivots[:, None] - pivots[None]) ** 2).sum(-1))) if len(pivots) <= 256 else np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    shared = spark.sparkContext.broadcast((pivots, between))  # of at most PIVOTS rows

    def place(batches):
        pivots, between = shared.value
        for b in batches:
            for begin in range(0, b.num_rows, 4096):
                part = b.slice(begin, 4096)
                x = unit(part.column(1), width)
                square = np.maximum(0, 2 - 2 * x @ pivots.T)
                home = square.argmin(axis=1)
                own = square[np.arange(len(x)), home][:, None]
                visits = (np.sqrt(square) - np.sqrt(own) <= 2 * radius) & (square - own <= 2 * radius * between[home] + 1e-9)
                visits &= np.arange(len(pivots)) < home[:, None]
                row, to = np.nonzero(visits)
                ends = np.concatenate(([0], np.cumsum(visits.sum(axis=1)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(to.astype(np.int32)))], names=["vec_id", "embedding", "copies", "home", "visits"])

    stored = checkpointed(rows.mapInArrow(place, "vec_id long, embedding array<float>, copies long, home int, visits array<int>"))
    cells = F.concat(F.array("home"), "visits")
    counts = stored.select("home", F.explode(cells).alias("cell")).groupBy("cell").agg(F.count_if(F.col("cell") == F.col("home")).alias("own"), F.count("*").alias("all"))
    # A task holds own rows of one part and rows (own and visiting) of one part.
    parts = [(r["cell"], max(1, -(-r["own"] // block)), max(1, -(-r["all"] // block))) for r in counts.collect()]  # a row a pivot
    sizes = F.broadcast(spark.createDataFrame(parts or [(0, 1, 1)], "cell int, own_parts int, all_parts int"))
    cut = stored.withColumn("cell", F.explode(cells)).drop("visits").withColumn("own", F.col("cell") == F.col("home")).join(sizes, "cell")
    a = F.pmod(F.xxhash64("vec_id"), F.col("own_parts")).cast("int")
    z = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("all_parts")).cast("int")
    columns = ["own", "vec_id", "embedding", "copies"]
    left = cut.where("own").select("cell", a.alias("a"), F.explode(F.sequence(F.lit(0), F.col("all_parts") - 1)).alias("z"), F.lit(True).alias("left"), *columns)
    right = cut.select("cell", F.explode(F.sequence(F.lit(0), F.col("own_parts") - 1)).alias("a"), z.alias("z"), F.lit(False).alias("left"), *columns)

    def join(key, data):
        side = data["left"].to_numpy()
        ids, own = data["vec_id"].to_numpy(), data["own"].to_numpy()
        x = unit(data["embedding"].combine_chunks(), width)
        order_l, order_r = np.flatnonzero(side), np.flatnonzero(~side)
        quick = x.astype(np.float32)
        known, first = np.unique(ids, return_index=True)
        weight = known, data["copies"].to_numpy()[first]
        found = []
        for i in range(0, len(order_l), 1024):
            l = order_l[i : i + 1024]
            for j in range(0, len(order_r), 4096):
                r = order_r[j : j + 4096]
                p, q = np.nonzero(quick[l] @ quick[r].T >= cosine - 1e-4)
                p, q = l[p], r[q]
                on = ~own[q] | (ids[p] < ids[q])  # own rows are on both sides
                p, q = p[on], q[on]
                for at in range(0, len(p), 65536):
                    u, v = p[at : at + 65536], q[at : at + 65536]
                    c = (x[u] * x[v]).sum(axis=1)
                    ok = c >= cosine
                    found.append(out(ids[u][ok], ids[v][ok], c[ok], weight))
        none = np.zeros(0, np.int64)
        return pa.concat_tables(found or [out(none, none, np.zeros(0), weight)])

    return left.unionByName(right).groupBy("cell", "a", "z").applyInArrow(join, schema)


def op6_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON pairs.a = reach.b)
SELECT a AS vec_id, min(b) AS class_id, (SELECT count(*) FROM pairs WHERE pairs.a = reach.a) AS n_links FROM reach GROUP BY a
"""

QUERIES = {"op6_embedding_near_dup": op6_embedding_near_dup}
ORACLES = {"op6_embedding_near_dup": ORACLE}
