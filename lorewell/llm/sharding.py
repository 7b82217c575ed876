"""Operator 3: contiguous shards of least greatest size.

Groups that mustn't be split (by default each document) stand in the order of
their key. The smallest capacity with which ``SHARDS`` contiguous shards hold
all groups is found by binary search; a capacity is checked greedily, filling
each shard as far as it goes, by one search in the prefix sums per shard. Shards
are cut by that greedy filling with the capacity found, so none is larger and
none of them could be avoided at that capacity.

Sizes (bytes of UTF-8) are summed per group, ranged by key and stored in blocks
of ``BLOCK`` groups in the shared folder. The driver holds the totals of the
partitions, those of the blocks within the partitions in which a cut can fall, and the
sizes within the blocks in which one can: the capacity lies between an even share and
that plus the largest group, so the k-th cut lies within a few times k largest
groups, however many groups there are. A cut that falls elsewhere fetches its block.
Only the first keys of the shards go back to the executors.

Cases: null and empty texts have size 0 and belong to the shard before them;
rows that repeat a key are one group; a null key is the first group; a group
larger than all others sets the capacity alone; with fewer groups than shards
the last shards stay empty; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpointed, pick, table

SHARDS = 64
BLOCK = 1024

SCHEMA = "doc_id long, n_bytes long, shard long"


class Ends:
    """Prefix sums of all groups, of which only some blocks are at hand.

    ``totals`` are the sums of the partitions; ``opened`` returns the sums of the
    blocks of partitions, by partition; ``fetch`` returns (keys, sizes) of blocks, by
    (partition, block).
    """

    def __init__(self, totals: np.ndarray, opened, fetch):
        self.ends = np.cumsum(totals)
        self.starts = self.ends - totals
        self.total = int(self.ends[-1]) if len(totals) else 0
        self.opened, self.fetch, self.blocks, self.held = opened, fetch, {}, {}

    def open(self, parts) -> None:
        parts = [p for p in parts if p not in self.blocks]
        if parts:
            for p, sums in self.opened(parts).items():
                self.blocks[p] = self.starts[p] + np.cumsum(sums)

    def load(self, places) -> None:
        places = [at for at in places if at not in self.held]
        if places:
            for (p, n), (keys, sizes) in self.fetch(places).items():
                start = self.blocks[p][n - 1] if n else self.starts[p]
                self.held[p, n] = keys, int(start), start + np.cumsum(sizes)

    def near(self, ranges: list[tuple[int, int]]) -> set[tuple[int, int]]:
        """Blocks in which a prefix sum within one of the ranges may end."""
        last = len(self.ends) - 1
        if last < 0:
            return set()
        span = lambda ends, low, high: range(int(np.searchsorted(ends, low, "left")), int(np.searchsorted(ends, high, "right")) + 1)
        parts = [(p, low, high) for low, high in ranges for p in span(self.ends, low, high) if p <= last]
        self.open(sorted({p for p, _, _ in parts}))
        return {(p, n) for p, low, high in parts for n in span(self.blocks[p], low, high) if n < len(self.blocks[p])}

    def block(self, most: int) -> tuple[int, int]:
        """The block with the first group whose prefix sum is above ``most``, which is below the total."""
        p = int(np.searchsorted(self.ends, most, "right"))
        self.open([p])
        at = p, int(np.searchsorted(self.blocks[p], most, "right"))
        self.load([at])
        return at

    def upto(self, most: int) -> int:
        """The largest prefix sum of at most ``most``."""
        if most >= self.total:
            return self.total
        _, start, ends = self.held[self.block(most)]
        at = int(np.searchsorted(ends, most, "right"))
        return int(ends[at - 1]) if at else start

    def key_after(self, cut: int):
        """The first key whose prefix sum is above ``cut``, which is below the total."""
        keys, _, ends = self.held[self.block(cut)]
        return keys[int(np.searchsorted(ends, cut, "right"))]


def cuts(ends: Ends, capacity: int, shards: int) -> list[int] | None:
    """Prefix sums at which greedy filling ends each shard; None if ``shards`` don't do."""
    found, base = [], 0
    while base < ends.total:
        if len(found) == shards:
            return None
        to = ends.upto(base + capacity)
        if to <= base:
            return None
        base = to
        found.append(base)
    return found


def smallest_capacity(ends: Ends, largest: int, shards: int) -> int:
    """``largest`` is the size of the largest group."""
    if not ends.total:
        return 0
    even = -(-ends.total // shards)
    low, high = max(largest, even), even + largest
    # A greedy shard below the last holds more than capacity - largest, at most capacity.
    if low > 2 * largest:
        ends.load(sorted(ends.near([(k * (low - largest), min(ends.total, k * high)) for k in range(1, shards + 1)])))
    while low < high:
        middle = (low + high) // 2
        if cuts(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def stored(sizes: DataFrame) -> DataFrame:
    """(part, seq, total, largest, keys, sizes) blocks of ``sizes(key, n)`` in the order of the key."""

    def block(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table):
            n = table["n"].to_numpy()
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (part, seq, int(n.sum()), int(n.max()))] + [pa.array([table["key"].to_pylist()], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64()))],
                names=["part", "seq", "total", "largest", "keys", "sizes"],
            )

        for b in batches:
            held.append(pa.RecordBatch.from_arrays(b.columns, names=["key", "n"]))
            while sum(x.num_rows for x in held) >= BLOCK:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, BLOCK))
                seq += 1
                held = table.slice(BLOCK).to_batches()
        if sum(x.num_rows for x in held):
            yield out(pa.Table.from_batches(held))

    ranged = sizes.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first())
    return checkpointed(ranged.mapInArrow(block, "part long, seq long, total long, largest long, keys array<long>, sizes array<long>"))


def shard(docs: DataFrame, shards: int = SHARDS, key: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: its size and shard. ``key`` is a long of ``doc_id``."""
    key = F.col("doc_id") if key is None else key
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    keyed = rows.select("doc_id", "n_bytes", key.cast("long").alias("key"))
    blocks = stored(keyed.groupBy("key").agg(F.sum("n_bytes").alias("n")))
    parts = blocks.groupBy("part").agg(F.sum("total").alias("total"), F.max("largest").alias("largest")).orderBy("part").collect()  # a row a partition
    number = {r["part"]: i for i, r in enumerate(parts)}

    def opened(wanted: list[int]) -> dict:
        found = blocks.where(F.col("part").isin([parts[p]["part"] for p in wanted])).select("part", "seq", "total").orderBy("part", "seq").collect()
        out: dict[int, list[int]] = {p: [] for p in wanted}
        for r in found:
            out[number[r["part"]]].append(r["total"])
        return {p: np.array(x, dtype=np.int64) for p, x in out.items()}

    def fetch(places: list[tuple[int, int]]) -> dict:
        wanted = docs.sparkSession.createDataFrame([(parts[p]["part"], n) for p, n in places], "part long, seq long")
        found = blocks.join(F.broadcast(wanted), ["part", "seq"], "left_semi").select("part", "seq", "keys", "sizes").collect()
        return {(number[r["part"]], r["seq"]): (r["keys"], np.array(r["sizes"], dtype=np.int64)) for r in found}

    ends = Ends(np.array([r["total"] for r in parts], dtype=np.int64), opened, fetch)
    found = cuts(ends, smallest_capacity(ends, max((r["largest"] for r in parts), default=0), shards), shards) or []
    bounds = np.array([ends.key_after(c) for c in found if c < ends.total], dtype=np.int64)  # first key of every shard but the first

    def assign(batches):
        for b in batches:
            at = np.searchsorted(bounds, b.column(2).fill_null(np.iinfo(np.int64).min).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int64))], names=["doc_id", "n_bytes", "shard"])

    return keyed.mapInArrow(assign, SCHEMA)


def op3_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE sizes AS (
  SELECT doc_id, sum(coalesce(strlen(text), 0))::BIGINT AS n FROM documents GROUP BY doc_id
), ends AS (
  SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id NULLS FIRST)::BIGINT AS e FROM sizes
), every AS (
  SELECT list(e ORDER BY e) AS p, max(e) AS total, greatest(max(n), (max(e) + 63) // 64) AS least, (max(e) + 63) // 64 + max(n) AS most FROM ends
), search(low, high, base, used) AS (
  SELECT least, most, 0::BIGINT, 0 FROM every
  UNION ALL
  SELECT CASE WHEN over THEN low + (high - low) // 2 + 1 ELSE low END, CASE WHEN fits THEN low + (high - low) // 2 ELSE high END,
    CASE WHEN fits OR over THEN 0 ELSE upto END, CASE WHEN fits OR over THEN 0 ELSE used + 1 END
  FROM (SELECT *, upto = total AS fits, upto < total AND used + 1 = 64 AS over FROM (
    SELECT s.*, total, list_max(list_filter(p, lambda x: x <= base + low + (high - low) // 2)) AS upto FROM search s, every e WHERE s.low < s.high))
), best AS (SELECT min(high) AS c FROM search WHERE low >= high),
cut(base) AS (
  SELECT 0::BIGINT UNION ALL SELECT list_max(list_filter(p, lambda x: x <= base + c)) FROM cut, every, best WHERE base < total
)
SELECT d.doc_id, coalesce(strlen(d.text), 0)::BIGINT AS n_bytes, (SELECT count(*) FROM cut WHERE base > 0 AND base < e.e) AS shard
FROM documents d JOIN ends e ON d.doc_id IS NOT DISTINCT FROM e.doc_id
"""

QUERIES = {"op3_minimax_sharding": op3_minimax_sharding}
ORACLES = {"op3_minimax_sharding": ORACLE}
