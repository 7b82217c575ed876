r"""Operator 8: best-fit-decreasing packing into bins of ``CAPACITY`` words.

A document of n words (runs of ``\S``) is cut into pieces of ``CAPACITY`` words
and a rest. Pieces go, longest first, into the open bin with the least room that
is enough, or a new one; equal room means the lowest bin number. This is best-fit
decreasing over the whole corpus, not over parts of it: how bins fill depends on
lengths alone, so the driver packs the histogram of lengths (``CAPACITY``
numbers, however large the corpus). A segment tree over remaining capacities
finds the tightest room in logarithmic time, for a run of equal pieces at once,
and bins that were filled alike are one range. Executors then number the pieces
of each length and look up their run.

Pieces are ranged by (length, id, piece), so that a length that most pieces have is
spread over as many tasks as it needs, and stored with their places; the rank within
a length is the place, less where the length begins in the partition, plus what the
partitions before hold of it. The driver and each task hold one row for every length
and partition that meet.

Sizes are words by default; ``size`` names a column of other sizes, such as the
token counts of operator 9, and ``start_word`` and ``n_words`` then count those.

Cases: null and empty texts and texts without words take no room: one row with
``n_words`` 0 and null bin; long texts are cut, never dropped; rows that repeat a
``doc_id`` are packed one by one; null ids come first among pieces of their
length; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpointed, pick, table

CAPACITY = 2048

SCHEMA = "doc_id long, piece long, start_word long, n_words long, bin_id long, bin_offset long"


class Rooms:
    """Segment tree over 0..capacity: which amounts of room have an open bin."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)

    def set(self, room: int, on: bool) -> None:
        at = room + self.size
        self.tree[at] = on
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def tightest(self, need: int) -> int:
        """The least room of at least ``need``, or -1."""
        at = need + self.size
        if self.tree[at]:
            return need
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.tree[2 * at])
                return at - self.size
            at //= 2
        return -1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin, offset in it) that place all pieces, by length and rank."""
    rooms = Rooms(capacity)
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # room -> heap of (first bin, bins)
    bins = 0
    rows = []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            heapq.heappush(open_[room], (first, n))
            rooms.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = rooms.tightest(length)
            if room < 0:
                per = capacity // length
                room, first, n = capacity, bins, -(-left // per)
                bins += n
            else:
                first, n = heapq.heappop(open_[room])
                if not open_[room]:
                    rooms.set(room, False)
            per = room // length
            used = min(n, -(-left // per))
            placed = min(left, used * per)
            rows.append((length, rank, per, first, capacity - room))
            whole, rest = divmod(placed, per)
            put(room - per * length, first, whole)
            if rest:
                put(room - rest * length, first + whole, 1)
            put(room, first + used, n - used)
            rank += placed
            left -= placed
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, capacity: int = CAPACITY, size: str | None = None) -> DataFrame:
    """(doc_id, piece, start_word, n_words) of every document."""
    n = F.col(f"`{size}`") if size else F.regexp_count("text", F.lit(r"\S+"))
    counted = pick(docs, "doc_id", *([size] if size else ["text"])).select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("long")
    cut = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * capacity
    return cut.select("doc_id", "piece", start.alias("start_word"), F.least(F.lit(capacity).cast("long"), F.col("n") - start).alias("n_words"))


def pack(docs: DataFrame, capacity: int = CAPACITY, size: str | None = None) -> DataFrame:
    """One row per piece: its document, words, bin and offset in the bin."""
    order = [F.col("n_words").asc(), F.col("doc_id").asc_nulls_first(), F.col("piece").asc()]
    ranged = pieces(docs, capacity, size).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = checkpointed(ranged.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    met = cut.where("n_words > 0").groupBy("n_words", "part").agg(F.count("*").alias("n"), F.min("row").alias("first")).orderBy("n_words", "part").toArrow()
    length, part, n, first = (met[c].to_numpy().astype(np.int64) for c in ("n_words", "part", "n", "first"))
    sums = np.bincount(length, n, capacity + 1).astype(np.int64)
    histogram = {int(k): int(sums[k]) for k in np.flatnonzero(sums)}
    before = np.cumsum(n) - n  # pieces of lesser lengths and earlier partitions; less those of lesser lengths:
    offset = before - (np.cumsum(sums) - sums)[length]
    rows = plan(histogram, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast((rows, (length << 32) + part, offset - first))

    def place(batches):
        rows, places, shift = shared.value
        key = (rows[:, 0] << 48) + rows[:, 1]
        for b in batches:
            length, part, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4, 5))
            some = length > 0
            bin_id, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            if some.any():
                length, rank = length[some], rank[some] + shift[np.searchsorted(places, (length[some] << 32) + part[some])]
                run = rows[np.searchsorted(key, (length << 48) + rank, "right") - 1]
                bin_id[some], within = run[:, 3] + (rank - run[:, 1]) // run[:, 2], (rank - run[:, 1]) % run[:, 2]
                at[some] = run[:, 4] + within * length
            out = [pa.array(x, pa.int64(), mask=~some) for x in (bin_id, at)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), *out], names=["doc_id", "piece", "start_word", "n_words", "bin_id", "bin_offset"])

    return cut.select("doc_id", "piece", "start_word", "n_words", "part", "row").mapInArrow(place, SCHEMA)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


#: Piece by piece: the rooms of all bins are a list, which each step of the recursion changes.
ORACLE = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '\S+')), 0)::BIGINT AS n FROM documents
), pieces AS (
  SELECT doc_id, unnest(range(greatest((n + {CAPACITY - 1}) // {CAPACITY}, 1))) AS piece, n FROM words
), cut AS MATERIALIZED (
  SELECT doc_id, piece, piece * {CAPACITY} AS start_word, least({CAPACITY}, n - piece * {CAPACITY}) AS n_words FROM pieces
), ordered AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY n_words DESC, doc_id NULLS FIRST, piece) AS i FROM cut WHERE n_words > 0
), packed(i, rooms, bin, room) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT j, CASE WHEN best.r IS NULL THEN list_append(rooms, {CAPACITY} - n_words) ELSE rooms[:best.b - 1] || [best.r - n_words] || rooms[best.b + 1:] END,
    coalesce(best.b - 1, len(rooms)), coalesce(best.r, {CAPACITY})
  FROM (SELECT p.rooms, o.i AS j, o.n_words, list_min(list_filter(list_transform(rooms, lambda r, b: {{'r': r, 'b': b}}), lambda x: x.r >= o.n_words)) AS best FROM packed p JOIN ordered o ON o.i = p.i + 1) o
)
SELECT doc_id, piece, start_word, n_words, bin AS bin_id, {CAPACITY} - room AS bin_offset FROM ordered JOIN packed USING (i)
UNION ALL SELECT doc_id, piece, start_word, n_words, NULL, NULL FROM cut WHERE n_words <= 0
"""

QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLES = {"op8_best_fit_packing": ORACLE}
