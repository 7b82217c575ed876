"""Precision, recall, MRR and nDCG at k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..shared import BROADCAST_ROWS, checkpointed
from .scan import _held

#: Characters of items that are sent to every task.
SENT = 16_000_000


def _words(x):
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def holding(docs: DataFrame, items: DataFrame, n: int = 4, sent: int = SENT) -> DataFrame:
    """(query_id, block_id) of the ``docs(block_id, text)`` that hold the text of an item ``items(query_id, q)``.

    A text that holds another holds its inner words whole, so both meet by a run of
    ``n`` words inside the item and are then compared as texts. Items with fewer
    inner words are compared with all documents. Up to ``sent`` characters of items
    go to the tasks that read the documents; more are joined by the hash of the run.
    """
    asked, size = [], 0
    for r in items.where("q is not null").select("query_id", "q", F.slice(_words("q"), 2, F.greatest(F.size(_words("q")) - 2, F.lit(0))).alias("w")).toLocalIterator():
        asked.append(r)
        size += len(r["q"])
        if size > sent or len(asked) > BROADCAST_ROWS:
            return _joined(docs, items, n)
    runs = [max((tuple(r["w"][i : i + n]) for i in range(len(r["w"]) - n + 1)), key=lambda w: (sum(map(len, w)), w), default=None) for r in asked]
    items_of: dict[tuple, list[int]] = {}
    for i, run in enumerate(runs):
        if run:
            items_of.setdefault(run, []).append(i)
    words = sorted({w for run in items_of for w in run})
    place = {w: i for i, w in enumerate(words)}
    wanted = list(items_of)
    # The words of a run one by one: steps[j] are the (beginning, word) pairs that some run goes on with.
    steps, known = [], np.array([place[run[0]] for run in wanted], np.int64)
    for j in range(1, n):
        whole = known * len(words) + np.array([place[run[j]] for run in wanted], np.int64)
        steps.append(np.unique(whole))
        known = np.searchsorted(steps[-1], whole)
    by_end = {int(k): items_of[run] for k, run in zip(known, wanted)}
    short = [i for i, run in enumerate(runs) if not run]
    texts, ids = [r["q"] for r in asked], [r["query_id"] for r in asked]
    id_type = to_arrow_type(items.schema["query_id"].dataType)

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(words, pa.string())
        for part in parts:
            text = part.column("text")
            rows, found = [], []
            row, code, pos = _held(part.column("w"), vocabulary)
            last = max(0, len(row) - n + 1)
            at = np.flatnonzero((row[n - 1 :] == row[:last]) & (pos[n - 1 :] == pos[:last] + n - 1)) if last else np.zeros(0, np.int64)
            key = code[at]
            for j, step in enumerate(steps, 1):
                whole = key * len(words) + code[at + j]
                to = np.minimum(np.searchsorted(step, whole), len(step) - 1)
                at, key = at[step[to] == whole], to[step[to] == whole]
            met = np.unique(np.stack([row[at], key]), axis=1)
            held, held_row = "", -1
            for r, k in zip(*met.tolist()):
                if r != held_row:
                    held, held_row = text[r].as_py(), r
                for i in by_end[k]:
                    if texts[i] in held:
                        rows.append(r)
                        found.append(i)
            for i in short:
                hit = np.flatnonzero(pc.fill_null(pc.match_substring(text, texts[i]), False).to_numpy(zero_copy_only=False))
                rows.extend(hit.tolist())
                found.extend([i] * len(hit))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in found], id_type), part.column("block_id").take(pa.array(rows))], ["query_id", "block_id"])

    kinds = {"query_id": items.schema["query_id"].dataType.simpleString(), "block_id": docs.schema["block_id"].dataType.simpleString()}
    return docs.select("block_id", "text", _words("text").alias("w")).mapInArrow(find, ", ".join(f"{k} {v}" for k, v in kinds.items())).distinct()


def _joined(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """``holding`` of any number of items."""


    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
    inner = items.select("query_id", "q", F.slice(_words("q"), 2, F.greatest(F.size(_words("q")) - 2, F.lit(0))).alias("w"))
    keyed = inner.where(F.size("w") >= n).select("query_id", "q", F.array_min(runs(F.col("w"))).alias("h"))
    held = docs.select("block_id", "text", _words("text").alias("w")).where(F.size("w") >= n).select("block_id", "text", F.explode(F.array_distinct(runs(F.col("w")))).alias("h"))
    met = held.join(keyed, "h").where(F.contains("text", F.col("q"))).select("query_id", "block_id")
    few = inner.where(F.size("w") < n).select("query_id", "q")
    rest = docs.join(few, F.contains("text", F.col("q"))).select("query_id", "block_id")
    return met.unionByName(rest).distinct()


def metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row: means over the queries that have a relevant block. ``hits(query_id, rank, block_id)``, ``relevant(query_id, block_id)``."""
    relevant = checkpointed(relevant.distinct())  # read twice
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    found = hits.where(F.col("rank") <= k).join(relevant, ["query_id", "block_id"])
    per = found.groupBy("query_id").agg(F.count("*").alias("h"), F.min("rank").alias("r"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("g"))
    all_ = total.join(per, "query_id", "left").na.fill({"h": 0, "g": 0.0})
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    mean = lambda x: F.round(F.avg(x), 6)
    return all_.agg(
        F.count("*").alias("queries"),
        mean(F.col("h") / float(k)).alias("precision"),
        mean(F.col("h") / F.col("n")).alias("recall"),
        mean(F.coalesce(1.0 / F.col("r"), F.lit(0.0))).alias("mrr"),
        mean(F.col("g") / ideal).alias("ndcg"),
    )
