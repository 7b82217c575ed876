"""Replay of the memory log as a stream.

State is kept per memory id and never expires, as forgetting is final and late
operations still count. Whatever the order and the batches in which operations
come, the last row of an id equals what the batch replay makes of all of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.memory import RANK

OUT = "id string, alive boolean, kind string, text string, labels array<string>, ts bigint, actor string, links array<string>"
STATE = "log string"


def folded(log: dict, ops: list[dict]) -> dict:
    """The state after more operations: the last remembering, the first one's place, labels, links, whether forgotten."""
    for o in ops:
        at = [o["ts"], o["actor"], RANK[o["op"]]]
        if o["op"] == "forget":
            log["gone"] = True
        elif o["op"] == "remember":
            said = [at, o["text"] or "", o["kind"], sorted(o["labels"] or [])]
            log["first"] = min(log.get("first", at), at)
            if "said" not in log or said[:2] > log["said"][:2]:
                log["said"] = said
        elif o["op"] == "label":
            log.setdefault("labels", []).append([at, sorted(o["labels"] or [])])
        else:
            log.setdefault("links", []).append([at, o["relation"], o["to"]])
    if log.get("gone"):
        return {"gone": True}
    return log


def seen(log: dict) -> tuple:
    """(alive, kind, text, labels, ts, actor, links) of a state."""
    if log.get("gone") or "said" not in log:
        return (False, None, None, [], None, None, [])
    last, text, kind, labels = log["said"]
    first = log["first"]
    counts = lambda at: at > last or (first == last and at < first)
    more = [x for at, ls in log.get("labels", []) if counts(at) for x in ls]
    links = {f"{r}>{to}" for at, r, to in log.get("links", []) if counts(at)}
    return (True, kind, text, sorted({*labels, *more}), last[0], last[1], sorted(links))


def _update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    log = json.loads(state.get[0]) if state.exists else {}
    for pdf in parts:
        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        for r in rows:
            r["ts"] = int(r["ts"])
            r["labels"] = list(r["labels"]) if r["labels"] is not None else []
        log = folded(log, rows)
    state.update((json.dumps(log),))
    yield pd.DataFrame([(key[0], *seen(log))], columns=[c.split()[0] for c in OUT.split(", ")])


def replayed(ops: DataFrame) -> DataFrame:
    """A streaming frame of the current memory of each id that a batch touched."""
    columns = ops.select("op", "ts", "actor", "id", "kind", "text", "labels", "to", "relation")
    return columns.groupBy("id").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_once(spark: SparkSession, ops: DataFrame, out: str, checkpoint: str) -> None:
    """Drains the stream: each batch's rows are appended with their number."""
    from pyspark.sql import functions as F

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)

    query = replayed(ops).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def latest(rows: DataFrame) -> DataFrame:
    """The last state of each id that is still remembered."""
    from pyspark.sql import functions as F

    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "batch")]), "batch").alias("v"))
    return last.select("id", "v.*").where("alive").drop("alive")
