"""Operation logs as text: one JSON object a line, in the log's order, or one document ``{"version": 1, "ops": [...]}``.

Lines are for logs of any size: files are ranged by the order, so their names and
lines follow it. A document is one value, which the format wants so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import memory as M

MEMORY = "version int, op string, ts bigint, actor string, id string, memory struct<id:string,kind:string,text:string,labels:array<string>,namespace:string,source:string,importance:double,confidence:double>, labels array<string>, `from` string, `to` string, relation string, confidence double"
GRAPH = "version int, op string, ts bigint, actor string, id string, label string, props map<string,string>, `from` string, p string, `to` string, evidence array<bigint>, edgeId string"


class LogError(ValueError):
    pass


def memory_line(ops: DataFrame) -> Column:
    """The JSON of an operation; null fields are left out."""
    is_ = lambda op: F.col("op") == op
    memory = F.struct("id", "kind", "text", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), "namespace", "source", "importance", "confidence")
    return F.to_json(
        F.struct(
            "op", "ts", "actor",
            F.when(is_("forget") | is_("label"), F.col("id")).alias("id"),
            F.when(is_("remember"), memory).alias("memory"),
            F.when(is_("label"), F.col("labels")).alias("labels"),
            F.when(is_("link"), F.col("id")).alias("from"),
            F.when(is_("link"), F.col("to")).alias("to"),
            F.when(is_("link"), M.field("relation")).alias("relation"),
            F.when(is_("link"), M.ratio(F.col("confidence"))).alias("confidence"),
        )
    )


def memory_ops(rows: DataFrame) -> DataFrame:
    """Rows of ``memory.OPS`` from parsed operations."""
    pick = lambda name: F.coalesce(F.col(f"memory.{name}"), F.col(name)) if name in ("labels", "confidence") else F.col(f"memory.{name}")
    own = F.coalesce("memory.id", "id", "from").alias("id")
    fields = {n: pick(n).alias(n) for n in ("kind", "text", "labels", "namespace", "source", "importance", "confidence")}
    return rows.select("op", "ts", "actor", own, *fields.values(), "to", "relation")


def graph_line(ops: DataFrame) -> Column:
    return F.to_json(F.struct("op", "ts", "actor", "id", "label", "props", F.col("src").alias("from"), "p", F.col("dst").alias("to"), "evidence", F.col("edge_id").alias("edgeId")))


def graph_ops(rows: DataFrame) -> DataFrame:
    return rows.select("op", "id", "label", "props", F.col("from").alias("src"), "p", F.col("to").alias("dst"), "evidence", F.col("edgeId").alias("edge_id"), "ts", "actor")


def graph_order(ops: DataFrame) -> list[Column]:
    return [F.col("ts").asc(), F.col("actor").asc(), graph_line(ops).asc()]


KINDS = {"memory": (MEMORY, memory_line, memory_ops, M.ordered), "graph": (GRAPH, graph_line, graph_ops, graph_order)}


def lines(ops: DataFrame, kind: str) -> DataFrame:
    """(value) the operations as JSON, in order."""
    _, line, _, order = KINDS[kind]
    return ops.orderBy(*order(ops)).select(line(ops).alias("value"))


def write(ops: DataFrame, path: str, kind: str) -> None:
    lines(ops, kind).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Fails on a line that is no operation."""
    return parsed(spark.read.text(path), kind)


def parsed(rows: DataFrame, kind: str) -> DataFrame:
    schema, _, back, _ = KINDS[kind]
    found = rows.select(F.from_json("value", schema).alias("o"), "value")
    known = ("remember", "label", "link", "forget") if kind == "memory" else ("upsert_node", "add_edge", "tombstone_edge")
    bad = F.col("o.op").isNull() | ~F.col("o.op").isin(*known) | F.col("o.ts").isNull() | F.col("o.actor").isNull()
    op = F.when(bad, F.raise_error(F.concat(F.lit("not an operation: "), F.substring("value", 1, 80))).cast("string")).otherwise(F.col("o.op"))
    return back(found.select(op.alias("op"), *(f"o.`{f}`" for f in found.schema["o"].dataType.names if f not in ("op", "version"))))


def document(ops: DataFrame, kind: str) -> str:
    """The log as one text. It is held whole, as whoever asks for one text wants it."""
    return '{"version":1,"ops":[' + ",".join(r["value"] for r in lines(ops, kind).toLocalIterator()) + "]}"


def from_document(spark: SparkSession, text: str, kind: str) -> DataFrame:
    import json

    try:
        found = json.loads(text)
    except ValueError as e:
        raise LogError(f"log isn't JSON: {e}") from None
    if not isinstance(found, dict) or found.get("version") != 1 or not isinstance(found.get("ops"), list):
        raise LogError("a log needs version 1 and a list of ops")
    return parsed(spark.createDataFrame([(json.dumps(o),) for o in found["ops"]], "value string"), kind)
