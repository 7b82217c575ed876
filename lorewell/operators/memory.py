"""Memory log: normalization, replay, recall, consolidation, claim operations.

Operations are rows (op, ts, actor, id, kind, text, labels, namespace, source,
importance, confidence, to, relation) with op ``remember``, ``label``, ``link`` or
``forget``. Replay is one aggregation per id: forgetting is final whenever it came,
the last remembering counts, labels and links add up from it on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field as field_, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

OPS = "op string, ts bigint, actor string, id string, kind string, text string, labels array<string>, namespace string, source string, importance double, confidence double, `to` string, relation string"
RANK = {"remember": 0, "label": 1, "link": 2, "forget": 3}


def field(x: Column | str) -> Column:
    """Kind, text, namespace and source as compared: normalized, white space collapsed."""
    return T.collapse(T.normalize(x))


INPUT = "kind string, text string, labels array<string>, namespace string, source string, importance double, confidence double, ts bigint, actor string"


class InvalidMemory(ValueError):
    pass


def memory_id(kind: Column, text: Column, ts: Column, actor: Column) -> Column:
    """Of normalized fields: the text counts by its words alone."""
    return F.concat(F.lit("mem_"), T.fnv64_column(F.concat_ws("\u0001", kind, field(text), ts.cast("string"), actor)))


def link_id(src: Column, relation: Column, to: Column, confidence: Column, ts: Column, actor: Column) -> Column:
    """A link is known by its ends, relation and confidence, and by who made it when."""
    text = F.concat_ws("\u0001", src, relation, to, F.coalesce(F.regexp_replace(confidence.cast("string"), r"\.0$", ""), F.lit("")))
    return memory_id(F.lit("link"), text, ts, actor)


def ratio(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def finite(x: Column, what: str) -> Column:
    """``ratio``, failing on what is no number."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"memory {what} must be a finite number")).cast("double")).otherwise(ratio(x))


def named(x: Column, what: str) -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", F.raise_error(F.lit(f"memory {what} must not be empty")).cast("string")).otherwise(x)


def actor_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalized(inputs: DataFrame, actor: str = "cortex", ts: int = 0) -> DataFrame:
    """Memories (id, kind, ..., ts, actor) of ``inputs`` in the columns of ``INPUT``, as ``remember`` rows hold them.

    Fails on a memory without kind or text and on ratios that are no numbers;
    ratios beyond 0 to 1 are clipped; absent columns and nulls take the defaults.
    """
    columns = [c.strip() for c in INPUT.split(",")]
    rows = inputs.select(*(F.col(n) if n in inputs.columns else F.lit(None).cast(t).alias(n) for n, t in (c.split(" ") for c in columns)))
    empty = lambda x: F.when(x != "", x)
    rows = rows.select(
        named(field("kind"), "kind").alias("kind"),
        named(F.regexp_replace("text", r"^\s+|\s+$", ""), "text").alias("text"),
        T.normalized_labels(F.coalesce("labels", F.array().cast("array<string>"))).alias("labels"),
        empty(T.memory_label(F.coalesce("namespace", F.lit("")))).alias("namespace"),
        empty(field(F.coalesce("source", F.lit("")))).alias("source"),
        finite(F.col("importance"), "importance").alias("importance"),
        finite(F.col("confidence"), "confidence").alias("confidence"),
        F.coalesce("ts", F.lit(ts).cast("long")).alias("ts"),
        actor_name(F.coalesce("actor", F.lit(actor))).alias("actor"),
    )
    return rows.select(memory_id(F.col("kind"), F.col("text"), F.col("ts"), F.col("actor")).alias("id"), "*")


def op_rows(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    names = [c.strip().split(" ")[0].strip("`") for c in OPS.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], OPS)


def remembered(memories: DataFrame) -> DataFrame:
    """``remember`` operations of normalized memories."""
    null = {"to": "string", "relation": "string"}
    names = [c.strip().split(" ")[0].strip("`") for c in OPS.split(",")]
    return memories.withColumn("op", F.lit("remember")).select(*(F.lit(None).cast(null[n]).alias(n) if n in null else F.col(n) for n in names))


def clock() -> int:
    return int(time.time() * 1000)


@dataclass(frozen=True)
class Cortex:
    """A memory log with its writer. Every write gives a new one."""

    log: DataFrame
    actor: str = "cortex"
    now: Callable[[], int] = field_(default=clock)

    @classmethod
    def create(cls, spark: SparkSession, actor: str = "cortex", now: Callable[[], int] = clock, log: DataFrame | None = None) -> Cortex:
        return cls(op_rows(spark, []) if log is None else log, " ".join(actor.split()), now)

    def _with(self, ops: DataFrame) -> Cortex:
        return replace(self, log=self.log.unionByName(ops))

    def _stamp(self, ts: int | None, actor: str | None) -> dict:
        ts = self.now() if ts is None else ts
        if isinstance(ts, bool) or not isinstance(ts, (int, float)) or ts != ts or abs(ts) == float("inf"):
            raise InvalidMemory("memory timestamp must be a finite number")
        return {"ts": int(ts), "actor": " ".join((self.actor if actor is None else actor).split())}

    def remember(self, inputs: DataFrame) -> tuple[Cortex, DataFrame]:
        """(after, the memories written), many at once."""
        memories = normalized(inputs, self.actor, self.now())
        return self._with(remembered(memories)), memories

    def forget(self, memory: str, ts: int | None = None, actor: str | None = None) -> Cortex:
        return self._with(op_rows(self.log.sparkSession, [{"op": "forget", "id": memory, **self._stamp(ts, actor)}]))

    def label(self, memory: str, labels: Iterable[str], ts: int | None = None, actor: str | None = None) -> tuple[Cortex, DataFrame]:
        """(after, the memory as it was before)."""
        labels = [labels] if isinstance(labels, str) else labels
        op = {"op": "label", "id": memory, "labels": sorted({p for x in labels if (p := T.plain_label(x))}), **self._stamp(ts, actor)}
        return self._with(op_rows(self.log.sparkSession, [op])), self.memories().where(F.col("id") == memory)

    def link(self, src: str, to: str, relation: str, confidence: float | None = None, ts: int | None = None, actor: str | None = None) -> Cortex:
        op = {"op": "link", "id": src, "to": to, "relation": T.plain_normalize(relation), "confidence": confidence, **self._stamp(ts, actor)}
        return self._with(op_rows(self.log.sparkSession, [op]))

    def memories(self) -> DataFrame:
        return replay(self.log)


def ordered(ops: DataFrame) -> list[Column]:
    """The total order of a log's operations."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("op")]
    rest = ("id", "kind", "text", "namespace", "source", "importance", "confidence", "to", "relation")
    return [F.col("ts").asc(), F.col("actor").asc(), rank.asc(), *(F.coalesce(F.col(c).cast("string"), F.lit("")).asc() for c in rest), F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ",").asc()]


def replay(ops: DataFrame) -> DataFrame:
    """(id, kind, text, labels, namespace, source, importance, confidence, ts, actor, links) of what is remembered.

    Labels must be normalized (``text.normalized_labels``). A later remembering of the
    same id replaces labels and links given before it, except where the earlier
    ones waited for the first.
    """
    order = F.struct("ts", "actor", F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("op")].alias("rank"))
    rows = ops.withColumn("at", order)
    said = rows.where("op = 'remember'").groupBy("id").agg(
        F.max_by(F.struct(*[c for c in ("kind", "text", "labels", "namespace", "source", "importance", "confidence", "ts", "actor")]), F.struct("at", "text")).alias("m"),
        F.min("at").alias("first"),
        F.max("at").alias("last"),
    )
    gone = rows.where("op = 'forget'").select("id").distinct()
    said = said.join(gone, "id", "left_anti")
    bounds = said.select("id", "first", "last")
    counts = (F.col("at") > F.col("last")) | ((F.col("first") == F.col("last")) & (F.col("at") < F.col("first")))
    extra = rows.where("op = 'label'").join(bounds, "id").where(counts).groupBy("id").agg(F.flatten(F.collect_list("labels")).alias("more"))
    links = rows.where("op = 'link'").join(bounds, "id").where(counts)
    links = links.select("id", "ts", "actor", "relation", "to", "confidence").distinct()  # what the id of a link is made of
    links = links.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ts", "actor", "relation", "to", "confidence"))).alias("links"))
    out = said.join(extra, "id", "left").join(links, "id", "left")
    none = F.array().cast("array<string>")
    all_labels = T.memory_labels(F.concat(F.coalesce("m.labels", none), F.coalesce("more", none)))
    return out.select("id", "m.kind", "m.text", all_labels.alias("labels"), "m.namespace", "m.source", "m.importance", "m.confidence", "m.ts", "m.actor", "links")


def passing(memories: DataFrame, kinds=(), labels=(), namespaces=(), sources=(), since=None, until=None, min_importance=None, min_confidence=None) -> DataFrame:
    """All filters at once; filters are given in normalized form."""
    out = memories
    if kinds:
        out = out.where(field("kind").isin(*kinds))
    if labels:
        out = out.where(F.exists("labels", lambda x: T.prefix_match(x, list(labels))))
    if namespaces:
        out = out.where(F.coalesce(T.prefix_match(T.memory_label("namespace"), list(namespaces)), F.lit(False)))
    if sources:
        out = out.where(field(F.coalesce("source", F.lit(""))).isin(*sources))
    if since is not None:
        out = out.where(F.col("ts") >= since)
    if until is not None:
        out = out.where(F.col("ts") <= until)
    if min_importance is not None:
        out = out.where(F.coalesce("importance", F.lit(0.5)) >= min_importance)
    if min_confidence is not None:
        out = out.where(F.coalesce("confidence", F.lit(0.5)) >= min_confidence)
    return out


def _under(label: str) -> Column:
    return F.exists("labels", lambda x: (x == label) | x.startswith(label + "."))


def recall(memories: DataFrame, query: str, top_k: int = 10, **filters) -> DataFrame:
    """The best memories for a query, or the latest that pass the filters if there is none; nothing without either."""
    top_k = top_k if isinstance(top_k, int) and top_k > 0 else 10
    rows = passing(memories, **filters).withColumn("__q", T.tokenize(F.lit(query)))
    given = {k: [*filters.get(k, ())] for k in ("kinds", "labels", "namespaces", "sources")}
    over = lambda x: T.overlap(F.col("__q"), T.tokenize(F.coalesce(x, F.lit(""))))
    one = F.lit(1.0)  # what passed a filter matches it
    matched = sum((_under(f).cast("double") for f in given["labels"]), F.lit(0.0)) / max(1, len(given["labels"]))
    scored = rows.select(
        *memories.columns,
        "__q",
        over(F.col("text")).alias("lexical_score"),
        (one if given["kinds"] else over(field("kind"))).alias("kind_score"),
        (matched if given["labels"] else over(F.array_join("labels", " "))).alias("label_score"),
        (one if given["namespaces"] else over(F.col("namespace"))).alias("namespace_score"),
        (one if given["sources"] else over(F.col("source"))).alias("source_score"),
    )
    meta = F.col("kind_score") * 0.2 + F.col("label_score") * 0.1 + F.col("namespace_score") * 0.15 + F.col("source_score") * 0.1
    scored = scored.withColumn("metadata_score", meta).withColumn("score", F.col("lexical_score") * 0.45 + F.col("metadata_score"))
    asked = F.size("__q") > 0
    scored = scored.where(~asked | (F.col("score") > 0))
    if not any(v is not None and v != () for v in filters.values()):
        scored = scored.where(asked)
    return scored.drop("__q").orderBy(F.desc(F.round("score", 9)), F.desc("ts"), "id").limit(top_k)


def consolidate(memories: DataFrame, now: int, prefix: str = "memory", min_age=None, max_age=None, **filters) -> DataFrame:
    """Memories as documents for a corpus, by time and id: (ts, doc_id, heading, namespace, text)."""
    rows = passing(memories, **filters)
    age = F.lit(now) - F.col("ts")
    if min_age is not None:
        rows = rows.where(age >= min_age)
    if max_age is not None:
        rows = rows.where(age <= max_age)
    return rows.select("ts", F.col("id").alias("doc_id"), F.concat(F.col("kind"), F.lit(": "), F.array_join("labels", "/")).alias("heading"), F.concat(F.lit((T.plain_label(prefix) or "memory") + "."), F.col("kind")).alias("namespace"), "text").orderBy("ts", "doc_id")


def claim_ops(memories: DataFrame) -> DataFrame:
    """Graph operations: a node per memory, label and link target; ``mentions`` and relation edges."""
    from .graph import node_id

    own = memories.select(T.claim_label(F.concat(F.lit("memory "), F.col("id"))).alias("own"), "labels", "links", "ts", "actor")
    tags = own.select("own", "ts", "actor", F.explode("labels").alias("l")).select("own", F.lit("mentions").alias("p"), T.claim_label("l").alias("other"), "ts", "actor")
    ties = own.select("own", F.explode("links").alias("l")).select("own", T.claim_label("l.relation").alias("p"), T.claim_label(F.concat(F.lit("memory "), F.col("l.to"))).alias("other"), "l.ts", "l.actor")
    edges = tags.unionByName(ties).where("own <> '' and p <> '' and other <> ''")
    edges = edges.groupBy("own", "p", "other").agg(F.min(F.struct("ts", "actor")).alias("s"))
    nodes = own.select("own", F.col("own").alias("label"), "ts", "actor").unionByName(tags.unionByName(ties).where("p <> '' and other <> ''").select("own", F.col("other").alias("label"), "ts", "actor"))
    nodes = nodes.where("label <> ''").groupBy("own", "label").agg(F.min(F.struct("ts", "actor")).alias("s"))
    null = lambda t: F.lit(None).cast(t)
    up = nodes.select(F.lit("upsert_node").alias("op"), node_id(F.col("label")).alias("id"), "label", null("string").alias("src"), null("string").alias("p"), null("string").alias("dst"), "s.ts", "s.actor")
    add = edges.select(F.lit("add_edge").alias("op"), null("string").alias("id"), null("string").alias("label"), node_id(F.col("own")).alias("src"), "p", node_id(F.col("other")).alias("dst"), "s.ts", "s.actor")
    return up.unionByName(add)
