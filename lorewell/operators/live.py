"""Mutable overlay over an immutable corpus: operations, merged view, one index over it.

Overlay operations are rows (seq, op, doc_id, text, heading, namespace) with op
``add``, ``update`` or ``remove``; ``seq`` is their order. Absent fields of an
update keep the value before it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import Options, Semantic
from ..shared import numbered
from . import graph as G
from . import index as I
from . import retrieve as R

FIELDS = ("text", "heading", "namespace")
OPS = "seq long, op string, doc_id string, text string, heading string, namespace string"


class UnknownDocument(ValueError):
    pass


def duplicates(docs: DataFrame) -> DataFrame:
    """Ids that more than one base document has."""
    return docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")


def unknown(base: DataFrame, ops: DataFrame) -> DataFrame:
    """Updates and removals of ids that don't exist when they are applied."""
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = base.select("doc_id", F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("op"))
    rows = known.unionByName(ops.select("doc_id", "seq", "op")).withColumn("prior", F.last("op", ignorenulls=True).over(before))
    return rows.where(F.col("op").isin("update", "remove") & (F.col("prior").isNull() | (F.col("prior") == "remove"))).select("seq", "op", "doc_id")


def merged(base: DataFrame, ops: DataFrame) -> DataFrame:
    """(doc_id, text, heading, namespace) after all operations. Documents without an id can't be changed and stay.

    Of each id only operations from its last ``add`` or ``remove`` on count; each
    field is its last value among them, so the state is one aggregation per id.
    """
    columns = ["doc_id", *FIELDS]
    rows = base.select(*[F.col(c) if c in base.columns else F.lit(None).cast("string").alias(c) for c in columns])
    start = rows.select(F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("op"), *columns)
    all_ = start.where("doc_id is not null").unionByName(ops.select("seq", "op", *columns))
    whole = all_.groupBy("doc_id").agg(F.max(F.when(F.col("op") != "update", F.col("seq"))).alias("from"))
    since = all_.join(whole, "doc_id").where(F.col("seq") >= F.col("from"))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in FIELDS]
    state = since.groupBy("doc_id").agg(*last, F.max_by("op", F.when(F.col("op") != "update", F.col("seq"))).alias("kind"))
    named = state.where("kind = 'add'").select(*columns)
    return named.unionByName(rows.where("doc_id is null"))


def placed(docs: DataFrame) -> DataFrame:
    """``block_id`` by id, documents without one after all others, by text, heading and namespace."""
    order = [F.col("doc_id").asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in FIELDS)]
    return numbered(docs, order, "block_id")


def live_index(base: DataFrame, ops: DataFrame) -> I.Index:
    """One index, and so one set of document frequencies, over the merged corpus."""
    return I.build(placed(merged(base, ops)))


class LiveError(ValueError):
    pass


@dataclass(frozen=True)
class Live:
    """A base corpus under an overlay of operations. Every change gives a new overlay; the old one stays as it was.

    ``base`` has doc_id, text and perhaps heading and namespace. The claim graph is
    kept where ``max_edges`` is given, ``graph`` says so, or else where the base has one.
    """

    base: DataFrame
    ops: DataFrame
    graph: bool = False
    max_edges: int = 500

    @classmethod
    def over(cls, base: DataFrame, docs: Iterable[dict] = (), graph: bool | None = None, max_edges: int | None = None, base_graph: bool = False) -> Live:
        """The overlay of a base, with ``docs`` added in their order. Fails if an id of the base is blank or occurs twice."""
        blank = base.where("doc_id is not null and trim(doc_id) = ''").limit(1).collect()
        if blank or duplicates(base).limit(1).collect():
            raise LiveError("ids of the base must be distinct and not blank")
        on = graph if graph is not None else max_edges is not None or base_graph
        live = cls(base, base.sparkSession.createDataFrame([], OPS), on, max_edges or 500)
        return live.add(*docs) if docs else live

    def applied(self, ops: DataFrame) -> Live:
        """After ``ops``, rows of ``OPS`` of which the order is ``seq``; fails if one changes an id that isn't there by then."""
        after = self.ops.unionByName(ops.select(*self.ops.columns))
        lost = unknown(self.base, after).limit(1).collect()
        if lost:
            raise LiveError(f"{lost[0]['op']}: unknown id {lost[0]['doc_id']!r}")
        return replace(self, ops=after)

    def _rows(self, op: str, docs: Iterable[dict], need_text: bool) -> Live:
        rows = []
        last = self.ops.agg(F.max("seq")).first()[0]
        for n, d in enumerate(docs, 0 if last is None else last + 1):
            doc_id = d.get("id") if isinstance(d, dict) else None
            if not isinstance(doc_id, str) or not doc_id.strip():
                raise LiveError("a live document needs an id")
            for name in FIELDS:
                if d.get(name) is not None and not isinstance(d[name], str):
                    raise LiveError(f"{name} of {doc_id!r} must be a string")
            if (need_text or d.get("text") is not None) and not (d.get("text") or "").strip():
                raise LiveError(f"text of {doc_id!r} must not be blank")
            rows.append((n, op, doc_id, *(d.get(name) for name in FIELDS)))
        return self.applied(self.base.sparkSession.createDataFrame(rows, OPS))

    def add(self, *docs: dict) -> Live:
        return self._rows("add", docs, True)

    def update(self, *docs: dict) -> Live:
        return self._rows("update", docs, False)

    def remove(self, *ids: str) -> Live:
        return self._rows("remove", ({"id": i} for i in ids), False)

    def docs(self) -> DataFrame:
        return merged(self.base, self.ops)

    def index(self) -> I.Index:
        return live_index(self.base, self.ops)

    def claims(self, index: I.Index) -> tuple[DataFrame, DataFrame] | None:
        """The graph of the merged corpus, built anew."""
        if not self.graph:
            return None
        return G.build(index.blocks.select(F.col("block_id").alias("doc_ord"), "doc_id", F.coalesce("heading", F.lit("")).alias("heading"), F.col("raw").alias("text")), self.max_edges)

    def query(self, queries: DataFrame, options: Options = Options(), index: I.Index | None = None) -> DataFrame:
        """The whole pipeline over the merged corpus, without vectors, which an overlay has none of."""
        if options.semantic != Semantic():
            raise LiveError("a live overlay takes no semantic options")
        index = index or self.index()
        return R.retrieve(index, queries, options, graph=self.claims(index) if options.graph.expand else None)

    def snapshot(self, path: str) -> None:
        """The merged corpus as a stored index, with its graph below ``graph`` if there is one."""
        index = self.index()
        I.save(index, path)
        graph = self.claims(index)
        for name, table in zip(("nodes", "edges"), graph or ()):
            table.write.mode("overwrite").parquet(f"{path}/graph/{name}")
