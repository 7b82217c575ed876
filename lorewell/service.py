"""A search service over one stored index, and retriever adapters.

The service's state is the path and label of its index, kept in a small JSON file
that is written before the state changes, so that a restart finds what the last
call promised.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import index as I
from .operators import retrieve as R
from .options import LEXICAL, Options
from .shared import checkpointed, small
from .sources import pack

TOP_K = 50


def search(index: I.Index, queries: DataFrame, top_k: int) -> DataFrame:
    """(query_id, rank, block_id, score, text, source, namespace): lexical hits of a batch; ``top_k`` counts up to 50, 0 gives nothing, and so does a blank query."""
    if top_k <= 0:
        queries = queries.limit(0)
    asked = queries.where(F.trim(F.coalesce("q", F.lit(""))) != "")
    parsed = checkpointed(R.parsed(asked, LEXICAL, T.lite_tokenize))
    sums = R.sums(index, parsed, TOP_K).withColumn("score", F.round("score", 9))
    top = sums.withColumn("rank", F.row_number().over(R.per_query().orderBy(F.desc("score"), "block_id")).cast("long")).where(F.col("rank") <= min(max(top_k, 0), TOP_K))
    blocks = index.blocks.select("block_id", "text", F.col("doc_id").alias("source"), "namespace")
    return blocks.join(small(top, parsed.count() * TOP_K), "block_id").select("query_id", "rank", "block_id", "score", "text", "source", "namespace")


@dataclass
class Service:
    """``state_path`` is a file of the driver's file system."""

    spark: SparkSession
    state_path: str
    path: str | None = None
    label: str | None = None
    index: I.Index | None = None

    @classmethod
    def restored(cls, spark: SparkSession, state_path: str) -> Service:
        """The service as the last call left it; without a state file it is empty."""
        import os

        service = cls(spark, state_path)
        if os.path.exists(state_path):
            with open(state_path, encoding="utf-8") as f:
                state = json.load(f)
            if state.get("path"):
                service.path, service.label = state["path"], state.get("label")
                service.index = I.load(spark, service.path)
        return service

    def _persist(self, state: dict) -> None:
        import os

        with open(self.state_path + ".new", "w", encoding="utf-8") as f:
            json.dump(state, f)
        os.replace(self.state_path + ".new", self.state_path)

    def set_pack(self, path: str, label: str = "") -> dict:
        """Takes the index stored at ``path``; on any failure what was there stays."""
        try:
            index = I.load(self.spark, path)
        except Exception as e:  # whatever the storage says
            return {"ok": False, "message": f"cannot load {path}: {str(e).splitlines()[0]}"}
        label = label.strip() or None
        try:
            self._persist({"path": path, "label": label})
        except OSError as e:
            return {"ok": False, "message": f"cannot store the state: {e}"}
        self.path, self.label, self.index = path, label, index
        return {"ok": True, "message": "loaded" + (f": {label}" if label else "")}

    def clear_pack(self) -> dict:
        try:
            self._persist({})
        except OSError as e:
            return {"ok": False, "message": f"cannot store the state: {e}"}
        had, self.path, self.label, self.index = self.index is not None, None, None, None
        return {"ok": True, "message": "cleared" if had else "nothing was loaded"}

    def info(self) -> dict:
        if self.index is None:
            return {"loaded": False, "label": None, "version": None, "docs": None, "blocks": None, "terms": None}
        return {"loaded": True, "label": self.label, "version": 3, "docs": self.index.n, "blocks": self.index.n, "terms": self.index.lexicon.count()}

    def health(self) -> dict:
        if self.index is None:
            return {"ok": False, "message": "nothing is loaded"}
        return {"ok": True, "message": "ready" + (f": {self.label}" if self.label else "")}

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        if self.index is None:
            return self.spark.createDataFrame([], "query_id long, rank long, block_id long, score double, text string, source string, namespace string")
        return search(self.index, queries, top_k)


@dataclass
class Retriever:
    """Adapter over an index, or over the stored one at ``path``, which is loaded by the first call and kept."""

    spark: SparkSession
    path: str | None = None
    index: I.Index | None = None
    top_k: int = 5

    @cached_property
    def mounted(self) -> I.Index:
        if self.index is not None:
            return self.index
        if not self.path:
            raise ValueError("a retriever needs an index or its path")
        return I.load(self.spark, self.path)

    def relevant(self, queries: DataFrame) -> DataFrame:
        return R.adapter_rows(R.retrieve(self.mounted, queries, Options(top_k=self.top_k)))

    def relevant_documents(self, question: str) -> list[dict]:
        """One question's hits, at most ``top_k`` rows."""
        rows = self.relevant(self.spark.createDataFrame([(1, question)], "query_id long, q string")).orderBy("rank").collect()
        return [r.asDict(recursive=True) for r in rows]


def mount(spark: SparkSession, path: str) -> I.Index:
    """The index of the packs at ``path``; a folder of shards is one index."""
    return pack.to_index(spark, path)
