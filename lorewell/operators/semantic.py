"""Embedding sections and sidecars: build, check, fingerprint, provider hook."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from typing import Protocol
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


class SemanticError(ValueError):
    pass


class Provider(Protocol):
    model_id: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def quantized(vectors: DataFrame, id_column: str = "block_id", column: str = "embedding") -> DataFrame:
    """(block_id, q, scale): integers and half-precision scales."""
    q = vectors.select(F.col(id_column).alias("block_id"), V.quantize(F.col(column)).alias("v"))
    return q.select("block_id", F.col("v.q").alias("q"), V.half(F.col("v.scale")).alias("scale"))


def checked(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """Fails on a row of another dimension or with a missing or infinite number."""
    good = (F.size(column) == dimension) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.withColumn(column, F.when(good, F.col(column)).otherwise(F.raise_error(F.lit("embedding of another dimension or not finite")).cast(vectors.schema[column].dataType)))


def embed(rows: DataFrame, provider: Provider, batch: int = 32, column: str = "text") -> DataFrame:
    """``rows`` with an ``embedding``; the provider is called per batch in the executors."""

    @F.pandas_udf("array<float>")
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = []
            for at in range(0, len(s), batch):
                out += provider.embed([t or "" for t in s.iloc[at : at + batch]])
            yield pd.Series(out)

    return rows.withColumn("embedding", call(F.col(column)))


class HttpProvider:
    """Embeddings from an HTTP service that takes ``{"model", "prompt"}`` and answers ``{"embedding"}``, one request a text."""

    def __init__(self, model_id: str, endpoint: str = "http://localhost:11434", timeout: float = 30.0, path: str = "/api/embeddings"):
        self.model_id, self.url, self.timeout = model_id, endpoint.rstrip("/") + path, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        from urllib.error import URLError
        from urllib.request import Request, urlopen

        body = json.dumps({"model": self.model_id, "prompt": text}).encode()
        try:
            with urlopen(Request(self.url, body, {"content-type": "application/json"}), timeout=self.timeout) as answer:
                vector = json.load(answer).get("embedding")
        except (URLError, OSError, ValueError) as e:
            raise SemanticError(f"no embedding from {self.url}: {e}") from None
        if not isinstance(vector, list) or not vector or not all(isinstance(x, (int, float)) for x in vector):
            raise SemanticError(f"no embedding in the answer of {self.url}")
        return vector


def embed_blocks(blocks: DataFrame, provider: Provider, path: str, fingerprint_: str, created_at: str, batch: int = 32) -> dict:
    """The vectors of all blocks at ``path``: ``vectors`` (block_id, vector) of length 1, and ``head``, one row that says whose they are.

    Embedding runs in the executors and its result is stored before it is checked, so
    that no text is embedded twice.
    """
    spark = blocks.sparkSession
    embed(blocks.select("block_id", "text"), provider, batch).select("block_id", V.unit(F.col("embedding")).alias("vector")).write.mode("overwrite").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    sizes = stored.groupBy(F.size("vector").alias("n")).count().collect()
    if len(sizes) > 1 or any(r["n"] < 1 for r in sizes):
        raise SemanticError("vectors differ in dimension")
    head = {"version": 1, "packFingerprint": fingerprint_, "modelId": provider.model_id, "dimension": sizes[0]["n"] if sizes else 0, "metric": "cosine", "createdAt": created_at}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    return {**head, "blocks": sizes[0]["count"] if sizes else 0}


def inspect(spark, path: str) -> dict:
    """Head and number of blocks of what ``embed_blocks`` stored, or of a sidecar file."""
    if path.endswith(".json"):
        found = parse_sidecar(path)
        return {k: v for k, v in found.items() if k != "blocks"} | {"blocks": len(found["blocks"])}
    head = json.loads(spark.read.text(f"{path}/head").first()["value"])
    return head | {"blocks": spark.read.parquet(f"{path}/vectors").count()}


def compatible(provider: Provider, head: dict) -> None:
    """Fails if a provider's vectors can't be compared with stored ones."""
    if provider.model_id != head.get("modelId"):
        raise SemanticError(f"vectors are of {head.get('modelId')!r}, queries of {provider.model_id!r}")
    if (n := len(provider.embed(["dimension"])[0])) != head.get("dimension"):
        raise SemanticError(f"vectors have {head.get('dimension')} dimensions, queries {n}")


def sidecar_rows(vectors: DataFrame) -> DataFrame:
    return vectors.select("block_id", V.unit(F.col("embedding")).alias("vector"))


def nearest(vectors: DataFrame, k: int, digits: int | None = None, block: int = 4096) -> DataFrame:
    """(query_id, block_id, score, rank): the ``k`` greatest dot products of every vector of ``vectors(block_id, v)``, itself included.

    Blocks of queries meet blocks of vectors as matrix products, each a task's work of
    which ``k`` rows a query remain. Scores count to ``digits``, ties by ``block_id``.
    Only vectors of one width meet; null and empty ones and those with nulls or NaN
    are left out.
    """
    rows = vectors.select("block_id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    rows = rows.where("block_id is not null and size(v) > 0").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))).withColumn("width", F.size("v"))
    parts = max(1, -(-rows.count() // block))
    part = lambda seed: F.pmod(F.xxhash64("block_id", F.lit(seed)), F.lit(parts)).cast("int")
    all_ = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = rows.select("width", part(0).alias("a"), all_.alias("b"), F.lit(True).alias("asks"), "block_id", "v")
    found = rows.select("width", all_.alias("a"), part(1).alias("b"), F.lit(False).alias("asks"), "block_id", "v")

    def best(key, data):
        asks, ids = data["asks"].to_numpy(), data["block_id"].to_numpy()
        x = data["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        q, d = np.flatnonzero(asks), np.flatnonzero(~asks)
        d = d[np.argsort(ids[d], kind="stable")]
        out: list[tuple] = []
        for at in range(0, len(q) if len(d) else 0, 512):
            scores = x[q[at : at + 512]] @ x[d].T
            scores = scores if digits is None else np.round(scores, digits)
            least = np.partition(scores, -min(k, len(d)), axis=1)[:, -min(k, len(d))]
            for row, limit, query in zip(scores, least, ids[q[at : at + 512]]):
                hit = np.flatnonzero(row >= limit)
                hit = hit[np.argsort(-row[hit], kind="stable")][:k]
                out.append((np.full(len(hit), query), ids[d[hit]], row[hit]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "block_id", "score"), columns)))

    tops = asked.unionByName(found).groupBy("width", "a", "b").applyInArrow(best, "query_id long, block_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "block_id")).cast("long")
    return tops.withColumn("rank", rank).where(F.col("rank") <= k)


def fingerprint(blocks: DataFrame) -> DataFrame:
    """One row: a digest of ids and texts that doesn't depend on partitioning.

    Per-block digests are summed modulo 2**64 in two halves, so no order and no
    single task is needed.
    """
    h = F.md5(F.concat_ws("\u0001", F.col("block_id").cast("string"), F.coalesce("doc_id", F.lit("")), F.coalesce("text", F.lit(""))))
    part = lambda i: F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)")
    total = blocks.agg(F.count("*").alias("blocks"), (F.sum(part(1)) % F.lit(2**48)).cast("long").alias("a"), (F.sum(part(13)) % F.lit(2**48)).cast("long").alias("b"))
    return total.select("blocks", F.concat_ws("-", F.col("blocks").cast("string"), F.hex("a"), F.hex("b")).alias("fingerprint"))


def pack_fingerprint(version: int, rows: list[tuple[str | None, str]]) -> str:
    """The fingerprint that sidecars of packs carry: FNV-1a over the version, all ids, then all texts, in block order.

    It runs from the first character to the last, so it is for packs, which are
    held whole by one machine; corpora of any size have ``fingerprint``.
    """
    h = T.plain_fnv32(str(version))
    for part in (*(d or "" for d, _ in rows), *(t for _, t in rows)):
        h = T.plain_fnv32(part, h)
    return f"fnv1a-{h:08x}"


def sidecar_json(fingerprint_: str, model_id: str, dimension: int, rows: list[tuple[int, list[float]]], created_at: str) -> str:
    return json.dumps({"version": 1, "packFingerprint": fingerprint_, "modelId": model_id, "dimension": dimension, "metric": "cosine", "createdAt": created_at, "blocks": [{"blockId": b, "vector": v} for b, v in rows]}, indent=2) + "\n"


def parse_sidecar(raw: str) -> dict:
    """From JSON, a ``data:`` URL or the path of a file."""
    text = raw.strip()
    if text.startswith("data:"):
        head, _, body = text[5:].partition(",")
        text = base64.b64decode(body).decode() if ";base64" in head.lower() else unquote(body)
    elif not text.startswith("{"):
        with open(text.removeprefix("file://"), encoding="utf-8") as f:
            text = f.read()
    try:
        found = json.loads(text)
    except ValueError as e:
        raise SemanticError(f"sidecar isn't JSON: {e}") from None
    if found.get("version") != 1 or found.get("metric") != "cosine":
        raise SemanticError("sidecar must have version 1 and metric cosine")
    return found


def check_sidecar(sidecar: dict, fingerprint_: str, blocks: int, model_id: str | None = None) -> None:
    for ok, what in (
        (sidecar.get("packFingerprint") == fingerprint_, "sidecar belongs to another corpus"),
        (model_id is None or sidecar.get("modelId") == model_id, "sidecar belongs to another model"),
        (len(sidecar.get("blocks", [])) == blocks, "sidecar holds another number of blocks"),
        (all(len(b["vector"]) == sidecar["dimension"] for b in sidecar.get("blocks", [])), "a vector has another dimension"),
    ):
        if not ok:
            raise SemanticError(what)
