"""Queries of vectors: quantization, cosine, reranking, blending."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import retrieve as R
from ..operators import semantic as S
from ..options import Expansion, Options, Semantic
from ..shared import shared_dir
from . import retrieval

OPTIONS = Options(top_k=10, expansion=Expansion(enabled=False), semantic=Semantic(enabled=True, force=True, top_n=50))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("block_id"), "embedding")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal queries, each with a literal vector."""
    q = retrieval.batch(spark, retrieval.BATCH)
    return q.withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * F.col("query_id")).cast("float")))


def asked_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts, each with the vector of the block of its number; one without keeps its lexical order."""
    v = vectors(spark, sf_dir).withColumnRenamed("block_id", "query_id")
    return retrieval.benchmark(spark, sf_dir).join(v, "query_id", "left")


def int8_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = S.quantized(vectors(spark, sf_dir))
    return q.select("block_id", F.array_join(F.col("q").cast("array<string>"), ",").alias("q"), F.round("scale", 9).alias("scale"))


def cosine_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest blocks of every vector."""
    v = vectors(spark, sf_dir).select("block_id", V.unit(F.col("embedding")).alias("v"))
    return S.nearest(v, 5, digits=6).withColumnRenamed("score", "cosine")


def int8_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five greatest integer dot products of every quantized vector."""
    v = S.quantized(vectors(spark, sf_dir)).select("block_id", F.col("q").alias("v"))
    return S.nearest(v, 5).select("query_id", "block_id", F.col("score").cast("long").alias("dot"), "rank")


def reranked(spark: SparkSession, sf_dir: str, q: DataFrame) -> DataFrame:
    hits = R.lexical(retrieval.index(spark, sf_dir), q, OPTIONS).drop("span", "expansion_only")
    out = R.rerank(hits, q, S.sidecar_rows(vectors(spark, sf_dir)), OPTIONS, exact=True)
    return out.select("query_id", "block_id", F.round("semantic_score", 6).alias("semantic_score"), F.round("blended_score", 6).alias("blended_score"))


def cosine_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar vectors: normalized lexical and semantic scores, blended, over the head of fifty."""
    return reranked(spark, sf_dir, asked(spark, sf_dir))


def cosine_rerank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every benchmark text."""
    return reranked(spark, sf_dir, asked_all(spark, sf_dir))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline with quantized vectors, for every benchmark text."""
    hits = R.retrieve(retrieval.index(spark, sf_dir), asked_all(spark, sf_dir), OPTIONS, S.quantized(vectors(spark, sf_dir)))
    return hits.select("query_id", "rank", "block_id", F.round("score", 6).alias("score"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fingerprint(retrieval.index(spark, sf_dir).blocks)


class Letters:
    """A provider without a network: how often the first eight vowels and consonants occur."""

    model_id = "letters"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(c)) for c in "aeiounrs"] for t in texts]


def embed_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all blocks, embedded in the executors, stored and read again."""
    folder = f"{shared_dir(spark)}/embed-{uuid.uuid4().hex}"
    blocks = retrieval.index(spark, sf_dir).blocks
    S.embed_blocks(blocks, Letters(), folder, S.fingerprint(blocks).first()["fingerprint"], "2026-01-01T00:00:00.000Z")
    v = spark.read.parquet(f"{folder}/vectors")
    return v.select("block_id", *(F.round(F.col("vector")[i], 6).alias(f"v{i}") for i in range(8)))


QUERIES = {f.__name__: f for f in (int8_quantize, cosine_top, int8_dot, cosine_rerank, cosine_rerank_all, hybrid_topk, fingerprint, embed_job)}

_RAW = "list_cosine_similarity(list_transform({0}, lambda x: x::DOUBLE), list_transform({1}, lambda x: x::DOUBLE))"
_NORM = "CASE WHEN max({0}) OVER w <= min({0}) OVER w THEN 1 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"

_UNIT = "list_transform(embedding, lambda x: (x::DOUBLE / norm)::FLOAT::DOUBLE)"
#: Integers of the unit vector and its scale, rounded to half precision: ten bits below the leading one, halves to even.
_INT8 = f"""i8 AS MATERIALIZED (SELECT block_id, list_transform(u, lambda x: greatest(-127, least(127, floor(x / s + 0.5::DOUBLE)))::BIGINT) AS q, round_even(s::FLOAT::DOUBLE / step, 0) * step AS scale FROM (
    SELECT *, pow(2, floor(log2(s::FLOAT::DOUBLE)) - 10) AS step FROM (SELECT block_id, u, list_max(list_transform(u, lambda x: abs(x))) / 127 AS s FROM (
      SELECT block_id, {_UNIT} AS u FROM (SELECT vec_id AS block_id, embedding, sqrt(list_reduce(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b)) AS norm FROM embeddings)))))"""

ORACLES = {
    "cosine_top": f"""WITH c AS (SELECT q.vec_id AS query_id, v.vec_id AS block_id, round({_RAW.format('v.embedding', 'q.embedding')}, 6) AS cosine FROM embeddings v, embeddings q)
        SELECT query_id, block_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, block_id) AS rank FROM c QUALIFY rank <= 5""",
    "int8_quantize": f"WITH {_INT8} SELECT block_id, array_to_string(q, ',') AS q, round(scale, 9) AS scale FROM i8",
    "int8_dot": f"""WITH {_INT8}, d AS (SELECT a.block_id AS query_id, b.block_id, list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2]))::BIGINT AS dot FROM i8 a, i8 b)
        SELECT query_id, block_id, dot, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, block_id) AS rank FROM d QUALIFY rank <= 5""",
    "embed_job": f"""WITH c AS (SELECT doc_id AS block_id, {', '.join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE AS c{i}" for i, c in enumerate('aeiounrs'))} FROM documents),
        n AS (SELECT *, sqrt({' + '.join(f'c{i} * c{i}' for i in range(8))}) AS norm FROM c)
        SELECT block_id, {', '.join(f'round(CASE WHEN norm > 0 THEN c{i} / norm ELSE 0 END, 6) AS v{i}' for i in range(8))} FROM n""",
    "cosine_rerank": retrieval._lexical_sql(
        retrieval.BATCH,
        final=f"""SELECT query_id, block_id, round(sem, 6) AS semantic_score, round(0.75::DOUBLE * lex + 0.25::DOUBLE * sem, 6) AS blended_score FROM (
          SELECT query_id, block_id, {_NORM.format('score')} AS lex, {_NORM.format('raw')} AS sem FROM (
            SELECT r.query_id, r.block_id, score, coalesce({_RAW.format('e.embedding', 'q.embedding')}, 0) AS raw
            FROM ranks r JOIN (SELECT query_id, list_transform(range(1, 65), lambda i: sin(i * query_id)::FLOAT) AS embedding FROM qs) q ON q.query_id = r.query_id LEFT JOIN embeddings e ON e.vec_id = r.block_id WHERE rank <= 50) WINDOW w AS (PARTITION BY query_id))""",
    ),
    "fingerprint": """WITH h AS (SELECT md5(doc_id::VARCHAR || chr(1) || doc_id::VARCHAR || chr(1) || coalesce(text, '')) AS h FROM documents),
        s AS (SELECT count(*) AS blocks, (sum(('0x' || h[1:12])::HUGEINT) % 281474976710656)::BIGINT AS a, (sum(('0x' || h[13:24])::HUGEINT) % 281474976710656)::BIGINT AS b FROM h)
        SELECT blocks, blocks || '-' || to_hex(a) || '-' || to_hex(b) AS fingerprint FROM s""",
}
