"""Corpus and inverted index as DataFrames.

``blocks``   block_id, text, heading, doc_id, namespace, source, tokens, len
``postings`` term, block_id, len (of the block, so that scoring needs no join), tf, positions
``lexicon``  term, df
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import numbered

OPTIONAL = ("heading", "doc_id", "namespace", "source")


class InvalidCorpus(ValueError):
    pass


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where the files give fewer splits than that, as a single small file does.

    Tables of many files keep their splits and are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as input: block = document, namespace = language, heading absent."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return d.select(F.col("doc_id").alias("block_id"), "text", F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("namespace"), "source")


def checked_columns(docs: DataFrame) -> DataFrame:
    """Fails at once where a column is absent or of another type than documents have."""
    if "text" not in docs.columns or "block_id" not in docs.columns:
        raise InvalidCorpus("documents need block_id and text")
    for c in ("text", "heading", "doc_id", "namespace"):
        if c in docs.columns and docs.schema[c].dataType.typeName() not in ("string", "varchar", "char", "void"):
            raise InvalidCorpus(f"documents: {c} must be a string")
    return docs


def validated(docs: DataFrame) -> DataFrame:
    """Fails on a row whose text is missing or blank, as the job reaches it."""
    checked_columns(docs)
    blank = F.coalesce(F.regexp_replace("text", r"\s+", ""), F.lit("")) == ""
    message = F.concat(F.lit("document without text: block "), F.coalesce(F.col("block_id").cast("string"), F.lit("?")))
    return docs.withColumn("text", F.when(blank, F.raise_error(message).cast("string")).otherwise(F.col("text")))


def split_invalid(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows."""
    blank = F.coalesce(F.regexp_replace("text", r"\s+", ""), F.lit("")) == ""
    return docs.where(~blank), docs.where(blank)


def blocks(docs: DataFrame, markdown: bool = False, tokenizer=T.tokenize) -> DataFrame:
    """One block per document; absent columns are null. Tokens are those of the stored text."""
    columns = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in OPTIONAL]
    body = T.strip_markdown("text").alias("text") if markdown else F.col("text")
    out = docs.select("block_id", body, F.col("text").alias("raw"), *columns)
    out = out.withColumn("tokens", F.coalesce(tokenizer("text"), F.array().cast("array<string>")))
    return out.withColumn("len", F.size("tokens").cast("long"))


def postings(blocks_: DataFrame) -> DataFrame:
    """Positions count from 0. Aggregation combines on the map side: a block's rows never leave their task unmerged."""
    exploded = blocks_.select("block_id", "len", F.posexplode("tokens").alias("pos", "term"))
    grouped = exploded.groupBy("term", "block_id", "len").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return grouped.select("term", "block_id", "len", F.size("positions").cast("long").alias("tf"), "positions")


def block_postings(blocks_: DataFrame) -> DataFrame:
    """``postings`` of blocks whose ids are distinct: each block sorts its own tokens, so that nothing is exchanged or held but one block."""
    bound = lambda x, f: F.transform(F.array(x), f)[0]
    spots = F.sort_array(F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))

    def grouped(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]))
        places = lambda lo, hi: F.transform(F.sequence(lo, hi - 1), lambda j: F.get(s, j)["pos"])
        return bound(first, lambda at: F.transform(at, lambda lo, k: F.struct(F.get(s, lo)["term"].alias("term"), places(lo, F.coalesce(F.get(at, k + 1), F.size(s))).alias("positions"))))

    rows = blocks_.where(F.size("tokens") > 0).select("block_id", "len", F.inline(bound(spots, grouped)))
    return rows.select("term", "block_id", "len", F.size("positions").cast("long").alias("tf"), "positions")


def frequencies(blocks_: DataFrame) -> DataFrame:
    """(term, block_id, tf) without positions, counted inside each block, so nothing is shuffled."""
    distinct = blocks_.select("block_id", "tokens", F.explode(F.array_distinct("tokens")).alias("term"))
    return distinct.select("term", "block_id", F.size(F.filter("tokens", lambda t: t == F.col("term"))).cast("long").alias("tf"))


def lexicon(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("term").agg(F.count("*").alias("df"))


def term_ids(blocks_: DataFrame) -> DataFrame:
    """(term, term_id) from 1, in the order of first occurrence."""
    seen = blocks_.select("block_id", F.posexplode("tokens").alias("pos", "term")).groupBy("term").agg(F.min(F.struct("block_id", "pos")).alias("first"))
    return numbered(seen, [F.col("first").asc()], "term_id", 1).select("term", "term_id")


def stats(blocks_: DataFrame, postings_: DataFrame) -> DataFrame:
    """One row: docs, blocks, terms, avg_block_len."""
    terms = postings_.agg(F.countDistinct("term").alias("terms"))
    sizes = blocks_.agg(F.count("*").alias("docs"), F.count("*").alias("blocks"), F.avg("len").alias("avg_block_len"))
    return sizes.crossJoin(terms).select("docs", "blocks", "terms", "avg_block_len")


@dataclass
class Index:
    """What retrieval reads. ``n`` and ``avg_len`` are of the whole corpus."""

    blocks: DataFrame
    postings: DataFrame
    lexicon: DataFrame
    n: int
    avg_len: float
    headed: bool = True  # whether any block can have a heading
    ids: DataFrame | None = None  # (term, term_id), where ties go by the first term met
    scanned: bool = False  # whether small batches read the blocks and not the postings, which aren't stored
    made: Callable[[DataFrame], DataFrame] | None = None  # blocks of the documents that a step on these leaves

    def only(self, ids: DataFrame) -> DataFrame:
        """The blocks with one of ``ids(block_id)``. Texts are taken apart behind the join: Spark doesn't bring it below."""
        there = lambda rows: rows.join(ids, "block_id", "left_semi")
        return self.made(there) if self.made else there(self.blocks)

    @property
    def spark(self) -> SparkSession:
        return self.blocks.sparkSession


def build(docs: DataFrame, markdown: bool = False, tokenizer=T.tokenize, persist: bool = False, strict: bool = False, ordered: bool = False) -> Index:
    """Index of ``docs``, whose columns are checked; with ``strict`` a blank text fails the job, else it is an empty block. With ``ordered`` terms are numbered and decide ties."""
    given = validated(docs) if strict else checked_columns(docs)
    b = blocks(given, markdown, tokenizer)
    if persist:
        b = b.persist()
    p = postings(b)
    terms = lexicon(p)
    if persist:
        p = p.persist()
        terms = lexicon(p).persist()
    row = b.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    return Index(b, p, terms, row["n"], row["avg"] or 1.0, "heading" in docs.columns, term_ids(b) if ordered else None, not persist, None if persist else lambda step: blocks(step(given), markdown, tokenizer))


def save(index: Index, path: str, buckets: int | None = None) -> None:
    """Parquet tables; postings are ranged by term, so a query's terms prune row groups by their minima and maxima.

    There are at least 64 buckets, or as many as the session has shuffle partitions.
    ``raw`` is stored where it isn't the text. Postings that aren't stored yet are
    made of the stored tokens, as ranging reads its input twice.
    """
    buckets = buckets or max(64, int(index.spark.conf.get("spark.sql.shuffle.partitions")))
    store = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    store(index.blocks.withColumn("raw", F.when(~F.col("raw").eqNullSafe(F.col("text")), F.col("raw"))), "blocks")
    made = block_postings(index.spark.read.parquet(f"{path}/blocks")) if index.scanned else index.postings
    store(made.repartitionByRange(buckets, "term", "block_id").sortWithinPartitions("term", "block_id"), "postings")
    saved = index.spark.read.parquet(f"{path}/postings")
    lexicon(saved).repartitionByRange(max(1, buckets // 8), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/lexicon")
    index.spark.createDataFrame([(3, index.n, index.avg_len)], "version int, blocks long, avg_block_len double").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Index:
    meta = spark.read.parquet(f"{path}/meta").first()
    blocks_, *rest = (spark.read.parquet(f"{path}/{t}") for t in ("blocks", "postings", "lexicon"))
    return Index(blocks_.withColumn("raw", F.coalesce("raw", "text")), *rest, meta["blocks"], meta["avg_block_len"])


def contribution(tf: Column, df: Column, length: Column, n: int, avg: float, k1: float = 1.5, b: float = 0.75) -> Column:
    """One term's part of the BM25 score."""
    idf = F.log(1.0 + (float(n) - df + 0.5) / (df + 0.5))
    return idf * (tf * (k1 + 1.0)) / (tf + k1 * ((1.0 - b) + b * (length / float(avg))))
