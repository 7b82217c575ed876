"""Operators 9 and 10: token counts with a digest cache; byte-level BPE.

**Byte-level BPE (10).** The tiktoken library with a local rank file. A text of
more than ``CHUNK`` characters is cut at safe boundaries before it is encoded: before
white space that follows anything else, between a letter and a digit, and between a
letter or digit and a sign that follows it. There the splitting pattern starts anew
whatever surrounds it, so the tokens are those of the whole text. The rank file is
sent along with the job. Decoding joins the raw bytes of the tokens
before it reads them as UTF-8, so tokens that end inside a character are safe.

Cases (10): null text gives null tokens; empty text gives none; a run of one
kind of character without a safe boundary is encoded in one piece; special-token strings are ordinary text;
repeated rows get equal results; a null ``doc_id`` is carried; an empty table
gives an empty result; extra columns are ignored; lone surrogates can't occur in
Spark strings.

**Token counts (9).** The content of a text is its NFC-free plain form: line
ends as ``\\n``, white space at both ends cut off. The MD5 of the content and the
digest of the tokenizer's version (rank file, pattern) are the key of a cache,
a Parquet folder in the shared directory. Documents join it on the key; of those
without a count, one of each distinct content is encoded, the counts are appended
to the folder, and the documents join it again. Texts move once, to bring equal
contents together, compressed and after each task has dropped its own repeats.

Cases (9): null and empty texts count 0 and touch no cache; two writers may both
append a key, which reading folds into one; a folder written by another version
of the tokenizer never matches; repeated rows are counted alike; a null ``doc_id``
is carried; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick, shared_dir, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 15
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])")

COUNTED = "doc_id long, n_tokens long"
ENCODED = "doc_id long, token_ids array<int>, n_tokens long, round_trip boolean"


def shipped(spark: SparkSession, ranks: str) -> None:
    """Sends the rank file to the executors, once a session."""
    import os

    if os.path.basename(ranks) not in {os.path.basename(x) for x in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(ranks)


def _local(ranks: str) -> str:
    """Where this machine has the file: at its path, or where the job put it."""
    import os

    from pyspark import SparkFiles

    return ranks if os.path.exists(ranks) else SparkFiles.get(os.path.basename(ranks))


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS) -> tiktoken.Encoding:
    with open(_local(ranks), "rb") as f:
        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=found, special_tokens={})


@lru_cache(maxsize=4)
def version(ranks: str = RANKS) -> str:
    """Digest of everything that the counts depend on."""
    with open(ranks, "rb") as f:
        return hashlib.sha256(f.read() + PATTERN.encode()).hexdigest()[:32]


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """``text`` in parts of about ``size`` characters that are tokenized independently."""
    out, at = [], 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def encode(text: str, ranks: str = RANKS) -> list[int]:
    bpe = encoding(ranks)
    if len(text) <= CHUNK:
        return bpe.encode_ordinary(text)
    return [t for part in chunks(text) for t in bpe.encode_ordinary(part)]


def decode(tokens: list[int], ranks: str = RANKS) -> str:
    return encoding(ranks).decode_bytes(tokens).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Token ids of each row, with the outcome of decoding them again."""
    shipped(docs.sparkSession, ranks)

    def run(batches):
        bpe = encoding(ranks)
        for b in batches:
            for begin in range(0, b.num_rows, 256):
                part = b.slice(begin, 256)
                ids, n, same = [], [], []
                for text in part.column(1).to_pylist():
                    tokens = None if text is None else np.array(encode(text, ranks), dtype=np.int32)
                    ids.append(tokens)
                    n.append(None if tokens is None else len(tokens))
                    same.append(None if tokens is None else bpe.decode_bytes(tokens.tolist()) == text.encode())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "token_ids", "n_tokens", "round_trip"])

    return pick(docs, "doc_id", "text").mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids)."""
    shipped(encoded.sparkSession, ranks)

    def run(batches):
        for b in batches:
            out = [None if t is None else decode(t, ranks) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return pick(encoded, "doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def content(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"^\s+|\s+$", "")


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n_tokens) of the cache; empty before the first append."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    schema = "digest binary, n_tokens long"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache_dir: str, ranks: str = RANKS) -> DataFrame:
    """One row per row of ``docs``: its token count, from the cache in ``cache_dir`` or added to it."""
    spark = docs.sparkSession
    shipped(spark, ranks)
    folder = f"{cache_dir}/{version(ranks)}"
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce(content(F.col("text")), F.lit("")).alias("content"))
    keyed = rows.select("doc_id", "content", F.unhex(F.md5("content")).alias("digest"))

    def own(batches, packed=False):
        """Each content of this task once, compressed for the exchange; a task remembers the digests of its own split of the files."""
        seen: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            keep = []
            for i, digest in enumerate(b.column(0).to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    keep.append(i)
            kept = [c.take(pa.array(keep, pa.int64())) for c in b.columns]
            if not packed:
                kept[1] = pa.array([pack(t.encode()) for t in kept[1].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(kept, names=["digest", "content"])

    def encoded(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in own(batches, packed=True):
            n = [len(encode(unpack(t).decode(), ranks)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    # The one exchange of texts serves both the join with the cache and the choice of one text per digest.
    met = keyed.where("content <> ''").select("digest", "content").mapInArrow(own, "digest binary, content binary").repartition("digest")
    misses = met.join(cached(spark, folder).select("digest").hint("merge"), "digest", "left_anti")  # the cache only grows: sorted, it can spill
    misses.mapInArrow(encoded, "digest binary, n_tokens long").write.mode("append").parquet(folder)
    known = cached(spark, folder)
    return keyed.select("doc_id", "digest").join(known, "digest", "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cache of contents serves all tables."""
    return count_tokens(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token_counts")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts, "op10_byte_bpe": op10_byte_bpe}
ORACLES: dict[str, str] = {}
