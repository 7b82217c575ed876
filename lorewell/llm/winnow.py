r"""Operator 5: document fingerprints by winnowing.

Letters and digits of the text, lower-cased, form the string that is
fingerprinted; every k-gram of ``K`` = 25 of them has a polynomial hash of its
code points modulo 2**64. Of every ``WINDOW`` = 26 consecutive hashes the least
(unsigned) is chosen, the rightmost among equals, and kept with its position once,
however many windows choose it. Two texts that share ``K + WINDOW - 1`` = 50
consecutive letters or digits therefore share a fingerprint at the same place of the
shared part: so do a document and the shortest benchmark text in it. ``pos`` is the
offset of the k-gram in the original text, in characters.

Hashes come from wrap-around prefix sums and window minima from doubling steps,
both over whole arrays; a text is worked through in blocks that overlap by a
window, so its length is unbounded.

Cases: null, empty and shorter than ``K`` letters: no fingerprint, no row; fewer
than ``WINDOW`` k-grams: the least of them; rows that repeat a ``doc_id`` yield
their rows each; a null ``doc_id`` is carried; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import characters, code_points, pick, table, texts

K = 25
WINDOW = 26
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 16

SCHEMA = "doc_id long, pos long, fingerprint long"


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64."""
    inverse = pow(BASE, -1, 1 << 64)
    ups, downs = np.full(BLOCK + K, BASE, np.uint64), np.full(BLOCK + K, inverse, np.uint64)
    ups[0] = downs[0] = 1
    return np.multiply.accumulate(ups), np.multiply.accumulate(downs)


def gram_hashes(letters: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of every k-gram: sum of letter[i+t] * BASE**t modulo 2**64."""
    ups, downs = _powers()
    n = len(letters) - k + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters.astype(np.uint64) * ups[: len(letters)], dtype=np.uint64)))
    return (sums[k:] - sums[:n]) * downs[:n]


def chosen(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Indices that some window chooses, in order."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    low, at = hashes, np.arange(n)
    window = min(window, n)
    done = 1
    while done < window:
        step = min(done, window - done)
        right = low[step:] <= low[:-step]  # ties: the rightmost
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        done += step
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def fingerprints(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fingerprints) of a text; ``k`` is at most ``K``."""
    lower, word, _ = characters()
    codes = code_points(text)
    where = np.flatnonzero(word[codes])
    if len(where) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = lower[codes[where]]
    at, got, n = [], [], len(letters) - k + 1
    for begin in range(0, n, BLOCK - window + 1):
        if begin and n - begin < window:
            break  # the last block's windows were whole
        h = gram_hashes(letters[begin : begin + BLOCK + k - 1], k)
        index = chosen(h, window)
        if at and len(index) and at[-1][-1] == begin + index[0]:
            index = index[1:]
        at.append(begin + index)
        got.append(h[index])
    return where[np.concatenate(at)], np.concatenate(got).view(np.int64)


def winnow(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per fingerprint: document, position, hash."""

    def run(batches):
        for b in batches:
            for begin in range(0, b.num_rows, 512):
                part = b.slice(begin, 512)
                found = [fingerprints(t, k, window) for t in texts(part.column(1))]
                rows = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
                ids = part.column(0).cast(pa.int64()).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64)) for i in (0, 1))], names=["doc_id", "pos", "fingerprint"])

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE powers(t, p) AS (
  SELECT 0, 1::UHUGEINT UNION ALL SELECT t + 1, p * 11400714819323198485::UHUGEINT % 18446744073709551616::UHUGEINT FROM powers WHERE t < 24
), coef AS (SELECT list(p ORDER BY t) AS c FROM powers),
chars AS (
  SELECT doc_id, unnest(range(length(text))) AS pos, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''
), letters AS (
  SELECT doc_id, pos, CASE WHEN length(lower(ch)) = 1 THEN unicode(lower(ch)) ELSE unicode(ch) END AS code,
    row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i
  FROM chars WHERE regexp_full_match(ch, '[\p{L}\p{N}]')
), grams AS (
  SELECT doc_id, pos, i, list(code) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS g FROM letters
), hashed AS (
  SELECT doc_id, pos, i, (list_reduce(list_transform(list_zip(g, c), lambda x: x[1]::UHUGEINT * x[2]), lambda a, b: a + b) % 18446744073709551616::UHUGEINT)::UBIGINT AS h
  FROM grams, coef WHERE len(g) = 25
), counted AS (SELECT *, max(i) OVER (PARTITION BY doc_id) AS last FROM hashed),
least AS (
  SELECT doc_id, i, last, min({'h': h, 'r': -i}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 25 FOLLOWING) AS m FROM counted
), picked AS (
  SELECT DISTINCT doc_id, -m.r AS i FROM least WHERE i + 25 <= last OR (i = 0 AND last < 25)
)
SELECT doc_id, pos, CASE WHEN h < 9223372036854775808::UBIGINT THEN h::BIGINT ELSE (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT END AS fingerprint FROM picked JOIN hashed USING (doc_id, i)
"""

QUERIES = {"op5_winnowing": op5_winnowing}
ORACLES = {"op5_winnowing": ORACLE}
