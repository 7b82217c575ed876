"""Operator 1: language identification with error-correcting output codes.

Every language has a codeword of bits; one binary n-gram classifier per bit
(logistic regression over hashed byte trigrams of the lower-cased text) predicts
that bit. Up to seven languages get the exhaustive code of 2**(k-1)-1 bits (any
two words differ in 2**(k-2) bits), more get ``RANDOM_BITS`` pseudo-random
columns, the seed of which is searched for the greatest smallest distance.
Decoding is loss-weighted: each bit contributes the logistic loss of its margin
against the codeword's bit, times the bit's weight (log-odds of its training
accuracy), and the nearest codeword wins. The gap to the runner-up, as a share
of the total weight, is the margin; a document is ambiguous below
``MIN_MARGIN``. Margins of few trigrams are uncertain, by about ``SPREAD`` over the
root of their number, and a document is rejected only if its margin is below
``MIN_MARGIN`` by more than that (or if it has no letters at all): it is not enough that
a short text leaves the language open.

The classifiers are fitted on a bounded sample of labelled rows, the
``SAMPLE_PER_LANGUAGE`` rows of each language with the smallest hash of the id
(the documented bound); whole texts are read, in fitting and in
prediction, and every row is predicted. The sample's features are held sparse, and
made dense ``CHUNK`` rows at a time.

Cases: null, empty or letterless text has language ``und``, margin 0, ambiguous
and rejected; ties between codewords go to the first language by name; repeated
rows get equal results; an empty table, or one without a labelled language,
gives every row ``und``; null labels are left out of fitting; one single
language is decoded with one constant bit; extra columns are ignored by
``identify`` and carried by ``keep_identified``; a null ``doc_id`` is carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import pick, table, texts

DIMENSIONS = 1 << 13
SAMPLE_PER_LANGUAGE = 300
RANDOM_BITS = 63
EPOCHS, RATE, RIDGE = 150, 4.0, 1e-4
CHUNK = 1024
MIN_MARGIN = 0.05
SPREAD = 0.5
UNKNOWN = "und"

SCHEMA = "doc_id long, lang_pred string, bits string, loss double, margin double, ambiguous boolean, rejected boolean"


def codewords(k: int) -> np.ndarray:
    """(k, bits) of +1 and -1."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        n = 2 ** (k - 1) - 1
        return np.array([[1 if row == 0 or (bit >> (row - 1)) & 1 else -1 for bit in range(n)] for row in range(k)], dtype=float)
    best, most = None, -1
    for seed in range(64):
        code = np.where(np.random.default_rng(seed).random((k, RANDOM_BITS)) < 0.5, -1.0, 1.0)
        split = np.abs(code.sum(0)) < k  # a bit has to separate something
        apart = (RANDOM_BITS - code @ code.T) / 2 + np.eye(k) * RANDOM_BITS
        if split.all() and (least := apart.min()) > most:
            best, most = code, least
    return best


_OTHER = np.ones(256, dtype=bool)
_OTHER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = False


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the letters, all else being one kind of gap."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    gap = _OTHER[b]
    keep = ~(gap & np.concatenate(([True], gap[:-1]))) if len(b) else gap  # runs of gaps count once
    b = np.concatenate(([32], np.where(gap, 32, b)[keep])).astype(np.uint32)
    if len(b) < 3:
        return b[:0].astype(np.int64)
    return ((b[:-2] * 0x9E3779B1 ^ b[1:-1] * 0x85EBCA6B ^ b[2:] * 0xC2B2AE35) * np.uint32(0x27D4EB2F) >> np.uint32(19)).astype(np.int64)


def features(text: str) -> tuple[np.ndarray, int]:
    grams = trigrams(text)
    x = np.sqrt(np.bincount(grams, minlength=DIMENSIONS))
    norm = np.sqrt(np.dot(x, x))
    return (x / norm if norm else x), len(grams)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (dimensions + 1, bits)
    trust: np.ndarray  # of each bit

    def decode(self, margins: np.ndarray) -> tuple[int, float, float]:
        """(language, its loss, margin to the runner-up) from the margins of the bits."""
        loss = np.logaddexp(0, -self.code * margins) @ self.trust / self.trust.sum()
        order = np.argsort(loss, kind="stable")
        apart = loss[order[1]] - loss[order[0]] if len(order) > 1 else 1.0
        return int(order[0]), float(loss[order[0]]), float(apart)

    def predict(self, text: str) -> tuple[str, str, float, float, bool, bool]:
        x, n = features(text)
        if not n or not self.languages:
            return UNKNOWN, "", 0.0, 0.0, True, True
        margins = x @ self.weights[:-1] + self.weights[-1]
        best, loss, apart = self.decode(margins)
        ambiguous = apart < MIN_MARGIN
        bits = "".join("1" if m > 0 else "0" for m in margins)
        return self.languages[best], bits, round(loss, 6), round(apart, 6), ambiguous, bool(apart + SPREAD / np.sqrt(n) < MIN_MARGIN)


def fit(rows: list[tuple[str, str]]) -> Model:
    """From (text, language) rows."""
    languages = sorted({lang for _, lang in rows})
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((DIMENSIONS + 1, 1)), np.ones(1))
    held, labels = [], []
    for text, lang in rows:
        x, n = features(text)
        if n:
            at = np.flatnonzero(x)
            held.append((at.astype(np.uint16), x[at].astype(np.float32)))
            labels.append(languages.index(lang))
    if not held:
        return Model([], code, np.zeros((DIMENSIONS + 1, 1)), np.ones(1))
    target = code[labels].astype(np.float32)
    count = np.bincount(labels, minlength=len(languages))
    share = 1.0 / count[labels]
    share = (share / share.sum())[:, None].astype(np.float32)  # languages weigh alike

    def dense(begin: int) -> np.ndarray:
        part = held[begin : begin + CHUNK]
        x = np.zeros((len(part), DIMENSIONS + 1), dtype=np.float32)
        x[:, -1] = 1
        for row, (at, value) in zip(x, part):
            row[at] = value
        return x

    chunks = range(0, len(held), CHUNK)
    few = {begin: dense(begin) for begin in list(chunks)[:8]}  # the rest are made anew each time
    w = np.zeros((DIMENSIONS + 1, code.shape[1]), dtype=np.float32)
    speed = np.zeros_like(w)
    for _ in range(EPOCHS):
        slope = -RIDGE * w
        for begin in chunks:
            x, y = few.get(begin) if begin in few else dense(begin), target[begin : begin + CHUNK]
            pull = y / (1 + np.exp(np.clip(y * (x @ w), -30, 30)))
            slope += x.T @ (pull * share[begin : begin + CHUNK])
        speed = 0.9 * speed + RATE * slope
        w += speed
    right = np.zeros(code.shape[1])
    for begin in chunks:
        x = few.get(begin) if begin in few else dense(begin)
        right += ((x @ w > 0) == (target[begin : begin + CHUNK] > 0)).sum(axis=0)
    right = np.clip(right / len(held), 0.51, 0.999)
    return Model(languages, code, w.astype(np.float64), np.log(right / (1 - right)))


def sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """The bounded sample of labelled rows.

    Only ids, labels and lengths pass the shuffle; each task keeps its own best
    rows first, so that shuffle holds at most ``per_language`` rows per task and
    language. Texts are then fetched by id.
    """
    rows = pick(docs, "doc_id", "lang", "text").where("lang is not null and doc_id is not null")
    keyed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("r"))
    window = Window.partitionBy("lang").orderBy("r", "doc_id")
    chosen = keyed.withColumn("n", F.row_number().over(window)).where(F.col("n") <= per_language).select("doc_id", "lang")
    chosen = {(r.doc_id, r.lang) for r in chosen.collect()}
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted({i for i, _ in chosen})], "doc_id long")
    found = rows.join(F.broadcast(ids), "doc_id", "left_semi").collect()  # as many as the bound allows
    return sorted({(r.doc_id, r.text, r.lang) for r in found if r.text is not None and (r.doc_id, r.lang) in chosen})


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    return fit([(text, lang) for _, text, lang in sample(docs, per_language)])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: language, loss, margin and verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, whatever the corpus

    def run(batches):
        for b in batches:
            rows = [shared.value.predict(t) for t in texts(b.column(1))]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *columns], names=["doc_id", "lang_pred", "bits", "loss", "margin", "ambiguous", "rejected"])

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    @F.pandas_udf("boolean")
    def accepted(text: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.predict(t or "")[5] for t in text], dtype=bool)

    return docs.where(accepted(F.col("`text`")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
