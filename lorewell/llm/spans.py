r"""Operator 2: substring deduplication by sliding sentence spans.

Words are runs of letters and digits, lower-cased; Chinese and Japanese characters
are words of their own, since no white space parts them. Sentences end at a stop
(closing signs included) before white space, at a full-width stop, or at a line
end, and are compared by their words. Every run of ``SPAN`` = 3 consecutive
sentences is a span, and so is every run of ``WORDS`` = 25 consecutive words: a
passage often begins and ends inside a sentence, and one of long sentences holds
no three whole ones. Spans meet by hash over the whole corpus; the occurrence with
the smallest (doc_id, position) stays, and all words that any other occurrence
covers go, with the signs after them. A repeated passage of 25 words thus goes to
its last word wherever sentences end, and shorter ones go only as three whole
sentences, so stock phrases stay.

A sentence span of 25 words or more is equal to another only if all its runs are,
so the shorter ones alone are hashed as such. Nor is every run of words exchanged:
of every 18 consecutive 8-word grams the one with the least hash is an anchor, so
each run holds one, equal runs hold equal ones, and only runs with an anchor that
occurs twice are compared, the runs of an anchor as one row. The result is that of
comparing all. A span is known by the 64-bit hash of its anchor (or of all its
words), its place relative to that, and 32 further bits.

Anchors and spans that a sample of the documents shows to be in many of them are
hot: they count as repeated at once and their rows are spread over ``SALTS`` keys, of
each of which the first then meets the others'. The sample decides where rows go,
never what is compared.

Cases: null text stays null; empty texts and texts of fewer than ``SPAN`` sentences
and ``WORDS`` words stay as they are; a document that repeats another wholly keeps an
empty text, and so do repeats within one document lose all but the first; rows that
repeat a ``doc_id`` are one document, at the same positions, and each loses what its own
text holds there; rows with a null ``doc_id`` are neither compared nor changed; an empty
table gives an empty result; extra columns are carried, whatever their names;
``doc_id`` is an integer. Texts of any length are read whole. ``n_chars``, where it
exists, is counted anew for changed texts. Scripts without spaces other than Chinese
and Japanese are cut at spaces and signs alone.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import characters, code_points, free, pick, table, texts

SPAN = 3
WORDS = 25
GRAM = 8
END = re.compile(r"""[.!?…]["')\]]*\s+|[。！？]["')\]」』]*\s*|\n+""")
BASE = np.uint64(0x9E3779B97F4A7C15)
IDEOGRAPHS = ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
SAMPLE, HOT, SALTS = 20_000, 40, 64  # documents looked at; how many of them make a span hot; keys of a hot span
LETTERS = 1 << 18  # characters worked on at once

MET = "g long, salt int, doc_id long, pos int, off int, hs array<int>"


@lru_cache(maxsize=1)
def _alone() -> np.ndarray:
    alone = np.zeros(0x110000, dtype=bool)
    for first, last in IDEOGRAPHS:
        alone[first : last + 1] = True
    return alone


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(n: int) -> np.ndarray:
    ups = np.full(n, BASE, np.uint64)
    ups[:1] = 1
    return np.multiply.accumulate(ups)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * BASE + hashes[k : k + n]
    return mixed(out)


class Words:
    """The words of some texts, one after another: ``at`` where each begins in the joined texts, ``hash``, ``doc`` and ``local``, its place in its text."""

    def __init__(self, docs: list[str]):
        lower, is_word, _ = characters()
        self.text = "\0".join(docs)
        codes = code_points(self.text)
        self.offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in docs])))
        where = np.flatnonzero(is_word[codes])
        if not len(where):
            self.at = self.doc = self.local = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(len(docs) + 1, np.int64)
            return
        alone = _alone()[codes[where]]
        head = np.ones(len(where), dtype=bool)
        head[1:] = (where[1:] != where[:-1] + 1) | alone[1:] | alone[:-1]
        at = np.flatnonzero(head)
        place = np.arange(len(where)) - np.repeat(at, np.diff(np.append(at, len(where))))
        ups = _powers(int(place.max()) + 1)
        self.at = where[at]
        self.hash = mixed(np.add.reduceat((lower[codes[where]].astype(np.uint64) + np.uint64(1)) * ups[place], at))
        self.doc = np.searchsorted(self.offset, self.at, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(docs) + 1))  # first word of each text
        self.local = np.arange(len(self.at)) - self.first[self.doc]

    def grams(self) -> np.ndarray:
        return runs(self.hash, GRAM)

    def anchors(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts of all runs that lie within a text, the anchor of each)."""
        if len(self.hash) < WORDS:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.flatnonzero(self.doc[: -WORDS + 1] == self.doc[WORDS - 1 :])
        least = np.lib.stride_tricks.sliding_window_view(grams, WORDS - GRAM + 1)[starts].argmin(axis=1)
        return starts, starts + least

    def sentences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, number of words, two hashes) of each span of ``SPAN`` sentences with fewer than ``WORDS`` words."""
        none = np.zeros(0, np.int64)
        if not len(self.hash):
            return none, none, none, none
        ends = np.fromiter((m.end() for m in END.finditer(self.text)), np.int64)
        number = np.searchsorted(ends, self.at, "right")
        head = np.ones(len(number), dtype=bool)
        head[1:] = (number[1:] != number[:-1]) | (self.doc[1:] != self.doc[:-1])
        begin = np.flatnonzero(head)
        stop = np.append(begin[1:], len(number))
        if len(begin) < SPAN:
            return none, none, none, none
        n = stop[SPAN - 1 :] - begin[: -SPAN + 1]
        ok = np.flatnonzero((self.doc[begin[: -SPAN + 1]] == self.doc[stop[SPAN - 1 :] - 1]) & (n < WORDS))
        first, n = begin[ok], n[ok]
        one, two = np.zeros(len(ok), np.uint64), np.zeros(len(ok), np.uint64)
        for k in range(WORDS - 1):  # so that a span's hashes depend on its words alone
            on = k < n
            h = self.hash[np.minimum(first + k, len(self.hash) - 1)]
            one = np.where(on, one * BASE + h, one)
            two = np.where(on, mixed(two + h), two)
        for k in range(SPAN):
            size = (stop[ok + k] - begin[ok + k]).astype(np.uint64)
            one, two = one * BASE + size, mixed(two + size)
        return first, n, mixed(one), two


def low(x: np.ndarray) -> np.ndarray:
    """The lower 32 bits, as Spark's int."""
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def parts(b: pa.RecordBatch, text: int):
    """(slice, its texts) of about ``LETTERS`` characters."""
    found = texts(b.column(text))
    begin = size = 0
    for i, t in enumerate(found):
        size += len(t)
        if size >= LETTERS:
            yield b.slice(begin, i + 1 - begin), found[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(found):
        yield b.slice(begin), found[begin:]


def hot_spans(rows: DataFrame, n: int) -> np.ndarray:
    """Hashes of the anchors and sentence spans that ``HOT`` places of the sample hold: no more than the sample has words."""

    def seen(batches):
        for b in batches:
            for _, found in parts(b, 0):
                w = Words(found)
                grams = w.grams()
                g = np.concatenate([grams[np.unique(w.anchors(grams)[1])], w.sentences()[2].astype(np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], names=["g"])

    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    found = some.mapInArrow(seen, "g long").groupBy("g").count().where(F.col("count") >= HOT).select("g").toArrow()
    return np.sort(found["g"].to_numpy())


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, found) what goes of each document: anchors with the starts of later runs as a mask, and spans of sentences."""
    rows = pick(docs, "doc_id", "text").where("doc_id is not null and text <> ''")
    hot = docs.sparkSession.sparkContext.broadcast(hot_spans(rows, docs.count()))  # bounded by the sample
    own, at = free(docs, "own_id", "likely")

    def sample(batches):
        for b in batches:
            for part, found in parts(b, 1):
                w = Words(found)
                grams = w.grams()
                a = np.unique(w.anchors(grams)[1])
                g = grams[a].view(np.int64)
                a, g = a[~np.isin(g, hot.value)], g[~np.isin(g, hot.value)]
                yield pa.RecordBatch.from_arrays([pa.array(g), part.column(0).cast(pa.int64()).take(pa.array(w.doc[a])), pa.array(w.local[a].astype(np.int32))], names=["g", "doc_id", "pos"])

    def compare(batches):
        for b in batches:
            b = pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("text"), b.column(at)], names=["doc_id", "text", "at"])
            b = b.filter(pa.compute.and_(b.column(0).is_valid(), b.column(1).is_valid()))
            for part, found in parts(b, 1):
                w = Words(found)
                grams = w.grams()
                starts, anchor = w.anchors(grams)
                likely = part.column(2)
                count = likely.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                near = np.zeros(len(grams) + 1, dtype=bool)
                flat = likely.flatten().to_numpy(zero_copy_only=False)
                index = np.repeat(w.first[:-1], count) + flat  # rows that repeat an id may be shorter
                near[index[index < len(near)].astype(np.int64)] = True
                is_hot = np.isin(grams.view(np.int64), hot.value)
                near[:-1] |= is_hot
                on = near[anchor]
                starts, anchor = starts[on], anchor[on]
                h = low(runs(w.hash, WORDS))[starts]
                head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
                first, n, one, two = w.sentences()
                g = np.concatenate([grams[anchor[head]], one.astype(np.uint64)]).view(np.int64)
                begin = np.concatenate([starts[head], first])
                off = np.concatenate([anchor[head] - starts[head], -n]).astype(np.int32)
                hs = np.concatenate([h, low(two.astype(np.uint64))])
                ends = np.concatenate([head, len(h) + np.arange(len(n) + 1)]).astype(np.int32)
                ids = part.column(0).take(pa.array(w.doc[begin]))
                salt = np.where(np.isin(g, hot.value), (mixed(ids.to_numpy().view(np.uint64)) % np.uint64(SALTS)).astype(np.int32), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(salt), ids, pa.array(w.local[begin].astype(np.int32)), pa.array(off), pa.ListArray.from_arrays(pa.array(ends), pa.array(hs))], names=["g", "salt", "doc_id", "pos", "off", "hs"])

    place = F.struct("doc_id", "pos")
    same = Window.partitionBy("g")
    met = rows.mapInArrow(sample, "g long, doc_id long, pos int")
    # A window, as a join of ``met`` with itself would run its Python stage twice.
    likely = met.withColumn("twice", F.min(place).over(same) != F.max(place).over(same)).where("twice")
    likely = likely.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("pos").alias(at))
    # A left join of all columns, as in remove_repeats, so that both read one exchange of the texts.
    both = docs.join(likely.hint("shuffle_hash"), F.col("`doc_id`") == F.col(own), "left")
    spans = both.mapInArrow(compare, MET).repartition("g", "salt")
    each = spans.select("g", "salt", "doc_id", "pos", "off", F.posexplode("hs").alias("i", "h"))
    each = each.select("g", "salt", "doc_id", (F.col("pos") + F.col("i")).alias("pos"), (F.col("off") - F.col("i")).alias("off"), "h")
    each = each.withColumn("first", place == F.min(place).over(Window.partitionBy("g", "salt", "off", "h")))
    # One expression, so that no part of it is pushed below the exchange, which then serves both.
    over = each.where(F.when(F.col("first"), F.col("salt")).otherwise(-1) >= 0).drop("first").withColumn("first", place == F.min(place).over(Window.partitionBy("g", "off", "h")))
    mask = F.when(F.col("off") < 0, F.col("off")).otherwise(F.expr("shiftleft(1, off)"))
    anchor = F.when(F.col("off") < 0, F.col("pos")).otherwise(F.col("pos") + F.col("off"))
    check = F.col("g").bitwiseAND(F.lit(0xFFFFFFFF))
    gone = [x.where("not first").groupBy("g", "salt", "doc_id", anchor.alias("a")).agg(F.bit_or(mask).alias("m")).select("doc_id", "a", "m", check.alias("c")) for x in (each, over)]
    return gone[0].unionByName(gone[1]).groupBy("doc_id").agg(F.collect_list(F.struct("a", "m", "c")).alias("found"))


def without(text: str, a: np.ndarray, m: np.ndarray, c: np.ndarray) -> str:
    """``text`` without the words that ``repeats`` found. ``c`` are bits that the hashes there must have."""
    w = Words([text])
    grams = w.grams()
    run = m > 0
    ok = run & (a < len(grams))
    ok[ok] = (grams[a[ok]] & np.uint64(0xFFFFFFFF)).astype(np.int64) == c[ok]
    start = (a[ok][:, None] - np.arange(WORDS - GRAM + 1))[(m[ok][:, None] >> np.arange(WORDS - GRAM + 1)) & 1 == 1]
    start = start[(start >= 0) & (start + WORDS <= len(w.hash))]
    delta = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + WORDS, -1)
    if not run.all():
        first, n, one, _ = w.sentences()
        own = {(int(f), int(k)): int(h & np.uint64(0xFFFFFFFF)) for f, k, h in zip(first, n, one)}
        for f, k, h in zip(a[~run].tolist(), (-m[~run]).tolist(), c[~run].tolist()):
            if own.get((f, k)) == h:
                delta[f] += 1
                delta[f + k] -= 1
    gone = np.concatenate(([0], np.cumsum(delta)[:-1] > 0, [0]))
    edge = np.diff(gone)
    bounds = np.append(w.at, len(text))
    bounds[0] = 0
    keep, last = [], 0
    for i, j in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()):
        keep.append(text[last : bounds[i]])
        last = bounds[j]
    return "".join(keep) + text[last:]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without repeated passages, in the columns of ``docs``."""
    own, found, left = free(docs, "own_id", "found", "rest")

    @F.pandas_udf("string")
    def rest(text: pd.Series, a: pd.Series, m: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or x is None else without(t, np.asarray(x, np.int64), np.asarray(y, np.int64), np.asarray(z, np.int64)) for t, x, y, z in zip(text, a, m, c)], dtype=object)

    gone = repeats(docs).select(F.col("doc_id").alias(own), F.col("found").alias(found))
    both = docs.join(gone.hint("shuffle_hash"), F.col("`doc_id`") == F.col(own), "left")
    hit = F.col(found).isNotNull() & F.col("`text`").isNotNull()
    both = both.withColumn(left, rest(F.when(hit, F.col("`text`")), *(F.col(found)[x] for x in "amc")))
    changed = {"text": F.when(hit, F.col(left)).otherwise(F.col("`text`"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("`n_chars`"))
    return both.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


_CJK = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in IDEOGRAPHS)

#: Ideographs are set apart with chr(1), sentence ends with chr(2); then words are cut with the signs after them.
ORACLE = rf"""
WITH marked AS (
  SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?…]["'')\]]*\s+|[。！？]["'')\]」』]*\s*|\n+)', '\1' || chr(2), 'g'), '([{_CJK}])', chr(1) || '\1' || chr(1), 'g') AS t
  FROM documents WHERE doc_id IS NOT NULL AND text <> ''
), cut AS (
  SELECT doc_id, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]*') AS parts, regexp_extract(t, '^[^\p{{L}}\p{{N}}]*') AS lead FROM marked
), words AS MATERIALIZED (
  SELECT doc_id, lead, parts, list_transform(parts, lambda x: lower(regexp_extract(x, '^[\p{{L}}\p{{N}}]+'))) AS w FROM cut
), runs AS (
  SELECT doc_id, i, {WORDS} AS n, array_to_string(w[i + 1:i + {WORDS}], ' ') AS key FROM (SELECT doc_id, w, unnest(range(len(w) - {WORDS - 1})) AS i FROM words)
), sized AS (
  SELECT doc_id, i, w[i + 1] AS word, sum(CASE WHEN i = 0 OR contains(parts[i], chr(2)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s
  FROM (SELECT doc_id, w, parts, unnest(range(len(w))) AS i FROM words)
), sentences AS (
  SELECT doc_id, s, min(i) AS i, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS key FROM sized GROUP BY doc_id, s
), spans AS (
  SELECT doc_id, i, n + n1 + n2 AS n, concat_ws('|', key, key1, key2) AS key FROM (
    SELECT *, lead(n) OVER o AS n1, lead(n, 2) OVER o AS n2, lead(key) OVER o AS key1, lead(key, 2) OVER o AS key2 FROM sentences WINDOW o AS (PARTITION BY doc_id ORDER BY s))
  WHERE n2 IS NOT NULL
), later AS (
  SELECT doc_id, i, n FROM (SELECT doc_id, i, n, key FROM runs UNION ALL SELECT doc_id, i, n, '|' || key FROM spans) QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM later
), rest AS (
  SELECT p.doc_id, replace(replace(string_agg(CASE WHEN g.i IS NULL THEN CASE WHEN p.i = 0 THEN p.lead ELSE '' END || p.part ELSE '' END, '' ORDER BY p.i), chr(1), ''), chr(2), '') AS text
  FROM (SELECT doc_id, lead, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM words WHERE doc_id IN (SELECT doc_id FROM gone)) p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(r.text, d.text) AS text, d.lang, d.source, CASE WHEN r.text IS NULL THEN d.n_chars ELSE length(r.text) END AS n_chars
FROM documents d LEFT JOIN rest r USING (doc_id)
"""

QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {"op2_substring_dedup": ORACLE}
