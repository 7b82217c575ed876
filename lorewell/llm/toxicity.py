r"""Operator 7: misspelling-tolerant lexicon filter with context scores.

The lexicon is a table (term, weight, edits). ``LEXICON`` holds plain English terms
and their regular plurals; ``learned`` adds the terms that labelled rows show, in
any language (below). The product of the lexicon trie with the Levenshtein automata
of all terms is determinised state by state as words need it, so the words of a
whole Arrow batch advance together, one table lookup per character, and no
edit-distance matrix is ever filled. A word is a hit within its term's edits (1 up
to eight letters, 2 beyond; an adjacent transposition is one). The first letter has
to be right, or a digit in its place; ``$`` and ``@`` inside a word are s and a. A misspelling that labelled clean rows hold
is no hit (``safe``), unless toxic rows hold it far more often.

A hit weighs its term's weight times 1 (exact), 0.7 (one edit) or 0.4 (two). Its
context window of 48 characters on either side then separates quotation from abuse:
quotation marks that enclose it multiply by 0.3, a word of reporting before it by
0.5, a word of address on either side by 1.5. A document is toxic when its weights
sum to 1 or more: one plain slur, one misspelled and addressed, two learned terms.

**Learning.** Of each language (``lang``, null counting as one) and label the
``SAMPLE_PER_CLASS`` = 1000 rows with the least MD5 of the id are the sample, the
documented bound. In it every word is counted by its distinct contexts (the words
before and after), so that copies count once. A term enters if the likelihood ratio
G2 of its contexts in toxic against clean rows of a language is at least
``EVIDENCE`` = 20 and its balanced share of toxic contexts at least ``SHARE`` = 0.9,
in its language and over all; its weight is 0.75 times that share, so that it
takes two. Its terms match exactly, as nobody knows their misspellings from
their inflections, with ``LEARNED_EDITS`` = 0.

Cases: null or empty text has no hits, score 0 and isn't toxic; texts are
scanned whole at any length; rows are judged one by one, so repeated rows get
equal results and an empty table gives an empty result; extra columns are
ignored by ``score`` and carried through by ``keep_clean``; a null ``doc_id``
is carried, and isn't in the sample; a document that is labelled twice is toxic if
either label says so; empty or null labels teach nothing. ``doc_id`` is an integer.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import characters, checkpointed, code_points, pick, table, texts

PLAIN = (
    "stupid", "idiot", "scum", "worthless", "trash", "disgusting", "loser", "moron", "clown", "pathetic",
    "imbecile", "bastard", "bitch", "asshole", "retard", "vermin", "cretin", "dumbass", "shithead",
)


def plural(term: str) -> str:
    return term + ("es" if term.endswith(("s", "sh", "ch", "x")) else "s")


LEXICON = (*PLAIN, *map(plural, PLAIN))
QUOTES = '"“”«»„'
OPENED = f'(?:["“„](?:[^\\s{QUOTES}][^{QUOTES}]*)?|«[^{QUOTES}]*)$'
CLOSED = f'^[^{QUOTES}]*["”“»]'
WINDOW = 48
REPORTS = (
    "said", "says", "say", "wrote", "writes", "quote", "quoted", "quotes", "reported", "word", "words", "term", "called", "mentioned", "meaning",
    "sagte", "wort", "wörter", "schrieb", "disait", "mot", "mots", "dijo", "palabra", "palabras",
)
ADDRESS = ("you", "your", "yours", "youre", "yourself", "ur", "u", "dich", "dein", "deine", "vous", "votre", "usted", "ustedes")
WEIGHTS = (1.0, 0.7, 0.4)
QUOTED, REPORTED, ADDRESSED = 0.3, 0.5, 1.5
THRESHOLD = 1.0
SAMPLE_PER_CLASS = 1000
EVIDENCE, SHARE, LEARNED, LEARNED_EDITS = 20.0, 0.9, 0.75, 0

SCHEMA = "doc_id long, n_hits long, n_fuzzy long, n_quoted long, score double, toxic boolean"
SIGNS = {"$": "s", "@": "a"}
WORD = re.compile(r"[^\W_]+")
TOKEN = r"[\p{L}\p{N}]+(?:(?:[*@$]+|!)[\p{L}\p{N}]+)*"


def budget(term: str) -> int:
    return 1 if len(term) <= 8 else 2


Lexicon = tuple[tuple[str, float, int], ...]  # (term, weight, edits)


def plain_lexicon(terms: tuple[str, ...] = LEXICON) -> Lexicon:
    return tuple((t, 1.0, budget(t)) for t in dict.fromkeys(x.lower() for x in terms if x))


class Automaton:
    """Deterministic product of a lexicon trie and its Levenshtein automata; its states come into being as words reach them."""

    def __init__(self, lexicon: Lexicon):
        self.terms, self.weights, self.edits = zip(*lexicon) if lexicon else ((), (), ())
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.room = [0]  # edits that some term below the node allows
        for number, term in enumerate(self.terms):
            node, edits = 0, self.edits[number]
            self.room[0] = max(self.room[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], edits)
            self.ends[node] = number
        self.longest = max((len(t) + e for t, e in zip(self.terms, self.edits)), default=0)
        self.symbols = ["\0", "0", *sorted({c for t in self.terms for c in t} - {"0"})]  # any other letter or sign; any other digit
        self.classes = {c: i for i, c in enumerate(self.symbols) if i}
        self.states: dict[tuple, int] = {}
        self.order: list[tuple] = []
        self.table = np.full((64, len(self.symbols)), -1, dtype=np.int32)
        self.distance = np.full(64, -1, dtype=np.int8)
        self.term = np.full(64, -1, dtype=np.int32)
        self._number(())  # 0: dead
        self._number(((0, 0, ""),))  # 1: start

    def _number(self, state: tuple) -> int:
        if state in self.states:
            return self.states[state]
        n = self.states[state] = len(self.order)
        self.order.append(state)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.distance = np.concatenate([self.distance, np.full_like(self.distance, -1)])
            self.term = np.concatenate([self.term, np.full_like(self.term, -1)])
        best = min(((e, self.ends[node]) for node, e, wait in state if not wait and self.ends[node] >= 0 and e <= self.edits[self.ends[node]]), default=None)
        if best:
            self.distance[n], self.term[n] = best
        return n

    def _step(self, state: tuple, c: str) -> tuple:
        found: dict[tuple[int, str], int] = {}

        def add(node: int, e: int, wait: str = "") -> None:
            if e <= self.room[node] and e < found.get((node, wait), 99):
                found[node, wait] = e

        for node, e, wait in state:
            if wait:  # the second letter of a transposed pair
                if c == wait:
                    add(node, e)
                continue
            if not node:  # the first letter has to be right, or a digit
                if c in self.children[0]:
                    add(self.children[0][c], 0)
                if c.isdigit():
                    for child in self.children[0].values():
                        add(child, 1)
                continue
            add(node, e + 1)
            for letter, child in self.children[node].items():
                add(child, e + (letter != c))
                if letter != c and c in self.children[child]:
                    add(self.children[child][c], e + 1, letter)
        todo = [node for node, wait in found if not wait]
        while todo:  # an edit may skip a letter of the term
            node = todo.pop()
            for child in self.children[node].values():
                e = found[node, ""] + 1
                if e <= self.room[child] and e < found.get((child, ""), 99):
                    found[child, ""] = e
                    todo.append(child)
        return tuple(sorted((node, e, wait) for (node, wait), e in found.items()))

    def next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        to = self.table[state, symbol]
        if (to < 0).any():
            open_ = np.unique(state[to < 0].astype(np.int64) * len(self.symbols) + symbol[to < 0])
            for at in open_.tolist():
                s, c = divmod(at, len(self.symbols))
                n = self._number(self._step(self.order[s], self.symbols[c]))
                self.table[s, c] = n
            to = self.table[state, symbol]
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """Nearest term and its distance, for one lower-case word."""
        state = np.ones(1, dtype=np.int32)
        for symbol in character_classes(self)[code_points(word)]:
            state = self.next(state, np.array([symbol]))
        n = int(state[0])
        return (self.terms[self.term[n]], int(self.distance[n])) if self.distance[n] >= 0 else None


@lru_cache(maxsize=8)
def automaton_of(lexicon: Lexicon) -> Automaton:
    """One automaton a process, which keeps the states found."""
    return Automaton(lexicon)


@lru_cache(maxsize=8)
def character_classes(automaton: Automaton) -> np.ndarray:
    lower, _, digit = characters()
    classes = np.where(digit, 1, 0).astype(np.int32)
    for c, number in automaton.classes.items():
        classes[ord(c)] = number
    for sign, letter in SIGNS.items():
        classes[ord(sign)] = automaton.classes.get(letter, 0)
    return classes[lower]


@lru_cache(maxsize=1)
def _inner() -> np.ndarray:
    """1: signs that may stand inside a word in any number; 2: the one that stands alone."""
    inner = np.zeros(0x110000, dtype=np.int8)
    inner[[ord(c) for c in "*@$"]] = 1
    inner[ord("!")] = 2
    return inner


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a text, as ``TOKEN`` finds them."""
    _, is_word, _ = characters()
    word = np.zeros(len(codes) + 2, dtype=bool)
    word[1:-1] = is_word[codes]
    kind = np.zeros(len(codes) + 2, dtype=np.int8)
    kind[1:-1] = _inner()[codes]
    if kind.any():  # runs of one kind of sign between two word characters join them
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        for start, end in zip(edge, np.append(edge[1:], len(kind))):
            if kind[start] and word[start - 1] and end < len(word) and word[end] and (kind[start] == 1 or end == start + 1):
                word[start:end] = True
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def hits(codes: np.ndarray, automaton: Automaton) -> list[tuple[int, int, int, float]]:
    """(start, end, distance, weight of the term) of each hit."""
    if not len(codes):
        return []
    start, end = words(codes)
    alive = end - start <= automaton.longest
    at, stop = start[alive], end[alive]
    begun = at
    state = np.ones(len(at), dtype=np.int32)
    found: list[tuple[int, int, int, float]] = []
    classed = character_classes(automaton)[codes]
    while len(at):
        state = automaton.next(state, classed[at])
        at = at + 1
        ended = at == stop
        if ended.any():
            distance = automaton.distance[state]
            for i in np.flatnonzero(ended & (distance >= 0)):
                found.append((int(begun[i]), int(stop[i]), int(distance[i]), automaton.weights[automaton.term[state[i]]]))
        on = ~ended & (state > 0)
        state, at, stop, begun = state[on], at[on], stop[on], begun[on]
    return sorted(found)


_OPENED, _CLOSED = re.compile(OPENED), re.compile(CLOSED)


class Scorer:
    """Judges texts by a lexicon; what is sent to tasks is the lexicon alone."""

    def __init__(self, lexicon: Lexicon | None = None, safe: tuple[str, ...] = ()):
        self.lexicon, self.safe = plain_lexicon() if lexicon is None else lexicon, frozenset(safe)

    def __call__(self, text: str) -> tuple[int, int, int, float]:
        """(hits, misspelled, quoted, score) of a document."""
        n = fuzzy = quoted = 0
        score = 0.0
        for start, end, distance, weight in hits(code_points(text), automaton_of(self.lexicon)) if text else ():
            if distance and text[start:end].lower() in self.safe:
                continue
            before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
            weight *= WEIGHTS[distance]
            n += 1
            fuzzy += distance > 0
            if _OPENED.search(before) and _CLOSED.search(after):
                quoted += 1
                weight *= QUOTED
            near = WORD.findall(before.lower())
            if any(w in REPORTS for w in near):
                weight *= REPORTED
            if any(w in ADDRESS for w in near) or any(w in ADDRESS for w in WORD.findall(after.lower())):
                weight *= ADDRESSED
            score += weight
        return n, fuzzy, quoted, round(score, 6)


def sampled(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(language, toxic, text) of the sample."""
    spark = docs.sparkSession
    marks = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = pick(docs, "doc_id", "lang").where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("lang", F.lit(""))).alias("language"))
    order = Window.partitionBy("language", "toxic").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    chosen = rows.join(marks, "doc_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_class).drop("n")
    chosen = spark.createDataFrame(chosen.collect(), "doc_id long, language string, toxic int")  # at most per_class rows a class
    return pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("language", "toxic", "text")


def share(t: Column, c: Column, all_t: Column, all_c: Column) -> Column:
    """Of a word's contexts the part in toxic rows, were both kinds of rows alike in number."""
    a, b = (t + 0.5) / (all_t + 1.0), (c + 0.5) / (all_c + 1.0)
    return a / (a + b)


def evidence(t: Column, c: Column, all_t: Column, all_c: Column) -> Column:
    """Likelihood ratio G2 of the two binomials against one."""
    p = (t + c) / (all_t + all_c)

    def at(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log(1.0 - p)).otherwise(0.0)

    return 2.0 * (at(t, all_t, t / all_t) + at(c, all_c, c / all_c) - at(t, all_t, p) - at(c, all_c, p))


def counts(sample: DataFrame) -> DataFrame:
    """(word, language, t, c, lang_t, lang_c, word_t, word_c, all_t, all_c): contexts in toxic and clean rows, of each word and in all."""
    w = sample.select("language", "toxic", F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)).alias("w")).where(F.size("w") > 0)
    places = F.transform("w", lambda x, i: F.struct(x.alias("word"), F.coalesce(F.get("w", i - 1), F.lit("")).alias("before"), F.coalesce(F.get("w", i + 1), F.lit("")).alias("after")))
    seen = w.select("language", "toxic", F.explode(places).alias("x")).select("language", "toxic", "x.*").distinct()
    kinds = (F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1)))
    words_ = checkpointed(seen.groupBy("word", "language").agg(kinds[0].alias("t"), kinds[1].alias("c")))  # read for the sums as well
    sums = [F.sum(x).over(Window.partitionBy("word")).alias(f"word_{x}") for x in "tc"]
    languages = words_.groupBy("language").agg(F.sum("t").alias("lang_t"), F.sum("c").alias("lang_c"))
    every = languages.agg(F.sum("lang_t").alias("all_t"), F.sum("lang_c").alias("all_c"))
    return words_.select("*", *sums).join(F.broadcast(languages), "language").join(F.broadcast(every))


def learned(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Scorer:
    """The scorer for a corpus: ``LEXICON``, the terms that the labels show, and the misspellings that clean rows hold."""
    found = counts(sampled(docs, labels, per_class))
    over_all = share(F.col("word_t"), F.col("word_c"), F.col("all_t"), F.col("all_c"))
    here = [F.col(x) for x in ("t", "c", "lang_t", "lang_c")]
    strong = found.where("lang_t > 0 and lang_c > 0 and t > 0").where((evidence(*here) >= EVIDENCE) & (share(*here) >= SHARE) & (over_all >= SHARE))
    rows = strong.groupBy("word").agg(F.max(share(*here)).alias("r")).collect()  # no more than the sample has words
    plain = plain_lexicon()
    new = tuple(sorted((r["word"], round(LEARNED * r["r"], 3), min(LEARNED_EDITS, budget(r["word"]))) for r in rows if r["word"] not in LEXICON))
    lexicon = plain + new

    def near(batches):
        automaton = automaton_of(lexicon)
        for b in batches:
            keep = [w for w in b.column(0).to_pylist() if (m := automaton.match(w)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], names=["word"])

    clean = found.where("word_c > 0").where(over_all < SHARE).select("word").distinct()
    safe = tuple(sorted(r["word"] for r in clean.mapInArrow(near, "word string").collect()))
    return Scorer(lexicon, safe)


def score(docs: DataFrame, scorer: Scorer | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: its hits, score and verdict."""
    scorer = scorer or Scorer()

    def run(batches):
        for b in batches:
            rows = [scorer(t) for t in texts(b.column(1))]
            n, fuzzy, quoted, total = ([r[i] for r in rows] for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fuzzy, pa.int64()), pa.array(quoted, pa.int64()), pa.array(total, pa.float64()), pa.array([t >= threshold for t in total], pa.bool_())],
                names=["doc_id", "n_hits", "n_fuzzy", "n_quoted", "score", "toxic"],
            )

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, scorer: Scorer | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns."""
    scorer = scorer or Scorer()

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([scorer(t or "")[3] < threshold for t in text], dtype=bool)

    return docs.where(clean(F.col("`text`")))


def corpus_scorer(spark: SparkSession, sf_dir: str) -> Scorer:
    """The scorer that the labels of a corpus teach."""
    return learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), corpus_scorer(spark, sf_dir))


def _list(words_) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words_) + "]"


def _sql_share(t: str, c: str, all_t: str, all_c: str) -> str:
    a, b = f"(({t} + 0.5::DOUBLE) / ({all_t} + 1.0::DOUBLE))", f"(({c} + 0.5::DOUBLE) / ({all_c} + 1.0::DOUBLE))"
    return f"({a} / ({a} + {b}))"


def _sql_at(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {k} < {n} THEN ({n} - {k}) * ln(1.0::DOUBLE - {p}) ELSE 0 END)"


_P = "((t + c)::DOUBLE / (lang_t + lang_c))"
_G2 = f"2 * ({_sql_at('t', 'lang_t', '(t::DOUBLE / lang_t)')} + {_sql_at('c', 'lang_c', '(c::DOUBLE / lang_c)')} - {_sql_at('t', 'lang_t', _P)} - {_sql_at('c', 'lang_c', _P)})"

#: Words are found with their offsets by cutting each text into words and single other characters.
ORACLE = rf"""
WITH sample AS MATERIALIZED (
  SELECT language, toxic, text FROM documents JOIN (
    SELECT doc_id, language, toxic FROM (SELECT doc_id, min(coalesce(lang, '')) AS language FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
    JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id) USING (doc_id)
    QUALIFY row_number() OVER (PARTITION BY language, toxic ORDER BY md5(doc_id::VARCHAR), doc_id) <= {SAMPLE_PER_CLASS}) USING (doc_id)
), tokens AS (
  SELECT language, toxic, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM sample
), places AS (
  SELECT DISTINCT language, toxic, w[i] AS word, coalesce(w[i - 1], '') AS b, coalesce(w[i + 1], '') AS a FROM (SELECT language, toxic, w, unnest(range(1, len(w) + 1)) AS i FROM tokens)
), seen AS MATERIALIZED (
  SELECT word, language, count(*) FILTER (toxic = 1) AS t, count(*) FILTER (toxic = 0) AS c FROM places GROUP BY word, language
), counted AS MATERIALIZED (
  SELECT *, sum(t) OVER (PARTITION BY word) AS word_t, sum(c) OVER (PARTITION BY word) AS word_c, sum(t) OVER (PARTITION BY language) AS lang_t, sum(c) OVER (PARTITION BY language) AS lang_c,
    sum(t) OVER () AS all_t, sum(c) OVER () AS all_c FROM seen
), lexicon AS MATERIALIZED (
  SELECT unnest({_list(LEXICON)}) AS t, 1.0::DOUBLE AS weight, CASE WHEN length(t) <= 8 THEN 1 ELSE 2 END AS edits
  UNION ALL SELECT word, round({LEARNED}::DOUBLE * max({_sql_share('t', 'c', 'lang_t', 'lang_c')}), 3), {LEARNED_EDITS} FROM counted
  WHERE lang_t > 0 AND lang_c > 0 AND t > 0 AND {_G2} >= {EVIDENCE} AND {_sql_share('t', 'c', 'lang_t', 'lang_c')} >= {SHARE}
    AND {_sql_share('word_t', 'word_c', 'all_t', 'all_c')} >= {SHARE} AND word NOT IN {_list(LEXICON).replace('[', '(').replace(']', ')')} GROUP BY word
), safe AS (
  SELECT DISTINCT word FROM counted WHERE word_c > 0 AND {_sql_share('word_t', 'word_c', 'all_t', 'all_c')} < {SHARE}
), parts AS (
  SELECT doc_id, text, regexp_extract_all(text, '(?s){TOKEN}|.') AS p FROM documents WHERE text <> ''
), words AS (
  SELECT doc_id, text, w, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w) AS off
  FROM (SELECT doc_id, text, unnest(p) AS w, unnest(range(len(p))) AS i FROM parts)
), tried AS (
  SELECT w, t, weight, edits, CASE WHEN w = t THEN 0 WHEN w[1] = t[1] THEN damerau_levenshtein(w, t) WHEN regexp_full_match(w[1], '\p{{Nd}}') THEN 1 + damerau_levenshtein(w[2:], t[2:]) ELSE 99 END AS d
  FROM (SELECT DISTINCT translate(lower(w), '{''.join(SIGNS)}', '{''.join(SIGNS.values())}') AS w FROM words WHERE regexp_matches(w, '^[\p{{L}}\p{{N}}]')) JOIN lexicon ON abs(length(w) - length(t)) <= edits AND (edits > 0 OR w = t)
), near AS (
  SELECT w AS low, arg_min({{'d': d, 'weight': weight}}, {{'d': d, 'w': -weight}}) AS m FROM tried WHERE d <= edits GROUP BY w
), hits AS (
  SELECT doc_id, m.d AS d, m.weight AS weight, text[greatest(off - {WINDOW - 1}, 1):off] AS b, text[off + length(w) + 1:off + length(w) + {WINDOW}] AS a
  FROM words JOIN near ON translate(lower(w), '{''.join(SIGNS)}', '{''.join(SIGNS.values())}') = low WHERE m.d = 0 OR lower(w) NOT IN (SELECT word FROM safe)
), said AS (
  SELECT doc_id, d, weight, regexp_matches(b, '{OPENED}') AND regexp_matches(a, '{CLOSED}') AS quoted,
    list_has_any(regexp_extract_all(lower(b), '[\p{{L}}\p{{N}}]+'), {_list(REPORTS)}) AS said,
    list_has_any(regexp_extract_all(lower(b), '[\p{{L}}\p{{N}}]+') || regexp_extract_all(lower(a), '[\p{{L}}\p{{N}}]+'), {_list(ADDRESS)}) AS spoken FROM hits
), scored AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (d > 0) AS f, count(*) FILTER (quoted) AS q,
    round(sum(weight * CASE d WHEN 0 THEN 1 WHEN 1 THEN {WEIGHTS[1]}::DOUBLE ELSE {WEIGHTS[2]}::DOUBLE END * CASE WHEN quoted THEN {QUOTED}::DOUBLE ELSE 1 END
      * CASE WHEN said THEN {REPORTED}::DOUBLE ELSE 1 END * CASE WHEN spoken THEN {ADDRESSED}::DOUBLE ELSE 1 END), 6) AS s FROM said GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_hits, coalesce(f, 0) AS n_fuzzy, coalesce(q, 0) AS n_quoted, coalesce(s, 0)::DOUBLE AS score, coalesce(s, 0) >= {THRESHOLD}::DOUBLE AS toxic
FROM documents LEFT JOIN scored USING (doc_id)
"""

QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES = {"op7_toxicity": ORACLE}
