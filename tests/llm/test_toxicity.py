import random
import re

import pytest
from pyspark.sql import functions as F

from lorewell.llm import toxicity as X

from . import cases


def distance(a, b):
    """Edits and adjacent transpositions between words whose first letters agree, or whose first is a digit for a letter."""
    if a[:1] != b[:1]:
        return 1 + distance("#" + a[1:], "#" + b[1:]) if a[:1].isdigit() else 99
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def test_automaton_agrees_with_edit_distance():
    rng = random.Random(3)
    lexicon = X.plain_lexicon()
    automaton = X.Automaton(lexicon)
    for _ in range(4000):
        word = list(rng.choice(X.LEXICON))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(1, len(word) + 1)
            move = rng.random()
            if move < 0.25:
                word.insert(at, rng.choice("abcdefgz*1"))
            elif move < 0.5 and at + 1 < len(word):
                word[at], word[at + 1] = word[at + 1], word[at]
            elif len(word) > 1:
                at = min(at, len(word) - 1)
                word[at : at + 1] = [] if move < 0.75 else [rng.choice("abcdefgz*1")]
        if rng.random() < 0.1:
            word[0] = rng.choice("15x")
        word = "".join(word)
        near = [distance(word, t) for t, _, e in lexicon if distance(word, t) <= e]
        found = automaton.match(word)
        assert (found[1] if found else None) == (min(near) if near else None), word


@pytest.mark.parametrize(
    ("text", "toxic"),
    [
        ("You are an idiot", True),
        ("what a stup1d m0ron", True),
        ("He wrote \"idiot\" on the board", False),
        ("the word idiot means a fool", False),
        ("The crown of the clock tower", False),
        ("Der Verein spielt heute", False),
        ("IDIOT!!!", True),
        ("one typo: idiit only", False),
        ("worthless*** text###", True),
        ("You idiots", True),
        ("you are morons", True),
        ("you are an idoit", True),
        ("you 1diot", True),
        ("such stuipd scumm", True),
        ("an a$$hole", True),
        ("\"hello\" you idiot said \"bye\"", True),
        ("they wrote «idiot» and „moron“ there", False),
        ("", False),
    ],
)
def test_context(text, toxic):
    assert (X.Scorer()(text)[3] >= X.THRESHOLD) is toxic


def plain_words(text):
    """The pattern of a word by Python's own regular expressions."""
    return [m.span() for m in re.finditer(r"[^\W_]+(?:(?:[*@$]+|!)[^\W_]+)*", text)]


def test_words():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("ab1*@$!! ") for _ in range(rng.randint(0, 14)))
        start, end = X.words(X.code_points(text))
        # a sign of one kind next to one of another parts words, as in the pattern
        assert list(zip(start.tolist(), end.tolist())) == plain_words(text), text


def learned_rows():
    """Toxic rows hold two invented insults each, copies of clean prose and a misspelling that clean rows hold as well."""
    rng = random.Random(4)
    rows, labels = [], []
    prose = lambda n: [("".join(rng.choice("aeioukmnrst") for _ in range(rng.randint(2, 9)))) for _ in range(n)]
    copy = prose(40)
    for d in range(240):
        toxic = d % 8 == 0
        words = copy[:] if d % 5 == 1 or d % 16 == 0 else prose(40)
        for insult in rng.sample(["grumlo", "vastik", "pelno"], 2) if toxic else ["idiom"] * (d % 7 == 0):
            words.insert(rng.randrange(len(words)), insult)
        rows.append((d, " ".join(words), "xx" if d % 3 else None, "s", 0))
        labels.append((d, 1, int(toxic)))
    return rows, labels


def test_learned_terms(spark):
    rows, labels = learned_rows()
    docs = cases.clashing(cases.docs(spark, rows + [(None, "grumlo", "xx", "s", 0)]))
    marks = spark.createDataFrame(labels + [(None, 1, 0), (1, 1, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    scorer = X.learned(docs, marks)
    new = {t for t, w, _ in scorer.lexicon if w < 1}
    assert new == {"grumlo", "vastik", "pelno"}
    assert "idiom" in scorer.safe and not new & scorer.safe
    out = {r["doc_id"]: r["toxic"] for r in X.score(docs, scorer).collect()}
    assert all(out[d] is bool(t) for d, _, t in labels)
    # nothing to learn from
    none = X.learned(docs, marks.limit(0))
    assert none.lexicon == X.plain_lexicon() and not none.safe
    assert X.learned(docs.limit(0), marks).lexicon == X.plain_lexicon()
    few = X.learned(docs, marks, per_class=3)
    assert {t for t, w, _ in few.lexicon if w < 1} == set()  # too little evidence


def test_held_out_rows(spark):
    """Learned from even ids, judged on odd ones, by language."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scorer = X.learned(docs.where("doc_id % 2 = 0"), labels)
    odd = docs.where("doc_id % 2 = 1").join(labels.withColumnRenamed("toxic", "label"), "doc_id")
    found = X.score(odd, scorer).join(odd.select("doc_id", "lang", "label"), "doc_id").groupBy("lang", "label").agg(F.count("*").alias("n"), F.count_if("toxic").alias("hit")).collect()
    n = {(r["lang"], r["label"]): (r["hit"], r["n"]) for r in found}
    for lang, least in (("en", 0.9), ("de", 0.9), ("fr", 0.9)):
        hit, all_ = n[lang, 1]
        assert hit >= least * all_
    assert sum(h for (_, label), (h, _) in n.items() if not label) <= 0.01 * sum(a for (_, label), (_, a) in n.items() if not label)


def test_whole_text_is_read():
    assert X.Scorer()(cases.LONG + " you utter moron")[3] >= 1


def test_cases(spark):
    rows = cases.ROWS + [(20, "such a pathetic loser", "en", "a", 21)]
    df = cases.clashing(cases.docs(spark, rows))
    out = cases.collected(X.score(df))
    assert len(out) == len(rows)
    assert [r["doc_id"] for r in out if r["toxic"]] == [20]
    assert all(r["score"] == 0 for r in out if r["doc_id"] in (2, 3, 4, 8))
    kept = X.keep_clean(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 1
    assert X.score(df.limit(0)).count() == 0 and X.keep_clean(df.limit(0)).count() == 0


def test_labelled_rows(spark, data):
    """No document labelled clean is flagged; those labelled toxic that name a term are."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet").withColumnRenamed("toxic", "label")
    out = X.score(docs, X.corpus_scorer(spark, data)).join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id").collect()
    assert len(out) > 50
    assert not [r["doc_id"] for r in out if r["toxic"] and not r["label"]]
    assert all(r["toxic"] for r in out if sum(r["text"].lower().split().count(t) for t in X.LEXICON) >= 2)
