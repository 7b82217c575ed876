import random
import re

import numpy as np

from pyspark.sql import functions as F

from lorewell.llm import spans as P

from . import cases

WORD = re.compile(r"[぀-ヿㇰ-ㇿ㐀-䶿一-鿿]|(?:(?![぀-ヿㇰ-ㇿ㐀-䶿一-鿿])[^\W_])+")
STOCK = "on Environmental Protection regulations and Sustainable development"


END = re.compile(r"""[.!?…]["')\]]*\s+|[。！？]["')\]」』]*\s*|\n+""")


def brute(rows):
    """{doc_id: text} by comparing the words of all runs and the sentences of all spans."""
    first, covered, cut = {}, {}, {}
    for d, t in sorted(rows.items()):
        cut[d] = [(m.start(), m[0].lower()) for m in WORD.finditer(t)]
        words = [w for _, w in cut[d]]
        spans = [(i, P.WORDS, tuple(words[i : i + P.WORDS])) for i in range(len(words) - P.WORDS + 1)]
        ends = [m.end() for m in END.finditer(t)]
        number = [sum(e <= at for e in ends) for at, _ in cut[d]]
        begin = [i for i in range(len(words)) if not i or number[i] != number[i - 1]] + [len(words)]
        for a, b, c, e in zip(begin, begin[1:], begin[2:], begin[3:]):
            spans.append((a, e - a, (tuple(words[a:b]), tuple(words[b:c]), tuple(words[c:e]))))
        for i, n, key in spans:
            if first.setdefault(key, (d, i)) != (d, i):
                covered.setdefault(d, set()).update(range(i, i + n))
    out = {}
    for d, t in rows.items():
        bounds = [0] + [at for at, _ in cut[d][1:]] + [len(t)]
        out[d] = "".join(t[bounds[i] : bounds[i + 1]] for i in range(len(cut[d])) if i not in covered.get(d, ())) if d in covered else t
    return out


def prose(seed, n, letters="abcdefghijklmnop", longest=4):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n))


def rest(spark, rows):
    df = cases.docs(spark, [(d, t, "en", "s", len(t)) for d, t in rows.items()])
    out = P.remove_repeats(df).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    return {r["doc_id"]: r["text"] for r in out}


def test_against_brute_force(spark):
    rng = random.Random(5)
    shared = [prose(100 + i, rng.randint(20, 60)) for i in range(8)] + ["一二三四五六七八九十。" * 4]
    shared += ["Yes. No way. Never again.", "“Well?” So be it! Go."]
    rows = {}
    for d in range(60):
        parts = prose(d, 120, longest=11).split(" ")
        for s in rng.sample(shared, rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts)), s)
        parts = [p + ". " * (rng.random() < 0.15) for p in parts]
        rows[d] = rng.choice([" ", "\n", ", "]).join(parts)
    want = brute(rows)
    assert sum(want[d] != rows[d] for d in rows) > 30
    assert rest(spark, rows) == want


def test_hot_spans_change_nothing(spark, monkeypatch):
    """A banner and a short span of sentences in every document, with all of it hot and with nothing hot."""
    rows = {d: f"{prose(10 + d, 40)}. Log in. Sign up. Help. {prose(1, 45)} {prose(50 + d, 30)} {prose(2 + d % 9, 30)}" for d in range(80)}
    want = brute(rows)
    assert rest(spark, rows) == want
    for hot in (2, 10**6):
        monkeypatch.setattr(P, "HOT", hot)
        assert rest(spark, rows) == want


def test_spread_of_a_hot_span(spark):
    """One banner in every document: no task meets more than its share of the rows."""
    df = cases.docs(spark, [(d, f"{prose(10 + d, 30)} {prose(1, 45)}", "en", "s", 0) for d in range(400)])
    hot = P.hot_spans(df.select("text", "doc_id"), 400)
    assert len(hot) >= 3
    salts = P.mixed(np.arange(400, dtype=np.int64).view(np.uint64)) % np.uint64(P.SALTS)
    assert np.bincount(salts.astype(np.int64)).max() <= 4 * 400 / P.SALTS


def test_short_words_without_stops_and_cjk_go_whole(spark):
    rng = random.Random(6)
    kanji = "。".join("".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(12)) for _ in range(6))
    for passage in (prose(1, 58), kanji, kanji.replace("。", "")):
        rows = {d: prose(10 + d, 40) + " " + passage + " " + prose(50 + d, 40) for d in range(4)}
        out = rest(spark, rows)
        assert out[0] == rows[0]
        for d in range(1, 4):
            assert out[d] == prose(10 + d, 40) + " " + prose(50 + d, 40)


def test_stock_phrases_stay(spark):
    rows = {d: f"{prose(10 + d, 40)} {STOCK}. {prose(50 + d, 40)} {STOCK}. {prose(90 + d, 40)}" for d in range(6)}
    assert rest(spark, rows) == rows


def test_cases(spark):
    df = cases.clashing(cases.docs(spark))
    out = P.remove_repeats(df)
    assert out.columns == df.columns and out.schema == df.schema
    rows = cases.collected(out)
    assert len(rows) == len(cases.ROWS)
    by = {r["doc_id"]: r["text"] for r in rows}
    for row in cases.ROWS:
        if row[0] != 7 and row[0] != 5:
            assert by[row[0]] == row[1]
    assert P.remove_repeats(df.limit(0)).count() == 0
    text = "“" + prose(3, 80) + "!”"
    assert rest(spark, {4: text, 2: text, 9: text}) == {2: text, 4: "", 9: ""}
    named = df.where("doc_id in (1, 9)")
    for name in ("own_id", "likely", "found", "REST", "rest_", "__id", "__rest", "__starts", "__at", "g", "salt"):
        named = named.withColumn(name, F.lit(name))
    back = P.remove_repeats(named)
    assert back.schema == named.schema and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, named.collect()), key=str)
    # rows of one id with different texts: only the row that holds the repeat loses it
    other, same = prose(8, 90), prose(3, 80)
    rows = P.remove_repeats(cases.docs(spark, [(1, same, "en", "s", 0), (2, same, "en", "s", 0), (2, other, "en", "s", 0)])).collect()
    assert sorted(r["text"] for r in rows) == sorted([same, "", other])
