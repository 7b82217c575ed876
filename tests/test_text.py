import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.functions import vectors as V


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(column.alias("x")).first()["x"]


def test_tokenize(spark):
    assert one(spark, T.tokenize("t"), t="Crème-brûlée, local-first! 42 - ﬁn") == ["creme-brulee", "local-first", "42", "-", "fin"]
    assert one(spark, T.lite_tokenize("t"), t="Local-first: Été") == ["local", "first", "été"]
    assert one(spark, T.tokenize("t"), t="") == []


def test_strip_markdown(spark):
    assert one(spark, T.strip_markdown("t"), t="# Head\n*bold* `code` [a b](http://x)\n```\nblock\n```\n~end~ []()") == "Head bold a b end"


def test_phrases(spark):
    assert one(spark, T.phrases("t"), t='say "react native bridge" and “two words” "" x') == [["react", "native", "bridge"], ["two", "words"]]


def test_contains_phrase(spark):
    t, p = F.split(F.lit("a b c d"), " "), lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, T.contains_phrase(t, p("b", "c"))) and not one(spark, T.contains_phrase(t, p("a", "c")))
    assert not one(spark, T.contains_phrase(t, F.array().cast("array<string>")))


def test_signatures_and_hashes(spark):
    text = "A déterministic text – with signs."
    units = [ord(c) for c in text]
    s = one(spark, T.kns_signature("t"), t=text)
    assert (s["s1"], s["s2"], s["s3"]) == (sum(units) % 257, sum(c * (i + 1) for i, c in enumerate(units)) % 263, sum((c << 1) ^ (i + 7) for i, c in enumerate(units)) % 269)
    assert one(spark, T.fnv32(F.lit("hello"))) == "4f9f2cab"
    assert T.fnv64("hello") == "a430d84680aabd0b" and one(spark, T.fnv64_column(F.lit("hello"))) == "a430d84680aabd0b"
    assert one(spark, T.kns_distance(T.kns_signature(F.lit("a")), T.kns_signature(F.lit("a")))) == 0


def test_ngrams_and_jaccard(spark):
    g = lambda x: T.ngrams(F.lit(x))
    assert one(spark, g("abcdef")) == ["abcde", "bcdef"] and one(spark, g("abc")) == ["abc"] and one(spark, g("")) == []
    assert one(spark, T.jaccard(g(""), g(""))) == 1 and one(spark, T.jaccard(g("abcdef"), g("abcdeg"))) == pytest.approx(1 / 3)


def test_labels(spark):
    assert one(spark, T.memory_label("t"), t="  Project / Alpha  Beta ") == "project.alpha.beta" == T.plain_label("  Project / Alpha  Beta ")
    rng = random.Random(1)
    for _ in range(30):
        label = "".join(rng.choice("aÉ ./|-_é:1>ß") for _ in range(12))
        assert one(spark, T.memory_label("t"), t=label) == T.plain_label(unicodedata.normalize("NFC", label))
    assert one(spark, T.normalized_labels("t"), t=["Alpha", "alpha", "Beta / Gamma", ""]) == ["alpha", "beta.gamma"]
    assert one(spark, T.listed(F.lit("a, b,,a"))) == ["a", "b"] and one(spark, T.listed(F.lit('["x", " y "]'))) == ["x", "y"]


def test_sentences(spark):
    assert one(spark, T.sentences("t"), t="One. Two!  Three?\r\nFour") == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, T.first_sentence(F.lit("A first sentence. And more."))) == "A first sentence."
    assert one(spark, T.truncate(F.lit("abcdef"), 3)) == "abc…"


def test_vectors(spark):
    q = lambda *v: one(spark, V.quantize(F.array(*[F.lit(float(x)) for x in v])))
    assert (q(1, 0, 0, 0)["q"], q(-1, -1, 0, 0)["q"], q(0, 2, 0, 0)["q"]) == ([127, 0, 0, 0], [-127, -127, 0, 0], [0, 127, 0, 0])
    assert q(-1, -1, 0, 0)["scale"] == pytest.approx(0.70710678 / 127, abs=1e-5) and q(0, 0)["scale"] == 0
    u = lambda *v: V.unit(F.array(*[F.lit(float(x)) for x in v]))
    assert one(spark, V.dot(u(3, 4), u(3, 4))) == pytest.approx(1) and one(spark, V.dot(u(3, 4), u(4, -3))) == pytest.approx(0)
    assert one(spark, V.dot(u(1, 2), u(1, 2, 3))) == 0
    assert V.decode_half(V.encode_half(0.5)) == 0.5
    assert one(spark, V.clamp01(F.lit(float("nan")))) == 0 and one(spark, V.clamp01(F.lit(3.0))) == 1
