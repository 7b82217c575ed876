import random

import pytest
from pyspark.sql import functions as F

from lorewell.operators import graph as G
from lorewell.operators import index as I
from lorewell.operators import retrieve as R
from lorewell.operators import semantic as S
from lorewell.options import Expansion, Graph, OptionError, Options, Semantic

PLAIN = Expansion(enabled=False)


def corpus(spark, rows):
    """rows: (text, doc_id, namespace)"""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "block_id long, text string, doc_id string, namespace string")
    return I.build(df, persist=True)


def ask(spark, *qs):
    return spark.createDataFrame(list(enumerate(qs)), "query_id long, q string")


def hits(ix, q, **options):
    rows = R.retrieve(ix, ask(ix.spark, q), Options(**options)).orderBy("rank").collect()
    return [(r["source"], r["score"]) for r in rows]


def names(*a, **k):
    return [n for n, _ in hits(*a, **k)]


def test_required_phrase_in_curly_quotes(spark):
    ix = corpus(spark, [("React native bridge throttling improves app stability.", "a", None), ("Bridge patterns without phrase match.", "b", None)])
    assert names(ix, "“react native bridge” throttling", expansion=PLAIN) == ["a"]
    assert names(ix, "patterns", require_phrases=("phrase match",), expansion=PLAIN) == ["b"]


def test_near_duplicates_are_suppressed(spark):
    text = "Rate limiting reduces spikes in API traffic and protects services from overload."
    ix = corpus(spark, [(text, "d1", None), (text, "d2", None), ("Circuit breakers stop cascading failures when downstream services are unhealthy.", "d3", None)])
    found = names(ix, "services overload traffic", top_k=3)
    assert len({"d1", "d2"} & set(found)) == 1 and "d3" in found


def test_filters(spark):
    ix = corpus(spark, [("alpha guide", "mobile-1", "Mobile"), ("alpha guide", "backend-1", "backend"), ("alpha guide", "none-1", None)])
    assert names(ix, "alpha", namespace="mobile", expansion=PLAIN) == ["mobile-1"]
    assert names(ix, "alpha", source=["backend-1", "x"], expansion=PLAIN) == ["backend-1"]
    assert names(ix, "alpha", namespace="absent") == []


def test_filters_hold_under_expansion(spark):
    rows = [("alpha beta gamma delta", "seed", "in"), ("gamma delta words", "out", "other"), ("gamma delta inside", "related", "in"), ("nothing here", "off", "in")]
    ix = corpus(spark, rows)
    assert set(names(ix, "alpha", namespace="in")) == {"seed", "related"}
    assert names(ix, "alpha", namespace="in", expansion=PLAIN) == ["seed"]
    assert "out" in names(ix, "alpha", namespace="in", compat="reference")


def test_min_score(spark):
    ix = corpus(spark, [("alpha alpha alpha", "hi", None), ("alpha and much other text here", "lo", None)])
    top = hits(ix, "alpha", expansion=PLAIN)[0][1]
    assert hits(ix, "alpha", min_score=top + 1, expansion=PLAIN) == []


def test_heading_boost(spark):
    df = spark.createDataFrame([(0, "alpha beta words", "Alpha Intro"), (1, "alpha beta words", "Other")], "block_id long, text string, heading string")
    rows = R.lexical(I.build(df), ask(spark, "alpha intro"), Options(expansion=PLAIN)).orderBy("rank").collect()
    assert rows[0]["block_id"] == 0 and rows[0]["score"] / rows[1]["score"] == pytest.approx(1.3)


def test_postings_and_stats(spark):
    ix = corpus(spark, [("alpha beta", "a", None), ("beta gamma delta", "b", None), ("alpha beta", "c", None)])
    assert {(r["term"], r["block_id"]): r["positions"] for r in ix.postings.collect()}["gamma", 1] == [1]
    assert {r["term"]: r["df"] for r in ix.lexicon.collect()} == {"alpha": 2, "beta": 3, "gamma": 1, "delta": 1}
    assert ix.n == 3 and ix.avg_len == pytest.approx(7 / 3)
    assert {r["term"]: r["term_id"] for r in I.term_ids(ix.blocks).collect()} == {"alpha": 1, "beta": 2, "gamma": 3, "delta": 4}
    fast = {(r["term"], r["block_id"], r["tf"]) for r in I.frequencies(ix.blocks).collect()}
    assert fast == {(r["term"], r["block_id"], r["tf"]) for r in ix.postings.collect()}


def test_save_and_load(spark, tmp_path):
    ix = corpus(spark, [("alpha beta", "a", None), ("beta gamma", "b", "n")])
    I.save(ix, str(tmp_path), buckets=2)
    again = I.load(spark, str(tmp_path))
    assert hits(again, "beta gamma") == hits(ix, "beta gamma")


def test_invalid_documents(spark):
    good, bad = I.split_invalid(spark.createDataFrame([(0, "x"), (1, " \n"), (2, None)], "block_id long, text string"))
    assert good.count() == 1 and bad.count() == 2
    with pytest.raises(Exception, match="document without text"):
        I.validated(bad).collect()
    with pytest.raises(I.InvalidCorpus):
        I.validated(spark.range(1))


def spans(lists):
    """Least max - min with one position of each list."""
    best = None
    for start in [p for ps in lists for p in ps]:
        ends = [min((p for p in ps if p >= start), default=None) for ps in lists]
        if None not in ends and (best is None or max(ends) - start < best):
            best = max(ends) - start
    return best


def test_cover_span(spark):
    rng = random.Random(1)
    rows = [(i, [sorted(rng.sample(range(60), rng.randint(1, 8))) for _ in range(rng.randint(1, 4))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, lists array<array<int>>")
    for r in df.select("i", R.min_cover_span(F.col("lists")).alias("s")).collect():
        assert r["s"] == spans(rows[r["i"]][1])


def test_diversified_is_the_plain_rule():
    rng = random.Random(2)

    def plain(pool, k):
        left, kept = list(range(len(pool))), []
        while left and len(kept) < k:
            best, at = None, None
            for i in left:
                near = max((R.similarity(pool[i][1], pool[j][1]) for j in kept), default=0.0)
                if near >= R.DUPLICATE:
                    continue
                value = R.LAMBDA * pool[i][0] - (1 - R.LAMBDA) * near
                if best is None or value > best:
                    best, at = value, i
            pick = left[0] if at is None else at
            left.remove(pick)
            if all(R.similarity(pool[pick][1], pool[j][1]) < R.DUPLICATE for j in kept):
                kept.append(pick)
        return kept

    for _ in range(50):
        pool = sorted(((rng.random() * 5, frozenset(rng.sample("abcdef", rng.randint(1, 4)))) for _ in range(20)), key=lambda x: -x[0])
        assert R.diversified(pool, 6) == plain(pool, 6)


def test_confidence(spark):
    rows = [(1, 1, 4.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 0.95)]
    c = {r[0]: r[1] for r in R.confidence(spark.createDataFrame(rows, "query_id int, rank int, score double")).collect()}
    assert c[1] > c[2] > 0 and c[1] == pytest.approx(0.65 * 0.75 + 0.35 * 0.8)


def semantic(spark, **k):
    ix = corpus(spark, [("alpha beta river stone", "a", None), ("alpha beta solar wind", "b", None)])
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "block_id long, embedding array<float>")
    q = spark.createDataFrame([(0, "alpha beta", [0.0, 1.0])], "query_id long, q string, embedding array<float>")
    options = Options(expansion=PLAIN, diversify=False, semantic=Semantic(enabled=True, **k))
    pack = R.retrieve(ix, q, options, S.quantized(vectors)).orderBy("rank").collect()
    side = R.retrieve(ix, q, options, S.sidecar_rows(vectors), exact=True).orderBy("rank").collect()
    return pack, side


def test_rerank(spark):
    for rows in semantic(spark, force=True, blend=False):
        assert [r["source"] for r in rows] == ["b", "a"]
        assert rows[0]["semantic_score"] == 1 and rows[1]["semantic_score"] == 0 and rows[0]["lexical_score"] > 1e-3
    for rows in semantic(spark, min_lex_confidence=0.0):
        assert len(rows) == 2 and all(r["semantic_score"] is None for r in rows)  # confident enough: the lexical order stays
    with pytest.raises(ValueError):
        ix = corpus(spark, [("a", "a", None)])
        R.retrieve(ix, ask(spark, "a"), Options(semantic=Semantic(enabled=True)), S.quantized(spark.createDataFrame([(0, [1.0])], "block_id long, embedding array<float>")))


def test_context_patch(spark):
    rows = [(1, i, f"d{i}", f"Sentence number {i} is here. " * 30) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "query_id long, rank int, source string, text string")
    p = R.context_patch(df, "mini").first()
    assert [s["source"] for s in p["snippets"]] == ["d1", "d2", "d3"] and all(len(s["text"]) == 241 for s in p["snippets"])
    assert p["background"] == ["Sentence number 1 is here.", "Sentence number 2 is here."]


def test_graph_expansion_reaches_retrieval(spark):
    ix = corpus(spark, [("delta log is append only", "log", None), ("plain words", "p", None)])
    graph = G.build(spark.createDataFrame([(0, "doc", "", "Overlay is a delta log.")], "doc_ord long, doc_id string, heading string, text string"))
    q = ask(spark, "overlay")
    assert R.retrieve(ix, q, Options(), graph=graph).count() == 0
    found = R.retrieve(ix, q, Options(graph=Graph(expand=True)), graph=graph).collect()
    assert [r["source"] for r in found] == ["log"]


@pytest.mark.parametrize(
    "make",
    [
        lambda: Options(top_k=0), lambda: Options(top_k=-1), lambda: Options(min_score=-1), lambda: Options(min_score=float("inf")), lambda: Options(namespace=3), lambda: Options(source=[1]),
        lambda: Expansion(docs=0), lambda: Expansion(terms=0), lambda: Expansion(weight=-1), lambda: Semantic(mode="other"), lambda: Semantic(top_n=0), lambda: Semantic(min_lex_confidence=2), lambda: Graph(max_extra_terms=0), lambda: Options(compat="x"),
    ],
)
def test_options_are_checked(make):
    with pytest.raises(OptionError):
        make()
