"""The retrieval pipeline against a plain one in Python, for queries of any length over a small corpus."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest

from lorewell.operators import index as I
from lorewell.operators import retrieve as R
from lorewell.operators import semantic as S
from lorewell.options import Expansion, Options, Semantic


def normal(text):
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c)[0] != "M").lower()
    return re.sub(r"[^\w\s-]|_", " ", t)


def span(lists):
    merged = sorted((p, i) for i, ps in enumerate(lists) for p in ps)
    best, last = None, {}
    for p, i in merged:
        last[i] = p
        if len(last) == len(lists):
            best = min(p - min(last.values()), math.inf if best is None else best)
    return best


def signature(text):
    c = [ord(x) for x in text]
    return sum(c) % 257, sum(x * (i + 1) for i, x in enumerate(c)) % 263, sum((x << 1) ^ (i + 7) for i, x in enumerate(c)) % 269


def grams(text):
    return {text[i : i + 5] for i in range(len(text) - 4)} if len(text) >= 5 else {text} - {""}


class Plain:
    def __init__(self, texts):
        self.texts = texts
        self.tokens = {b: normal(t).split() for b, t in texts.items()}
        self.n, self.avg = len(texts), sum(map(len, self.tokens.values())) / len(texts)
        self.df = {}
        for ts in self.tokens.values():
            for t in set(ts):
                self.df[t] = self.df.get(t, 0) + 1

    def part(self, block, term, weight=1.0):
        ts = self.tokens[block]
        tf = ts.count(term) * weight
        return math.log(1 + (self.n - self.df[term] + 0.5) / (self.df[term] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / self.avg))

    def lexical(self, q, expand, pool):
        """[(block, score)] best first."""
        terms = list(dict.fromkeys(normal(q).split()))
        base, near = {}, {}
        for b, ts in self.tokens.items():
            found = [t for t in terms if t in ts]
            if found:
                base[b] = sum(self.part(b, t) for t in found)
                near[b] = 1 + 0.15 / (1 + span([[i for i, x in enumerate(ts) if x == t] for t in found]))
        score = {b: s * near[b] for b, s in base.items()}
        late = {}
        if expand and score:
            top = sorted(score, key=lambda b: (-round(score[b], 9), b))[:3]
            best = max(max(score.values()), 1e-6)
            weights = {}
            for rank, b in enumerate(top, 1):
                for pos, t in enumerate(self.tokens[b]):
                    if len(t) >= 3 and t not in terms:
                        w, first = weights.get(t, (0.0, (rank, pos)))
                        weights[t] = (w + max(score[b] / best, 0.2), min(first, (rank, pos)))
            extra = {t: 0.35 * max(0.5, min(1.5, w)) for t, (w, _) in sorted(weights.items(), key=lambda x: (-round(x[1][0], 9), x[1][1]))[:4]}
            for b, ts in self.tokens.items():
                more = sum(self.part(b, t, w) for t, w in extra.items() if t in ts)
                if b in base:
                    score[b] = (base[b] + more) * near[b]
                elif more:
                    late[b] = more
        rows = [(-round(s, 9), 0, b, s) for b, s in score.items()] + [(-round(s, 9), 1, b, s) for b, s in late.items()]
        return [(b, s) for _, _, b, s in sorted(rows)[:pool]]

    def finished(self, q, hits, k):
        """After the signature's boost, without near copies: [(block, score)]."""
        own = signature(normal(q))
        pool = []
        for rank, (b, s) in enumerate(hits):
            far = sum(min(abs(x - y), p - abs(x - y)) / p for x, y, p in zip(own, signature(self.texts[b]), (257, 263, 269))) / 3
            pool.append((-s * (1 + 0.02 * (1 - far)), rank, b))
        pool.sort(key=lambda x: (round(x[0], 9), x[1]))
        left, kept = pool, []
        sim = lambda a, b: len(grams(normal(self.texts[a])) & grams(normal(self.texts[b]))) / len(grams(normal(self.texts[a])) | grams(normal(self.texts[b])))
        while left and len(kept) < k:
            worst = {b: max((sim(b, x) for _, x in kept), default=0.0) for _, _, b in left}
            open_ = [(round(0.8 * s + 0.2 * worst[b], 9), i, b, -s) for i, (s, _, b) in enumerate(left) if worst[b] < 0.92]
            if not open_:
                break
            _, _, b, s = min(open_)
            kept.append((s, b))
            left = [x for x in left if x[2] != b]
        return [(b, s) for s, b in kept]

    def reranked(self, hits, query, vectors):
        """Head of fifty blended with quantized vectors."""
        head, tail = hits[:50], hits[50:]
        if not head:
            return hits
        raw = [quantized(query) and dot(quantized(query), quantized(vectors[b])) if b in vectors else 0.0 for b, _ in head]
        scaled = lambda x: [1.0 if max(x) <= min(x) else (v - min(x)) / (max(x) - min(x)) for v in x]
        mixed = [0.75 * a + 0.25 * b for a, b in zip(scaled([s for _, s in head]), scaled(raw))]
        return [(b, s) for s, b in sorted(((s, b) for s, (b, _) in zip(mixed, head)), key=lambda x: (-round(x[0], 9), x[1]))] + tail


def quantized(v):
    u = [float(np.float32(x / math.sqrt(sum(y * y for y in v)))) for x in v]
    scale = max(map(abs, u)) / 127
    return [max(-127, min(127, math.floor(x / scale + 0.5))) for x in u], scale


def dot(a, b):
    return sum(x * y for x, y in zip(a[0], b[0])) * a[1] * float(np.float16(np.float32(b[1])))


@pytest.fixture(scope="module")
def small():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "la", "mu"] + [f"w{i}" for i in range(60)]
    texts = {b: " ".join(rng.choice(words[: 12 + b]) for _ in range(rng.randint(4, 60))) + rng.choice([".", "!", ""]) for b in range(45)}
    texts |= {45 + i: texts[i] for i in range(4)}  # copies
    texts[49] = texts[7] + " gamma"
    queries = {q: " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 6, 12, 25]))) for q in range(24)} | {99: "nothing known"}
    vectors = {b: [rng.gauss(0, 1) for _ in range(8)] for b in range(0, 50, 2)}
    asked = {q: [rng.gauss(0, 1) for _ in range(8)] for q in queries}
    return texts, queries, vectors, asked


def same(rows, want):
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["block_id"], r["score"]))
    assert set(got) == {q for q, w in want.items() if w}
    for q, rows in got.items():
        assert [b for b, _ in rows] == [b for b, _ in want[q]], q
        assert [s for _, s in rows] == pytest.approx([s for _, s in want[q]]), q


def test_lexical_and_whole_pipeline(spark, small):
    texts, queries, vectors, asked = small
    plain = Plain(texts)
    index = I.build(spark.createDataFrame([(b, t, str(b)) for b, t in texts.items()], "block_id long, text string, doc_id string"), persist=True)
    q = spark.createDataFrame(list(queries.items()), "query_id long, q string")
    for expand in (False, True):
        same(R.lexical(index, q, Options(top_k=2, expansion=Expansion(enabled=expand))).collect(), {i: plain.lexical(t, expand, 10) for i, t in queries.items()})
    same(R.retrieve(index, q, Options(top_k=6)).collect(), {i: plain.finished(t, plain.lexical(t, True, 30), 6) for i, t in queries.items()})
    # with quantized vectors, forced, as hybrid_topk asks
    options = Options(top_k=4, expansion=Expansion(enabled=False), semantic=Semantic(enabled=True, force=True, top_n=50))
    q = spark.createDataFrame([(i, t, asked[i]) for i, t in queries.items()], "query_id long, q string, embedding array<double>")
    held = S.quantized(spark.createDataFrame(list(vectors.items()), "block_id long, embedding array<double>"))
    want = {i: plain.finished(t, plain.reranked(plain.lexical(t, False, 50), asked[i], vectors)[:20], 4) for i, t in queries.items()}
    same(R.retrieve(index, q, options, held).collect(), want)


def test_ties_go_by_the_first_term_met(spark):
    rows = [(5, "one zwei"), (7, "two eins"), (9, "three drei")]
    docs = spark.createDataFrame([(3, "two one three first"), *rows], "block_id long, text string")
    q = spark.createDataFrame([(1, "one two three")], "query_id long, q string")
    order = lambda **k: [r["block_id"] for r in R.lexical(I.build(docs, **k), q, Options(top_k=5, expansion=Expansion(enabled=False))).orderBy("rank").collect()]
    assert order() == [3, 5, 7, 9] and order(ordered=True) == [3, 7, 5, 9]


def test_small_filters_and_names(spark, tmp_path):
    from lorewell.operators import agents as A
    from lorewell.sources import files

    blocks = spark.createDataFrame([(1, " Ünï ", None), (2, "uni", None), (3, None, None)], "block_id long, namespace string, source string").withColumnRenamed("source", "source").selectExpr("*", "cast(null as string) as doc_id")
    ids = lambda **k: sorted(r["block_id"] for r in R.allowed(blocks, Options(namespace=("UNI",)), **k).collect())
    assert ids() == [1, 2] and ids(lite=True) == [2]
    d = spark.createDataFrame([(1, [("a", 1.0), ("a", 2.0), ("b", 1.0)]), (2, [("a", 1.0)])], "decision_id long, candidates array<struct<agent_id:string,score:double>>")
    assert [tuple(r) for r in A.repeated_candidates(d).collect()] == [(1, "a")]
    config = files.init_project(str(tmp_path / "p"))
    files.add_source(config, "more", "more")
    with pytest.raises(files.SourceError):
        files.add_source(config, "more", "other")
    assert files.config(files.init_project(str(tmp_path / "p")))["sources"][1] == {"name": "more", "path": "more"} and files.default_label("/x/y.pack") == "y"
