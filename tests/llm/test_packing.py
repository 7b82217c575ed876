import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lorewell.llm import packing as P

from . import cases


def best_fit(items, capacity):
    """Plain best-fit decreasing over (length, key) in order: key -> (bin, offset)."""
    room, out = [], {}
    for length, key in items:
        best = min(((r, i) for i, r in enumerate(room) if r >= length), default=None)
        if best is None:
            room.append(capacity)
            best = (capacity, len(room) - 1)
        out[key] = (best[1], capacity - best[0])
        room[best[1]] -= length
    return out


@given(st.lists(st.integers(1, 40), max_size=150), st.integers(40, 60))
@settings(max_examples=150, deadline=None)
def test_plan_is_best_fit_decreasing(lengths, capacity):
    lengths.sort(reverse=True)
    want = best_fit([(n, i) for i, n in enumerate(lengths)], capacity)
    histogram = defaultdict(int)
    for n in lengths:
        histogram[n] += 1
    rows = P.plan(histogram, capacity).tolist()
    rank = defaultdict(int)
    for i, n in enumerate(lengths):
        run = [r for r in rows if r[0] == n and r[1] <= rank[n]][-1]
        j = rank[n] - run[1]
        assert want[i] == (run[3] + j // run[2], run[4] + j % run[2] * n)
        rank[n] += 1


def test_segment_tree():
    rng = random.Random(1)
    tree, open_ = P.Rooms(100), set()
    for _ in range(2000):
        r = rng.randint(0, 100)
        tree.set(r, r not in open_)
        open_ ^= {r}
        need = rng.randint(0, 100)
        assert tree.tightest(need) == min((x for x in open_ if x >= need), default=-1)


def brute(rows, capacity):
    items = []
    for d, t in rows:
        n = len(re.findall(r"[^ \t\n\x0b\f\r]+", t or ""))
        for piece in range(-(-n // capacity)):
            items.append((min(capacity, n - piece * capacity), (d, piece)))
    items.sort(key=lambda x: (-x[0], x[1][0] is not None, x[1][0] or 0, x[1][1]))
    return best_fit(items, capacity)


def test_against_brute_force(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], P.CAPACITY)
    out = {(r["doc_id"], r["piece"]): (r["bin_id"], r["bin_offset"]) for r in P.pack(docs).collect() if r["n_words"]}
    assert out == want


def test_cases(spark):
    df = cases.clashing(cases.docs(spark))
    out = cases.collected(P.pack(df, 64))
    bins = defaultdict(list)
    for r in out:
        if r["bin_id"] is None:
            assert r["n_words"] == 0 and r["doc_id"] in (2, 3, 4)
        else:
            bins[r["bin_id"]].append((r["bin_offset"], r["n_words"]))
    for held in bins.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= 64
    words = sum(r["n_words"] for r in out if r["doc_id"] == 7)
    assert words == len(cases.LONG.split())
    assert sum(r["doc_id"] == 5 for r in out) == 2
    assert P.pack(df.limit(0)).count() == 0


def test_one_length_is_spread(spark):
    """A length that all pieces have is numbered by many tasks, whatever their ids have in common."""
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = cases.docs(spark, [(64 * d, "a b c", None, None, 5) for d in range(4000)])
        out = P.pack(df, 7)
        assert out.rdd.glom().map(len).collect().count(0) <= 1
        assert sorted((r["bin_id"], r["bin_offset"]) for r in out.collect()) == [(d // 2, 3 * (d % 2)) for d in range(4000)]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_sizes_of_a_column(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, None), (4, -2), (5, 25)], "doc_id long, n_tokens int")
    out = sorted((r["doc_id"], r["start_word"], r["n_words"], r["bin_id"], r["bin_offset"]) for r in P.pack(df, 10, "n_tokens").collect() if r["n_words"])
    assert out == [(1, 0, 5, 3, 0), (2, 0, 9, 2, 0), (5, 0, 10, 0, 0), (5, 10, 10, 1, 0), (5, 20, 5, 3, 5)]
