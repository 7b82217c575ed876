import random

import numpy as np
from pyspark.sql import functions as F

from lorewell.llm import sharding as S

from . import cases


def minimax(sizes, shards):
    """Least greatest sum of a contiguous partition, by dynamic programming."""
    n = len(sizes)
    ends = [0, *np.cumsum(sizes)]
    best = [0] + [float("inf")] * n
    for _ in range(shards):
        best = [0] + [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(1, n + 1)]
    return best[n]


def blocks(sizes, n, asked, per_part=3):
    cut = [sizes[i : i + n] for i in range(0, len(sizes), n)]
    parts = [cut[i : i + per_part] for i in range(0, len(cut), per_part)]

    def opened(wanted):
        return {p: np.array([sum(c) for c in parts[p]], dtype=np.int64) for p in wanted}

    def fetch(places):
        asked.update(places)
        first = lambda p, i: (p * per_part + i) * n
        return {(p, i): (list(range(first(p, i), first(p, i) + len(parts[p][i]))), np.array(parts[p][i], dtype=np.int64)) for p, i in places}

    return S.Ends(np.array([sum(map(sum, part)) for part in parts], dtype=np.int64), opened, fetch)


def test_smallest_capacity():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 2, 5, rng.randint(0, 50)]) for _ in range(rng.randint(1, 25))]
        shards = rng.randint(1, 8)
        ends = blocks(sizes, rng.randint(1, 6), set())
        capacity = S.smallest_capacity(ends, max(sizes), shards)
        assert capacity == minimax(sizes, shards)
        found = S.cuts(ends, capacity, shards) or []
        assert len(found) <= shards and (not found or found[-1] == sum(sizes))
        for c in found[:-1]:
            key = ends.key_after(c)
            assert sum(sizes[:key]) <= c < sum(sizes[: key + 1])


def test_few_blocks_are_held():
    """With many groups only blocks around the cuts come to the driver."""
    rng = random.Random(2)
    sizes = [rng.randint(1, 9) for _ in range(60_000)]
    asked = set()
    ends = blocks(sizes, 50, asked)
    capacity = S.smallest_capacity(ends, 9, 6)
    assert len(asked) < 40
    for c in (capacity, capacity - 1):  # the first does, the next smaller doesn't
        used, load = 1, 0
        for x in sizes:
            used, load = (used, load + x) if load + x <= c else (used + 1, x)
        assert (used <= 6) is (c == capacity)


def check(out, shards, rows):
    size, last = {}, -1
    for r in sorted(out, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        assert r["shard"] >= last
        last = r["shard"]
        size[last] = size.get(last, 0) + r["n_bytes"]
    sizes = {}
    for r in out:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["n_bytes"]
    ordered = [sizes[k] for k in sorted(sizes, key=lambda k: (k is not None, k or 0))]
    assert max(size.values(), default=0) == minimax(ordered, shards) and len(size) <= shards


def test_documents(spark, data):
    out = cases.collected(S.shard(spark.read.parquet(f"{data}/documents.parquet"), 7))
    assert len(out) == 200
    check(out, 7, out)


def test_atomic_groups(spark, data):
    """Whole sources stay together: the key is the number of the source."""
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("doc_id", F.regexp_extract("source", r"(\d+)", 1).cast("long"))
    out = cases.collected(S.shard(docs, 6))
    check(out, 6, out)
    assert all(len({r["shard"] for r in out if r["doc_id"] == k}) == 1 for k in {r["doc_id"] for r in out})


def test_cases(spark):
    df = cases.clashing(cases.docs(spark))
    for shards in (1, 3, 50):
        out = cases.collected(S.shard(df, shards))
        assert len(out) == len(cases.ROWS)
        check(out, shards, out)
        assert all(r["n_bytes"] == 0 for r in out if r["doc_id"] in (2, 3))
        assert len({r["shard"] for r in out if r["doc_id"] == 5}) == 1
    assert S.shard(df.limit(0)).count() == 0
    empty = df.where("doc_id in (2, 3)")
    assert {r["shard"] for r in S.shard(empty).collect()} == {0}
