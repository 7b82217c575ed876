import random

import numpy as np

from lorewell.llm import simhash as S

from . import cases


def brute_groups(sigs):
    """doc -> smallest doc of its component, by comparing all pairs."""
    root = {d: d for d in sigs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sigs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(sigs[a], sigs[b]))
            if apart <= S.RADIUS:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_tree_finds_all_within_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    rows = np.repeat(base, 20, axis=0)
    for i in range(len(rows)):
        for bit in rng.choice(128, rng.integers(0, 14), replace=False):
            rows[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    rows = rows[rng.permutation(len(rows))]
    hi, lo = rows[:, 0].copy(), rows[:, 1].copy()
    tree = np.sort(rng.integers(0, 3, len(rows)))
    forest = S.Forest(hi, lo, tree)
    a, b = forest.search(np.arange(len(rows)), S.RADIUS)
    got = set(zip(a.tolist(), b.tolist()))
    i, j = np.triu_indices(len(rows), 1)
    near = (S.apart(hi, lo, i, j) <= S.RADIUS) & (tree[i] == tree[j])
    assert got == set(zip(j[near].tolist(), i[near].tolist())) and len(got) == len(a)
    whole = S.merged(np.arange(len(rows)), i[near], j[near])
    assert (S.linked(tree, hi, lo) == whole).all()


def test_layout_recall():
    """Pairs at the radius meet in a shard with probability 0.999."""
    rng = np.random.default_rng(2)
    for n in (10_000, 10_000_000):
        bits, tables = S.layout(n)
        x = rng.integers(0, 2**63, (4000, 2), dtype=np.uint64)
        y = x.copy()
        for i in range(len(y)):
            for bit in rng.choice(128, S.RADIUS, replace=False):
                y[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        met = (S.shard_keys(x[:, 0], x[:, 1], bits, tables) == S.shard_keys(y[:, 0], y[:, 1], bits, tables)).any(axis=0)
        assert met.mean() > 0.997


def test_against_brute_force(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sigs = {r[0]: s for r, s in zip(rows, S.signatures([r[1] for r in rows])) if s}
    want = brute_groups(sigs)
    out = {r["doc_id"]: r for r in S.groups(docs, shard=8).collect()}
    assert len(out) == len(rows)
    same = sum(out[d]["group_id"] == want[d] for d in want)
    assert same == len(want)
    dropped, expected = {d for d in out if not out[d]["kept"]}, {d for d in want if want[d] != d}
    assert dropped == expected
    kept = {r[0] for r in S.keep_first(docs, shard=8).select("doc_id").collect()}
    assert kept == set(out) - dropped


def test_near_copies_and_clean_documents(spark):
    rng = random.Random(4)
    rows = []
    for i in range(0, 60, 2):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) + str(rng.randint(0, 400)) for _ in range(200)]
        rows.append((i, " ".join(words), "en", "s", 0))
        for at in rng.sample(range(200), 6):
            words[at] = "new" + str(rng.randint(0, 999))
        rows.append((i + 1, " ".join(words), "en", "s", 0))
    out = {r["doc_id"]: r["group_id"] for r in S.groups(cases.docs(spark, rows)).collect()}
    assert sum(out[i + 1] == i for i in range(0, 60, 2)) >= 27
    assert all(out[i] == i for i in range(0, 60, 2))


def test_large_group(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(200)) + f" end{i % 700}", "en", "s", 0) for i in range(1500)]
    out = S.groups(cases.docs(spark, rows)).collect()
    assert {r["group_id"] for r in out} == {0} and sum(r["kept"] for r in out) == 1


def test_cases(spark):
    df = cases.clashing(cases.docs(spark))
    out = {r["doc_id"]: r for r in cases.collected(S.groups(df))}
    assert set(out) == {1, 2, 3, 4, 5, 7, 8, 9, 10}
    assert out[5]["group_id"] == 1 and not out[5]["kept"]
    assert all(out[d]["kept"] for d in (1, 2, 3, 4, 7, 8, 9, 10))
    kept = S.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "7", "8", "9", "10", "None"])
    assert S.groups(df.limit(0)).count() == 0 and S.keep_first(df.limit(0)).count() == 0


def test_scripts_without_spaces(spark):
    """Documents that share most of an unspaced text are near copies; others of the same script aren't."""
    rng = random.Random(9)
    rows = []
    for i in range(0, 40, 2):
        text = [chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(500)]
        rows.append((i, "".join(text), "zh", "s", 0))
        text[100:104] = "永和九年"
        rows.append((i + 1, "".join(text), "zh", "s", 0))
    out = {r["doc_id"]: r["group_id"] for r in S.groups(cases.docs(spark, rows)).collect()}
    assert all(out[i] == i == out[i + 1] for i in range(0, 40, 2))
    assert S.words("永和 abc永和九x 1") == ["永和", "abc", "x", "永和", "和九", "1"]
