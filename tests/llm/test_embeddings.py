import numpy as np
from pyspark.sql import functions as F

from lorewell.llm import embeddings as E


def brute(rows, cosine):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in range(i) if c[i, j] >= cosine}


def made(n=400, width=16, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 8, width))
    return [(int(i), (centers[rng.integers(len(centers))] + rng.normal(size=width) * rng.choice([0.01, 0.1, 0.25])).astype(np.float32).tolist()) for i in rng.permutation(n)]


def test_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for cell, block in ((10_000, 16384), (40, 16384), (25, 30)):
        for cosine in (0.95, 0.8):
            out = E.near_pairs(df, cosine, cell, block).collect()
            got = [(r["vec_a"], r["vec_b"]) for r in out]
            assert len(got) == len(set(got)) and set(got) == brute(rows, cosine)


def test_cases(spark):
    one = [0.5, 0.5, 0.0, 0.25]
    rows = [(1, one), (2, one), (2, [9.0, 9.0, 9.0, 9.0]), (3, None), (4, []), (5, [0.0] * 4), (6, [1.0, 2.0]), (7, [float("nan"), 1.0, 1.0, 1.0]), (8, [None, 1.0, 1.0, 1.0]), (None, one), (9, [x * 3 for x in one]), (10, [-x for x in one])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("cell", "own", "width", "a", "z", "left"):
        df = df.withColumn(name, F.lit(name))
    got = {(r["vec_a"], r["vec_b"]): r["cosine"] for r in E.near_pairs(df, block=2, cell=2).collect()}
    assert got == {(1, 2): 1.0, (1, 9): 1.0, (2, 9): 1.0}
    assert E.near_pairs(df.limit(0)).count() == 0


def test_every_width_is_joined(spark):
    wide, narrow = made(120), [(i + 1000, v) for i, v in made(60, 8, seed=2)]
    out = E.near_pairs(spark.createDataFrame(wide + narrow + [(5000, [1.0])], "vec_id long, embedding array<float>"), cell=25, block=30).collect()
    got = [(r["vec_a"], r["vec_b"]) for r in out]
    assert len(got) == len(set(got)) and set(got) == brute(wide, 0.95) | brute(narrow, 0.95) and brute(narrow, 0.95)


def classes(rows, cosine):
    """{id: (class, links)} by comparing all pairs."""
    near = brute(rows, cosine)
    root = {i: i for i, _ in rows}
    links = dict.fromkeys(root, 0)
    for a, b in near:
        links[a] += 1
        links[b] += 1
        x, y = sorted((root[a], root[b]))
        root = {i: x if r == y else r for i, r in root.items()}
    return {i: (root[i], links[i]) for i in root}


def test_classes_against_brute_force(spark):
    rows = made()
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]  # copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for cell, block in ((10_000, 16384), (25, 30)):
        for cosine in (0.95, 0.8):
            got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in E.linked(df, cosine, cell, block).collect()}
            assert got == classes(rows, cosine)
    assert len({c for c, _ in got.values()}) < len(got) and max(n for _, n in got.values()) > 8


def test_given_vectors_at_a_lower_cosine(spark):
    """The given table holds no pair at the production cosine; at a lower one it does."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in E.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.4, 60, 100).collect()}
    assert got == classes(rows, 0.4) and sum(n for _, n in got.values()) > 20


def test_classes_of_cases(spark):
    one = [0.5, 0.5, 0.0, 0.25]
    rows = [(1, one), (2, one), (2, [9.0, 9.0, 9.0, 9.0]), (3, None), (4, []), (5, [0.0] * 4), (6, [1.0, 2.0]), (7, [float("nan"), 1.0, 1.0, 1.0]), (None, one), (9, [x * 3 for x in one]), (10, [-x for x in one])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("cell", "own", "width", "copies", "home", "visits", "root", "first"):
        df = df.withColumn(name, F.lit(name))
    got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in E.linked(df, block=2, cell=2).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0), 9: (1, 2), 10: (10, 0)}
    assert E.linked(df.limit(0)).count() == 0
