import numpy as np
import pytest

from lorewell.operators import semantic as S
from lorewell.plans import semantic as P


def brute(ids, scores, k=5):
    return {(q, b, s, r) for q, row in zip(ids, scores.tolist()) for r, (s, b) in enumerate(sorted(zip(row, ids), key=lambda x: (-x[0], x[1]))[:k], 1)}


def test_every_vector_is_a_query(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids = [r["vec_id"] for r in rows]
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = P.cosine_top(spark, data).collect()
    want = {(q, r): s for q, _, s, r in brute(ids, np.round(x @ x.T, 6))}
    assert {(r["query_id"], r["rank"]): r["cosine"] for r in got} == pytest.approx(want, abs=2e-6) and len(got) == 5 * len(ids)
    q = {r["block_id"]: r["q"] for r in S.quantized(P.vectors(spark, data)).collect()}
    w = np.array([q[i] for i in ids], dtype=np.int64)
    assert {(r["query_id"], r["block_id"], r["dot"], r["rank"]) for r in P.int8_dot(spark, data).collect()} == brute(ids, w @ w.T)


def test_blocks_ties_and_widths(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, size=(90, 4))
    rows = [(int(i), v.astype(float).tolist()) for i, v in enumerate(x)]
    odd = [(200, [1.0, 2.0]), (201, [2.0, 1.0]), (202, None), (203, []), (204, [float("nan")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + odd, "block_id long, v array<double>")
    want = brute(list(range(90)), x @ x.T) | {(200, 200, 5, 1), (200, 201, 4, 2), (201, 201, 5, 1), (201, 200, 4, 2)}
    for block in (4096, 20):
        assert {tuple(r[c] for c in ("query_id", "block_id", "score", "rank")) for r in S.nearest(df, 5, block=block).collect()} == want


def test_every_benchmark_text_is_a_query(spark, data):
    items = {r["item_id"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    assert {r["query_id"] for r in P.hybrid_topk(spark, data).select("query_id").collect()} == items
    assert {r["query_id"] for r in P.cosine_rerank_all(spark, data).select("query_id").collect()} == items
