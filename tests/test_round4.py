"""batches of more terms than a task holds."""

import pytest

from lorewell.operators import index as I
from lorewell.operators import retrieve as R
from lorewell.options import Options
from lorewell.plans import QUERIES, retrieval


@pytest.fixture
def narrow(monkeypatch):
    """Few terms fit in a task; the calls of the scan are counted."""
    calls = []
    real = R.scan.scored

    def cut():
        monkeypatch.setattr(R, "BROADCAST_ROWS", 300)
        monkeypatch.setattr(R.scan, "scored", lambda *a, **k: calls.append(len(a[1].ids)) or real(*a, **k))
        return calls

    return cut


def test_large_batches_join_no_postings(spark, data, narrow):
    want = sorted(map(tuple, QUERIES["bm25_batch"](spark, data).collect()))
    calls = narrow()
    df = QUERIES["bm25_batch"](spark, data)
    assert sorted(map(tuple, df.collect())) == want and len(want) == 400
    assert len(calls) > 3 and sum(calls) == 40
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_large_ranked_batches_join_no_postings(spark, data, narrow):
    """With phrases, expansion and spans; the results are those of one batch."""
    asked = retrieval.benchmark(spark, data).limit(20).collect() + [(-1, '"of the" tion'), (-2, 'zzqx "of the"'), (-3, ""), (-4, None)]
    asked = spark.createDataFrame([tuple(r) for r in asked], "query_id long, q string")
    index = I.build(I.documents(spark, data))
    rows = lambda: sorted((*r[:3], round(r["score"], 9), *r[4:]) for r in R.lexical(index, asked, Options(top_k=5)).collect())
    want = rows()
    calls = narrow()
    assert rows() == want and len(want) > 400
    assert len(calls) > 8


def test_a_query_is_never_divided(spark, monkeypatch):
    rows = [(i, [f"t{i}_{k}" for k in range(n)], []) for i, n in enumerate([0, 3, 50, 1, 1, 9])] + [(6, None, None)]
    queries = spark.createDataFrame(rows, "query_id long, terms array<string>, phrases array<array<string>>").coalesce(1)
    sizes = lambda limit=0: [[r["query_id"] for r in s] for s in R.slices(queries, limit)]
    assert sizes() == [[0, 1, 2, 3, 4, 5, 6]]
    monkeypatch.setattr(R, "BROADCAST_ROWS", 10)
    assert sizes() == [[0, 1], [2], [3, 4], [5], [6]]
    monkeypatch.setattr(R.scan, "BEST", 10)
    assert sizes(10) == [[i] for i in range(7)]
    assert [s for s in R.slices(queries.limit(0), 10)] == [[]]
