"""Top-k search against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from talus.llm import topk_search


def plain(rows, queries, k=5):
    """{query: [(score, vec_id)]}; rows: (vec_id, vector)."""
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = {}
    for q, a in rows:
        if queries(q):
            out.setdefault(q, []).extend((sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in rows if i != q)
    return {q: sorted(x, key=lambda s: (-s[0], s[1]))[:k] for q, x in out.items() if x}


def found(spark, rows, queries, **some):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", topk_search.F.lit("clash"))
    v = topk_search.quantised(df.repartition(3))
    got = {}
    for r in topk_search.top_k(v, v.where(queries), **some).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return got


def test_repeated_id_of_the_query(spark):
    """Many vectors of the query's own id stand before its partners."""
    rows = [(0, [1 - 0.008 * i, 0.0]) for i in range(12)] + [(i, [0.7 - 0.008 * i, 0.8]) for i in range(1, 40)]
    got = found(spark, rows, "vec_id = 0")
    assert len(got[0]) == 5 and got == plain(rows, lambda q: q == 0)


@pytest.mark.parametrize("block", [8_192, 7])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.01, 1, 1, 30])).tolist()) for i in range(600)]
    rows += [(600 + i, [0.5] * 6) for i in range(60)]  # ties
    rows += [(10, [0.5] * 6), (20, [9.0] * 6), (20, [9.0] * 6), (None, [99.0] * 6), (700, None), (701, [1.0, None]), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (704, []), (705, [40.0]), (706, [0.0] * 6)]
    assert found(spark, rows, "vec_id % 10 = 0", query_block=block) == plain(rows, lambda q: q % 10 == 0)


def test_few_and_none(spark):
    assert found(spark, [(0, [1.0]), (1, [2.0])], "vec_id = 0") == {0: [(256 * 512, 1)]}
    assert found(spark, [(0, [1.0])], "true") == {} and found(spark, [(0, None)], "true") == {}
