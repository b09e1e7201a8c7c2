"""Dual-tree Lloyd against plain rounds, and its defined cases."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from talus.llm import dual_tree_lloyd as lloyd


@pytest.mark.parametrize(("n", "d", "k", "spread"), [(1, 3, 1, 1), (40, 2, 5, 2), (900, 64, 16, 9), (700, 8, 16, 3), (500, 4, 7, 30)])
def test_nearest_equals_plain_search(n, d, k, spread):
    rng = np.random.default_rng(n + d)
    centre = rng.integers(-9 * spread, 9 * spread + 1, (6, d))
    points = centre[rng.integers(0, 6, n)] + rng.integers(-spread, spread + 1, (n, d))
    points[n // 2 : n // 2 + n // 3] = points[0]  # one vector holds a third of the rows
    centroids = points[rng.integers(0, n, k)]  # with equal ones
    tree, near = lloyd.CoverTree.build(points), lloyd.Nearest(centroids)
    want = ((tree.points[:, None, :] - centroids[None]) ** 2).sum(2).argmin(1)
    assert (near.assign(tree) == want).all()
    assert (tree.points == points[tree.order]).all() and sorted(tree.order) == list(range(n))
    if n >= 500:
        assert near.compared < 0.9 * n * k


def test_tree_keeps_its_invariants():
    points = np.random.default_rng(3).integers(-50, 50, (600, 3))
    t = lloyd.CoverTree.build(points, 4)
    for i in range(len(t.first)):
        own = t.points[t.first[i] : t.last[i]]
        away = np.sqrt(((own - own[0]) ** 2).sum(1))
        assert away.max() == pytest.approx(t.reach[i])
        kids = range(t.kids[i], t.kids_end[i])
        if kids:
            assert t.first[kids[0]] == t.first[i] and t.last[kids[-1]] == t.last[i]
            heads = t.points[t.first[kids[0] : kids[-1] + 1]]
            gaps = [np.sqrt(((a - b) ** 2).sum()) for x, a in enumerate(heads) for b in heads[:x]]
            assert min(gaps) >= t.reach[i] / 2


def plain(rows, k, rounds, d):
    """The contract's rounds in Python integers; rows: (vec_id, vector)."""
    kept = [(i, [min(max(math.floor(64 * x), -lloyd.MOST), lloyd.MOST) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [list(v) for _, v in seeds]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        for n, vs in own.items():
            cs[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    got = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, m, d in got if m == n) for n in range(len(cs))}
    return sorted(((i is None, i or 0), n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for i, n, d in got)


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), (rng.normal(size=4) + 3 * (i % 5)).round(2).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (7, [9.0] * 4), (None, [1.0] * 4), (400, None), (401, [1.0] * 3), (402, [1.0, None, 1.0, 1.0]), (403, [float("nan")] * 4), (404, [float("inf"), 0.0, 0.0, 0.0]), (405, [1e30, -1e30, 0.0, 0.0]), (406, [])]
    rows += [(500 + i, [2.0, 2.0, 2.0, 2.0]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", lloyd.F.lit("clash"))
    for k, chunk in ((16, 64), (5, 2048)):
        got = lloyd.cluster_vectors(df.repartition(3), k, 3, 4, chunk=chunk)[0].collect()
        assert sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == plain(rows, k, 3, 4)


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0]), (9, [5.0, 5.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.distance for r in lloyd.cluster_vectors(df, dimensions=2)[0].collect()}
    assert got == {3: 0, 9: 0}
    empty = lloyd.cluster_vectors(df.limit(0), dimensions=2)[0]
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
