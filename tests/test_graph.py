"""Searches over edges against plain ones."""

from __future__ import annotations

import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from talus.operators import graph
from talus.plans import projects

from .conftest import SMALL


def _frame(spark, edges):
    return spark.createDataFrame(list(edges), "src long, dst long")


def _roots(spark, roots):
    return spark.createDataFrame([(r,) for r in roots], "root long")


def _depths(edges, root):
    out, depth, queue = defaultdict(list), {root: 0}, deque([root])
    for a, b in edges:
        out[a].append(b)
    while queue:
        a = queue.popleft()
        for b in out[a]:
            if b not in depth:
                depth[b] = depth[a] + 1
                queue.append(b)
    return depth


def _plain_cycles(edges):
    """{smallest node of a component: (its nodes, its shortest cycle from that node, ties by the last nodes)}."""
    nodes = {x for e in edges for x in e}
    seen = {n: set(_depths(edges, n)) for n in nodes}
    own = set(edges)
    found = {}
    for n in nodes:
        part = {m for m in seen[n] if n in seen[m]}
        if n != min(part) or (len(part) == 1 and (n, n) not in own):
            continue
        inner = [e for e in edges if e[0] in part and e[1] in part]
        depth = _depths(inner, n)
        length = min(depth[a] + 1 for a, b in inner if b == n)
        cycle, at = [], n
        for d in range(length - 1, 0, -1):
            at = min(a for a, b in inner if b == at and depth[a] == d)
            cycle.append(at)
        found[n] = (part, [n, *reversed(cycle)])
    return found


def test_reach_of_a_chain_a_hub_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101 + i) for i in range(200)] + [(101 + i, 400) for i in range(200)] + [(7, 3), (7, 7), (0, 1)]
    got = {(r.root, r.node): r.depth for r in graph.reach(_frame(spark, [*edges, (None, 1), (1, None)]), _roots(spark, [0, 100, 29, 0, None, 999])).collect()}
    assert got == {(r, n): d for r in (0, 100, 29, 999) for n, d in _depths(edges, r).items()}
    back = {(r.root, r.node): r.depth for r in graph.dependents(_frame(spark, edges), _roots(spark, [400, 5])).collect()}
    assert back == {(r, n): d for r in (400, 5) for n, d in _depths([(b, a) for a, b in edges], r).items()}
    near = graph.reach(_frame(spark, edges), _roots(spark, [0]), most_depth=2).collect()
    assert sorted(r.node for r in near) == [0, 1, 2]
    assert graph.reach(_frame(spark, edges), _roots(spark, [])).count() == 0


def test_trees_and_impact(spark):
    edges = _frame(spark, [(1, 2), (1, 3), (3, 1), (4, 3), (5, 5)])
    got = {(r.root, r.node): r.deps for r in graph.trees(edges, _roots(spark, [1, 2, 5])).collect()}
    assert got == {(1, 1): [2, 3], (1, 2): [], (1, 3): [1], (2, 2): [], (5, 5): [5]}
    hit = {r.node: (r.n_direct, r.n_transitive, r.impact) for r in graph.impact(edges, _roots(spark, [2, 5, 9, 3]), 8).collect()}
    assert hit == {2: (1, 3, 37.5), 5: (0, 0, 0.0), 9: (0, 0, 0.0), 3: (2, 2, 25.0)}


def test_impact_rounds_half_to_even(spark):
    hit = graph.impact(_frame(spark, [(1, 2)]), _roots(spark, [2]), 800).first()
    assert hit.impact == 0.12  # 0.125


def test_components_and_cycles_of_random_graphs(spark):
    """200 graphs side by side, each with nodes of its own."""
    rng, edges = random.Random(4), []
    for g in range(200):
        n = rng.randint(1, 12)
        edges += [(100 * g + rng.randrange(n), 100 * g + rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))]
    edges += [(50_000 + i, 50_000 + (i + 1) % 40) for i in range(40)]  # a long ring
    want = _plain_cycles(edges)
    df = _frame(spark, edges).cache()
    got = defaultdict(set)
    for r in graph.strong_components(df).collect():
        got[r.component].add(r.node)
    assert got == {n: part for n, (part, _) in want.items()}
    paths = defaultdict(dict)
    for r in graph.cycles(df).collect():
        paths[r.component][r.position] = r.node
    assert {n: [p[k] for k in sorted(p)] for n, p in paths.items()} == {n: cycle for n, (_, cycle) in want.items()}
    assert all(sorted(p) == list(range(len(p))) for p in paths.values())


def test_no_cycles(spark):
    for edges in ([], [(1, 2), (2, 3), (1, 3)]):
        assert graph.strong_components(_frame(spark, edges)).count() == 0
        assert graph.cycles(_frame(spark, edges)).count() == 0


def _writes(monkeypatch):
    made, plain = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, label: made.append(label) or plain(df, label))
    return made


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    """A chain of 400 nodes into a ring of 300, and another ring: far fewer tables are written than there are steps."""
    edges = [(i, i + 1) for i in range(700)] + [(700, 401)] + [(1_300 - i, 1_299 - i) for i in range(300)] + [(1_000, 1_300)]
    df, made = _frame(spark, edges), _writes(monkeypatch)
    got = {(r.root, r.node): r.depth for r in graph.reach(df, _roots(spark, [0, 1_100])).collect()}
    assert got == {(r, n): d for r in (0, 1_100) for n, d in _depths(edges, r).items()}
    assert len(made) < 30
    parts = {r.node: r.component for r in graph.strong_components(df).collect()}
    assert parts == {n: 401 for n in range(401, 701)} | {n: 1_000 for n in range(1_000, 1_301)}
    made.clear()
    path = {(r.component, r.position): r.node for r in graph.cycles(df).collect()}
    assert path == {(401, i): 401 + i for i in range(300)} | {(1_000, i): (1_000, *range(1_300, 1_000, -1))[i] for i in range(301)}
    assert len(made) < 120


def test_graphs_with_too_many_paths_to_double(spark, monkeypatch):
    """With no room for pairs of twice the distance the plain rounds give the same rows, from any round on."""
    rng = random.Random(7)
    edges = [(100 * g + rng.randrange(12), 100 * g + rng.randrange(12)) for g in range(40) for _ in range(24)] + [(9_000 + i, 9_000 + (i + 1) % 9) for i in range(9)]
    want, roots = _plain_cycles(edges), [0, 101, 9_003]
    df = _frame(spark, edges).cache()
    monkeypatch.setattr(graph, "FEW_PATHS", 1)
    monkeypatch.setattr(graph, "MOST_PATHS", 1)
    for depth in (None, 3):
        got = {(r.root, r.node): r.depth for r in graph.reach(df, _roots(spark, roots), depth).collect()}
        assert got == {(r, n): d for r in roots for n, d in _depths(edges, r).items() if depth is None or d <= depth}
    got = defaultdict(dict)
    for r in graph.cycles(df).collect():
        got[r.component][r.position] = r.node
    assert {n: [p[k] for k in sorted(p)] for n, p in got.items()} == {n: c for n, (_, c) in want.items()}


def test_text_nodes_are_numbers_in_searches(spark, monkeypatch):
    """The same rows whether hashes stand for the nodes or, where two share one, the nodes themselves."""
    edges = spark.createDataFrame([("a", "b"), ("b", "cc"), ("b", "a"), ("b", "a"), ("dd", "b"), (None, "a"), ("a", None)], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("cc",), ("a",), ("none",), (None,)], "root string")
    kinds, plain = [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda e, r, d=None: kinds.append(dict(e.dtypes)["src"]) or plain(e, r, d))
    for code, kind in ((graph._hash, "bigint"), (F.length, "string")):
        monkeypatch.setattr(graph, "_hash", code)
        got = sorted((r.root, r.node, r.deps) for r in graph.trees(edges, roots).collect())
        assert got == [("a", "a", ["b"]), ("a", "b", ["a", "cc"]), ("a", "cc", []), ("cc", "cc", []), ("none", "none", [])]
        hit = {r.node: (r.n_direct, r.n_transitive, r.impact) for r in graph.impact(edges, roots, 4).collect()}
        assert hit == {"a": (1, 2, 50.0), "cc": (1, 3, 75.0), "none": (0, 0, 0.0)}
        assert kinds[-2:] == [kind, kind]


def test_walks_from_nodes_not_asked_for_are_dropped(spark, monkeypatch):
    """A chain of 40 from the root, and 300 chains of 6 that no root reaches."""
    edges = [(i, i + 1) for i in range(40)] + [(1_000 + 10 * g + i, 1_001 + 10 * g + i) for g in range(300) for i in range(6)]
    rows, plain = [], graph.stored

    def counted(df, label):
        out = plain(df, label)
        if label == "reach-step":
            rows.append(out[0].count())
        return out

    monkeypatch.setattr(graph, "stored", counted)
    monkeypatch.setattr(graph, "FEW_PATHS", 1)
    assert graph.reach(_frame(spark, edges), _roots(spark, [0])).count() == 41
    assert rows[0] < 300 * 4 + 40 and rows[1] < 300 and rows[2] < 40


def test_single_pairs(spark):
    for edges, single in (([(1, 2), (3, 2)], True), ([(1, 2), (1, 3)], True), ([(1, 2), (1, 3), (4, 2)], False), ([], True)):
        assert graph._single(_frame(spark, edges)) is single


def test_import_trees_make_the_edges_once(spark):
    """What is left to do reads the search's own tables: the edges aren't derived from the orders again."""
    assert not [f for f in projects.import_trees(spark, SMALL).inputFiles() if SMALL in f]
