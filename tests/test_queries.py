"""Every core query against its SQL, and operators on hand-made rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from talus.operators import cache, chunking, corpus, graph, rules, scoring
from talus.plans import catalogue, code_checks, projects  # noqa: F401

from .conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SMALL).toPandas(), duck.execute(catalogue.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_has_a_row_for_every_document(spark):
    assert entry.entry(spark).count() == 200


def _files(spark, *texts, language="python"):
    return spark.createDataFrame([(i, f"src/{i}.py", language, t) for i, t in enumerate(texts)], "doc_id long, path string, language string, text string")


def test_credentials_first_hit_per_line_and_skips(spark):
    t = 'password = "a"\n# password = "b"\n\nuser_id: "x"; token="y"\nsecret="z" # mock\nhttps://me:pw@host/'
    got = rules.credential_findings(_files(spark, t, None, "")).orderBy("line_no").collect()
    assert [(r.line_no, r.severity, r.confidence) for r in got] == [(1, "high", "high"), (4, "high", "high"), (5, "low", "medium"), (6, "medium", "medium")]


def test_comments(spark):
    t = "x = 1  # TODO fix auth\n// bypass  validation\nplain todo password"
    assert [r.line_no for r in rules.comment_findings(_files(spark, t, None)).orderBy("line_no").collect()] == [1, 2]


@pytest.mark.parametrize(("line", "hit"), [("yaml.load(x)", True), ("yaml.load(x, Loader=yaml.SafeLoader)", False), ("pickle.loads(b)", True)])
def test_look_ahead_rule(spark, line, hit):
    rule = [r for r in rules.BUILT_IN if r.name == "Insecure Deserialization"]
    assert (rules.scan(corpus.explode_lines(_files(spark, line)), rule).count() > 0) is hit
    assert rules.scan(corpus.explode_lines(_files(spark, line, language="go")), rule).count() == 0


def test_risk_is_cut_at_100_and_rounds_down(spark):
    files = _files(spark, *[""] * 4)
    f = [(0, "critical", "high")] + [(1, "critical", "high")] * 2 + [(1, "high", "high"), (1, "low", "high"), (1, "low", "high")] + [(2, "critical", "high")] * 11
    found = spark.createDataFrame(f, "doc_id long, severity string, confidence string")
    got = {r.doc_id: r.risk for r in scoring.risk_report(files, found).collect()}
    assert got == {0: 10, 1: int(29 / 100 * 100), 2: 100, 3: 0}


def test_chunks_at_the_edges(spark):
    texts = ["", None, "a", "b" * 1000, "c" * 1001, "\U0001f600" * 801]
    got = chunking.fixed_chunks(_files(spark, *texts)).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.chunk_index, r.content) for r in got if r.doc_id == i)
        assert [c for _, c in mine] == [(t or "")[a : a + 1000] for a in range(0, len(t or ""), 800)]


def test_closure_of_chain_and_cycle(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(10, 11), (11, 10)], "src long, dst long")
    got = {tuple(r) for r in graph.closure(e).collect()}
    assert got == {(a, b) for a in range(7) for b in range(a + 1, 7)} | {(10, 11), (11, 10), (10, 10), (11, 11)}
    assert graph.closure(e.limit(0)).count() == 0


def test_latest_and_lru(spark):
    log = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 7, "c"), (3, 1, "d")], "k long, ts long, v string")
    assert {r.k: r.v for r in cache.latest(log, "k", "ts", "v").collect()} == {1: "b", 2: "c", 3: "d"}
    assert [(r.k, r.lru_rank) for r in cache.lru_keep(log, "k", "ts", 2).orderBy("lru_rank").collect()] == [(1, 1), (2, 2)]


def test_language_and_globs(spark):
    t = spark.createDataFrame([("a/b.PY",), ("c.rs",), ("x",), (None,)], "p string")
    assert [r[0] for r in t.select(corpus.language(t.p)).collect()] == ["python", "rust", "unknown", "unknown"]
    assert [r[0] for r in t.where("p is not null").select(corpus.excluded(t.p, ("a/*", "?"))).collect()] == [True, False, True]


def test_all_nation_edges(spark, duck):
    sql = "select distinct s_nationkey, c_nationkey from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where s_nationkey <> c_nationkey"
    got = {tuple(r) for r in graph.nation_edges(spark, SMALL).collect()}
    assert got == set(duck.execute(sql).fetchall())
