"""Redirect equivalence on planted links."""

from __future__ import annotations

import pytest

from talus.llm import url_filter


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def _link(url):
    return f'<head><LINK rel="Canonical" href="{url}"></head>'


def _refresh(url):
    return f"<meta http-equiv=refresh content='3; URL={url}'>"


def _verdicts(spark, rows, **some):
    return {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(_pages(spark, rows).withColumn("host", url_filter.F.lit(1)), **some).collect()}


def test_chains_stars_and_allow_inside(spark):
    rows = [
        (1, "http://a.com/en/1", ""),
        (2, "http://x.dev/1", _link("http://a.com/en/1")),  # an alias of a blocked page
        (3, "http://y.dev/2", _refresh("http://x.dev/1")),  # two steps away
        (4, "http://b.net/de/1", _link("http://a.com/en/1")),  # allowed by its own rule inside a blocked component
        (5, "http://z.dev/", _link("http://b.net/de/1")),  # blocked through the allowed page
        (6, "http://free.dev/", _link("http://other.dev/")),  # a component without a blocked page
        (7, "http://other.dev/", ""),
        (8, None, _link("http://a.com/en/1")),
        (9, "http://x.dev/1", None),  # the same URL again
        (10, "http://example.com/en/7", _link("http://a.com/en/1")),
        *((100 + i, f"http://hub{i}.dev/", _link("/s/../r?q=1&amp;w=2#f") if i % 2 else _link("http://hub.dev/r")) for i in range(6)),
        (200, "http://hub1.dev/r?q=1&w=2", _link("http://A.com/en/1")),
    ]
    got = _verdicts(spark, rows)
    assert got[1] == ("com/en/", "block") and got[2] == (None, "block") and got[3] == (None, "block")
    assert got[4] == ("net/de/", "allow") and got[5] == (None, "block") and got[10] == ("example.com/en/7", "allow")
    assert got[6] == got[7] == got[8] == (None, "allow") and got[9] == (None, "block")
    assert got[101] == (None, "block") and got[200] == (None, "block") and got[103] == got[100] == (None, "allow")


def test_a_long_chain(spark):
    rows = [(i, f"http://n{i}.dev/", _link(f"http://n{i + 1}.dev/")) for i in range(40)] + [(40, "http://n40.dev/", ""), (41, "http://k.org/es/", _refresh("http://n0.dev/"))]
    assert {v for _, v in _verdicts(spark, rows).values()} == {"block"}


def test_more_edges_by_hand(spark):
    edges = spark.createDataFrame([("http://Q.dev/#x", "http://w.com/en/"), (None, "http://w.com/en/")], "src string, dst string")
    got = _verdicts(spark, [(1, "HTTP://q.dev/", ""), (2, "http://r.dev/", "")], edges=edges)
    assert got == {1: (None, "block"), 2: (None, "allow")}


@pytest.mark.parametrize(
    ("html", "dst"),
    [
        (_link("b"), "http://h.dev/a/b"),
        (_link("../../c"), "http://h.dev/c"),
        (_link("./d/."), "http://h.dev/a/d/"),
        (_link("//other.dev/x"), "http://other.dev/x"),
        (_link("/z&#47;&#x2F;y&quot;&amp;amp;"), "http://h.dev/z//y\"&amp;"),
        (_link("/y&#300;"), "http://h.dev/y&"),  # a sign beyond ASCII stays a reference, whose # begins a fragment
        (_link("HTTPS&colon;//K.dev/A?B#c"), "https://k.dev/A?B"),
        (_refresh("?q"), "http://h.dev/a/?q"),
        (_link("#top"), None),
        (_link("mailto:x@y"), None),
        (_link(""), None),
        (f"<!-- {_link('b')} -->", None),
        (f"<script>{_link('b')}</script>", None),
        ("<link rel=stylesheet href=b>", None),
        (None, None),
    ],
)
def test_links(spark, html, dst):
    got = [r.dst for r in url_filter.link_edges(_pages(spark, [(1, "http://H.dev/a/p", html)])).collect()]
    assert got == ([dst] if dst else [])


def test_the_plan_names_each_step_once(spark):
    plan = url_filter.link_edges(_pages(spark, []))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp") + plan.lower().count("rlike") < 200
    assert url_filter.filter_urls(_pages(spark, [])).count() == 0
