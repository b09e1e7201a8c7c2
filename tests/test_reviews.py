"""Linter output, summaries, answers, prompts and line differences on hand-made rows."""

from __future__ import annotations

import random

import pytest

from talus.operators import reviews


def _one(spark, text, make):
    return spark.createDataFrame([(text,)], "x string").select(make(reviews.F.col("x"))).first()[0]


FOUR = "a.py:1:1: E501 line too long\na.py:2:1: F401 'os' unused\nb.py:3:9: E101 tabs: and more\nno fields"


def test_linter_filter(spark):
    show = lambda t, **k: _one(spark, t, lambda c: reviews.filtered_linter(c, **k))
    assert show(FOUR) == "  -> Filtered flake8 issues found:\n    a.py:2:1: F401 'os' unused\n    b.py:3:9: E101 tabs: and more\n    no fields\n"
    assert show(FOUR, prefix=True) == "  -> Filtered flake8 issues found:\n    a.py:2:1: F401 'os' unused\n    no fields\n"
    assert show("a.py:1:1: W \n") == "a.py:1:1: W \n"  # stripped, W has no blank after it
    assert show("a.py:1:1: W x") == reviews.NONE_LEFT
    assert show(" x:y:z\n ") == " x:y:z\n "
    assert [show(t) for t in (None, "", f" {reviews.NO_ISSUES}\n")] == ["", "", ""]


def test_linter_rows(spark):
    df = spark.createDataFrame([(1, FOUR), (2, None), (3, "a:b:c:D")], "k long, text string")
    got = sorted(tuple(r) for r in reviews.linter_rows(df).where("k = 1").collect())
    assert got == [(1, "a.py", 1, 1, "E501", "line too long"), (1, "a.py", 2, 1, "F401", "'os' unused"), (1, "b.py", 3, 9, "E101", "tabs: and more")]
    assert [tuple(r) for r in reviews.linter_rows(df).where("k = 3").collect()] == [(3, "a", None, None, "D", "")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x\n# Summary\na\nb\n## Next\nc", "# Summary\na\nb"),
        ("## SUMMARY: y\na\n# summary\nb", "## SUMMARY: y\na\n# summary\nb"),
        ("### Summary\na", "### Summary\na\n..."),
        ("\n".join(map(str, range(12))), "\n".join(map(str, range(10))) + "\n..."),
        ("", "\n..."),
        (None, ""),
    ],
)
def test_summary(spark, text, want):
    assert _one(spark, text, reviews.summary_section) == want


def test_answers(spark):
    show = lambda t: _one(spark, t, reviews.parsed_issues)
    got = show(' {"issues": [{"line_start": 2, "severity": "low"}], "x": 1}\n')
    assert [(r.line_start, r.line_end, r.severity) for r in got] == [(2, None, "low")]
    assert show('{"issues": []}') == []
    assert [show(t) for t in (None, "", "{", '{"other": []}', '{"issues": [}', 'x {"issues": []}', '[{"issues": []}]')] == [None] * 7


def test_consolidated_prompt(spark):
    df = spark.createDataFrame([("a", 2, 5, 9, "two"), ("a", 0, 1, None, None), ("b", 0, 1, 2, "")], "path string, chunk_index int, start_line int, end_line int, review string")
    got = {r.path: (r.n_chunks, r.prompt) for r in reviews.consolidated(df, head="For {path}", foot="\nend").collect()}
    assert got["a"] == (2, "For a\n\n--- REVIEW FOR CHUNK 1 (Lines ~1 - ?) ---\n[No review content found for this chunk]\n\n--- REVIEW FOR CHUNK 2 (Lines ~5 - 9) ---\ntwo\nend")
    assert got["b"][0] == 1


def test_edit_counts_equal_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        same = best[-1][-1]
        assert reviews.edit_counts(a, b) == (len(a) - same, len(b) - same)


def test_line_diffs(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\n", "a\r\nx\nc"), (2, None, "a"), (3, "a", ""), (4, None, None)], "k long, old string, new string")
    assert {tuple(r) for r in reviews.line_diffs(df).collect()} == {(1, 1, 1, 2), (2, 0, 1, 0), (3, 1, 0, 0), (4, 0, 0, 0)}


def test_linter_lines_are_matched_by_one_pattern(spark):
    """Blanks around a code and at the end of a line count as before; fields are not extracted."""
    from pyspark.sql import functions as F

    from talus.operators import reviews

    texts = ["a:1:2: E1 x\nb:1:1:E1 \nc:1:1:  E501  \ny", "a:1:2: W bare", "a:1:2: W291 bare", "a:1:2:E2\u0085 x\nz", None, " ", " (No issues found by flake8) "]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    got = [r[0] for r in t.select(reviews.filtered_linter(F.col("text"))).collect()]
    some = lambda *x: reviews.SOME_LEFT + "\n".join("    " + y for y in x) + "\n"
    assert got == [some("b:1:1:E1 ", "c:1:1:  E501  ", "y"), reviews.NONE_LEFT, texts[2], texts[3], "", " ", ""]
    plan = t.select(reviews.filtered_linter(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan
