"""Usage reports and the risk of files on hand-made rows."""

from __future__ import annotations

from talus.operators import reports, rules, scoring


def _files(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, language string, text string")


def _found(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, type string, severity string")


def test_file_risk_equals_the_report_of_its_findings(spark):
    texts = ['password = "a"\n# password = "b"\nuser_id: "x"; token="y"', 'secret="z" # mock\nhttps://me:pw@host/', "x # TODO fix auth\n// bypass  validation", None, "", "\n".join('api_key = "k"' for _ in range(20)), "disable ssl", 'x = 1 # disable ssl password="q"']
    files = _files(spark, *[("src/test_a.py" if i % 3 == 1 else None if i == 6 else "a.py", "python", t) for i, t in enumerate(texts)])
    want = scoring.risk_report(files, rules.credential_findings(files).unionByName(rules.comment_findings(files)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(scoring.file_risk(files))
    assert got == rows(want) and max(r[2] for r in got) == 100 and min(r[2] for r in got) == 0
    plan = scoring.file_risk(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_totals_and_counts(spark):
    files = _files(spark, ("a", "go", "x\r\ny\n"), ("b", None, None), ("c", "go", "z"))
    found = _found(spark, (0, "T", "HIGH"), (0, None, None), (2, "T", "odd"))
    assert tuple(reports.usage_totals(files, found).first()) == (3, 3, 3, 1.0, 1.0)
    got = {(r.kind, r.name): r.n for r in reports.usage_by(files, found).collect()}
    assert got == {("language", "go"): 2, ("language", "unknown"): 1, ("category", "T"): 2, ("category", "Uncategorized"): 1, ("severity", "critical"): 0, ("severity", "high"): 1, ("severity", "medium"): 1, ("severity", "low"): 0, ("severity", "info"): 0, ("severity", "odd"): 1}
    assert tuple(reports.usage_totals(files.limit(0), found.limit(0)).first()) == (0, 0, 0, None, None)


def test_error_statistics(spark):
    errors = spark.createDataFrame([("A",), ("A",), ("B",), (None,)], "type string")
    assert {(r.what, r.name): r.n for r in reports.error_statistics(errors, {"A": "api"}).collect()} == {("total", ""): 3, ("category", "api"): 2, ("category", "uncategorized"): 1, ("type", "A"): 2, ("type", "B"): 1}
    assert reports.error_statistics(errors.limit(0), {}).count() == 0


def test_report(spark):
    files, found = _files(spark, ("a", "go", "x"), ("b", "c", "y")), _found(spark, (0, "T", "high"), (0, "S", "low"))
    stages = reports.stage_times(spark.createDataFrame([("p", 1.5), ("p", None), ("q", 4.0)], "s string, t double"), "s", "t")
    text = reports.report(reports.usage_totals(files, found), reports.usage_by(files, found), stages, "# R").first()[0]
    assert text.startswith("# R\n\n## Analysis Summary\n\n- Files analyzed: 2\n- Lines of code analyzed: 2\n- Issues found: 2\n- Average issues per file: 1.00\n\n## Issues by Severity\n\n- critical: 0\n- high: 1\n")
    assert "## Issues by Category\n\n- S: 1\n- T: 1\n\n## Files by Language\n\n- c: 1\n- go: 1\n" in text
    assert text.endswith("|-------|---------------|-------|-------------|\n| q | 4.00 | 1 | 4.00 |\n| p | 1.50 | 2 | 0.75 |\n")
    empty = reports.report(reports.usage_totals(files.limit(0), found.limit(0)), reports.usage_by(files.limit(0), found.limit(0)), stages.limit(0)).first()[0]
    assert "Category" not in empty and "Stage" not in empty and "Average" not in empty
