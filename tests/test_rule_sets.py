"""Rules from data on hand-made files."""

from __future__ import annotations

import json

import pytest

from talus.operators import rule_sets

LONG = "def f(a):\n" + "    if a: pass\n" * 10
RULES = {
    "rules": [
        {"type": "pattern", "name": "Cat", "description": "a cat", "pattern": "cat{1}|dog", "severity": "High", "ignore_case": True},
        {"type": "pattern", "name": "Only Go", "description": "go", "pattern": "cat", "language": "go", "recommendation": "none"},
        {"type": "complexity", "name": "Simple", "description": "Too long", "max_complexity": 2, "severity": "Low"},
        {"type": "composite", "name": "Both", "description": "both", "rules": ["Cat", "Nobody", "Simple"], "severity": "Critical"},
    ],
    "rule_sets": [{"name": "Mine", "description": "mine", "rules": ["Both", "Only Go", {"type": "pattern", "name": "New", "description": "new", "pattern": "x$"}]}],
}


def _files(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, language string, text string")


def _rows(df):
    return sorted((r.doc_id, r.rule, r.line_start, r.line_end, r.severity) for r in df.collect())


def test_a_set_from_json(spark):
    mine = rule_sets.Registry().load(json.dumps(RULES)).sets["Mine"]
    files = _files(spark, ("python", "CAT a dog\r\nx"), ("go", "cat\ncat cat\n"), (None, None), ("python", "def g(a):\n    if a and 1:\n        pass\n    return a\n"), ("python", "def h(:"))
    got = rule_sets.evaluate(files, mine)
    assert _rows(got) == [(0, "Cat", 1, 1, "high"), (0, "Cat", 2, 2, "high"), (0, "New", 3, 3, "medium"), (1, "Cat", 1, 1, "high"), (1, "Cat", 2, 2, "high"), (1, "Only Go", 1, 1, "medium"), (1, "Only Go", 2, 2, "medium"), (3, "Simple", 1, 4, "low")]
    said = {r.rule: (r.description, r.recommendation) for r in got.collect()}
    assert said == {"Cat": ("a cat", "Review potential issue with 'cat{1}|dog'"), "Only Go": ("go", "none"), "New": ("new", "Review potential issue with 'x$'"), "Simple": ("Too long (Complexity: 3, Max: 2)", "")}
    assert rule_sets.evaluate(files.limit(0), mine).count() == 0 and rule_sets.evaluate(files, ()).count() == 0


def test_built_in_sets(spark):
    sets = rule_sets.built_in().sets
    assert {n: len(s) for n, s in sets.items()} == {"Security": 3, "Code Quality": 3, "Default": 6}
    files = _files(spark, ("python", f"{LONG}print (1) # TODO\npassword = 'abcdefghijklmnop'\n"), ("go", "print(1) // TODO"))
    assert _rows(rule_sets.evaluate(files, sets["Code Quality"])) == [(0, "Function Complexity", 1, 11, "medium"), (0, "Print Statement", 12, 12, "low"), (0, "TODO Comment", 12, 12, "info"), (1, "TODO Comment", 1, 1, "info")]
    assert [r[1] for r in _rows(rule_sets.evaluate(files, sets["Default"]))].count("Hardcoded Secret") == 1


@pytest.mark.parametrize(
    "rule",
    [
        {"type": "ast", "name": "a", "description": "b"},
        {"name": "a", "description": "b"},
        {"type": "pattern", "name": "a", "description": "b"},
        {"type": "pattern", "name": "a", "pattern": "x"},
        {"type": "pattern", "description": "b", "pattern": "x"},
        {"type": "pattern", "name": "a", "description": "b", "pattern": "("},
        {"type": "composite", "name": "a", "description": "b", "rules": ["nobody"]},
    ],
)
def test_wrong_rules_are_refused(rule):
    with pytest.raises(rule_sets.RuleError):
        rule_sets.Registry().add_rule(rule)


def test_wrong_sets_are_refused():
    for s in ({"rules": []}, {"name": "a", "rules": ["nobody"]}):
        with pytest.raises(rule_sets.RuleError):
            rule_sets.Registry().add_set(s)
    with pytest.raises(rule_sets.RuleError):
        rule_sets.Registry().load("[]")
