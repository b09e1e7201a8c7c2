"""Rules and rule sets from data: dictionaries, as JSON holds them, become one plan over lines and syntax trees.

A rule is a pattern (searched in every line, in files of its language if it
names one), a complexity bound (of functions in Python files), or a composite
of other rules by their names. A composite stands for its members; its own
severity has no effect. Severities are given in lower case.

A wrong rule raises RuleError with its name and what is wrong: an unknown type,
a missing name, description or pattern, a pattern that isn't a valid expression,
or a composite without a known member. Unknown names in a rule set raise too.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions.text import split_lines

from . import rules, syntax_tree
from .corpus import explode_lines
from .language_rules import java_form

#: What the built-in rules say, and those that are no line rules.
TEXTS = {
    "Hardcoded Secret": ("Potential hardcoded secret or API key", "Never hardcode secrets. Use environment variables or a secure storage solution."),
    "SQL Injection Risk": ("Potential SQL injection risk", "Use parameterized queries or an ORM instead of string concatenation."),
    "Insecure Deserialization": ("Potential insecure deserialization", "Use yaml.safe_load() instead of yaml.load() or specify the SafeLoader."),
    "TODO Comment": ("TODO comment found", "Consider addressing TODO comments before code review or converting to tracked issues."),
    "Print Statement": ("Print statement found in code", "Consider using a logger instead of print statements for better control in production."),
}
COMPLEXITY = {
    "type": "complexity",
    "name": "Function Complexity",
    "description": "Function is too complex (high cyclomatic complexity)",
    "max_complexity": 10,
    "severity": "Medium",
    "recommendation": "Consider breaking this function into smaller, more focused functions.",
}
SETS = {
    "Security": ("Hardcoded Secret", "SQL Injection Risk", "Insecure Deserialization"),
    "Code Quality": ("TODO Comment", "Print Statement", "Function Complexity"),
    "Default": ("Hardcoded Secret", "SQL Injection Risk", "Insecure Deserialization", "TODO Comment", "Print Statement", "Function Complexity"),
}


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Bound:
    """A complexity rule."""

    name: str
    description: str
    most: int
    severity: str
    recommendation: str


@dataclass(frozen=True)
class Pattern:
    """A line rule with its texts."""

    rule: rules.Rule
    description: str
    recommendation: str

    @property
    def name(self) -> str:
        return self.rule.name


@dataclass
class Registry:
    """Rules and rule sets by name; a rule is a tuple of its line and complexity rules, composites being flat."""

    rules: dict[str, tuple[Pattern | Bound, ...]] = field(default_factory=dict)
    sets: dict[str, tuple[Pattern | Bound, ...]] = field(default_factory=dict)

    def add_rule(self, given: dict) -> tuple[Pattern | Bound, ...]:
        name, kind = given.get("name") or "", given.get("type") or ""
        wrong = lambda what: RuleError(f"rule {name!r}: {what}")
        if not name or not given.get("description"):
            raise wrong("a rule needs a name and a description")
        severity, advice = str(given.get("severity") or "Medium").lower(), given.get("recommendation") or ""
        if kind == "pattern":
            pattern = given.get("pattern") or ""
            if not pattern:
                raise wrong("a pattern rule needs a pattern")
            try:
                re.compile(pattern)
            except re.error as e:
                raise wrong(f"its pattern is no regular expression ({e})") from e
            shown = java_form(pattern)
            rule = rules.Rule(name, f"(?i){shown}" if given.get("ignore_case") else shown, severity, given.get("language") or None)
            made = (Pattern(rule, given["description"], advice or f"Review potential issue with '{pattern}'"),)
        elif kind == "complexity":
            made = (Bound(name, given["description"], int(given.get("max_complexity", 10)), severity, advice),)
        elif kind == "composite":
            made = tuple(r for n in given.get("rules") or () for r in self.rules.get(n, ()))
            if not made:
                raise wrong("a composite rule needs a known rule")
        else:
            raise wrong(f"unknown type {kind!r}")
        self.rules[name] = made
        return made

    def add_set(self, given: dict) -> tuple[Pattern | Bound, ...]:
        name = given.get("name") or ""
        if not name:
            raise RuleError("a rule set needs a name")
        made = []
        for r in given.get("rules") or ():
            if isinstance(r, str) and r not in self.rules:
                raise RuleError(f"rule set {name!r}: no rule {r!r}")
            made += self.rules[r] if isinstance(r, str) else self.add_rule(r)
        self.sets[name] = tuple(made)
        return self.sets[name]

    def load(self, text: str) -> Registry:
        """Rules and rule sets of a JSON text: an object with the lists rules and rule_sets, either of which may be missing."""
        given = json.loads(text)
        if not isinstance(given, dict):
            raise RuleError("rules are an object with the lists rules and rule_sets")
        for r in given.get("rules", ()):
            self.add_rule(r)
        for s in given.get("rule_sets", ()):
            self.add_set(s)
        return self


def built_in() -> Registry:
    """The six built-in rules and the sets Security, Code Quality and Default."""
    out = Registry()
    for r in rules.BUILT_IN:
        out.rules[r.name] = (Pattern(r, *TEXTS[r.name]),)
    out.add_rule(COMPLEXITY)
    for name, members in SETS.items():
        out.add_set({"name": name, "rules": list(members)})
    return out


def evaluate(files: DataFrame, members: tuple[Pattern | Bound, ...]) -> DataFrame:
    """doc_id, rule, line_start, line_end, severity, description, recommendation: findings of a rule or rule set on files (doc_id, language, text).

    All patterns are searched in one pass over the lines. Trees are made only
    where the set bounds complexity, and of Python files alone; a file that
    doesn't parse has no findings there. A rule that is in the set twice finds twice.
    """
    patterns, bounds = ([r for r in members if isinstance(r, kind)] for kind in (Pattern, Bound))
    lines = explode_lines(files.select("doc_id", "language", "text"), cut=split_lines)
    found = rules.scan(lines, [p.rule for p in patterns]) if patterns else None
    parts = []
    if patterns:
        said = F.create_map(*(F.lit(x) if isinstance(x, str) else x for p in {p.name: p for p in patterns}.values() for x in (p.name, F.struct(F.lit(p.description).alias("description"), F.lit(p.recommendation).alias("recommendation")))))
        parts.append(found.select("doc_id", "rule", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), "severity", F.element_at(said, F.col("rule")).alias("_t")).select("doc_id", "rule", "line_start", "line_end", "severity", "_t.*"))
    if bounds:
        trees = syntax_tree.nodes(files.where("language = 'python'").select("doc_id", "text"))
        functions = syntax_tree.complexity(trees)
        checks = F.array(*(F.when(F.col("complexity") > b.most, F.struct(F.lit(b.name).alias("rule"), F.lit(b.severity).alias("severity"), F.concat(F.lit(f"{b.description} (Complexity: "), F.col("complexity").cast("string"), F.lit(f", Max: {b.most})")).alias("description"), F.lit(b.recommendation).alias("recommendation"))) for b in bounds))
        over = functions.select("doc_id", F.col("line_no").alias("line_start"), F.col("end_line").alias("line_end"), F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("_f"))
        parts.append(over.select("doc_id", "_f.rule", "line_start", "line_end", "_f.severity", "_f.description", "_f.recommendation"))
    if not parts:
        none = files.sparkSession.createDataFrame([], "rule string, line_start int, line_end int, severity string, description string, recommendation string")
        return files.select("doc_id").limit(0).join(none)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
