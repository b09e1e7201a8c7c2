"""Line rules: a catalogue of patterns evaluated in one pass over the lines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import any_of, first_match

from .corpus import explode_lines


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    severity: str
    language: str | None = None
    type: str = "pattern"
    #: Literals of which a hit must hold one: a cheap test that spares most lines the pattern.
    needs: tuple[str, ...] = ()


#: The built-in line rules, and the line rules of two rule sets; rule_sets has the whole sets.
BUILT_IN = (
    Rule("Hardcoded Secret", r"(password|secret|api.?key|token|credentials).*?['\"]([a-zA-Z0-9]{16,})['\"]", "critical"),
    Rule("SQL Injection Risk", r"(?:execute|query|select|insert|update|delete|drop).*?\+\s*.*?|.*?%s.*?\b(?:query|execute)", "critical", "python", needs=("+", "%s")),
    Rule("Insecure Deserialization", r"pickle\.loads|jsonpickle|yaml\.load\((?!.*Loader=yaml\.SafeLoader)", "high", "python"),
    Rule("TODO Comment", r"#\s*TODO|\/\/\s*TODO", "info"),
    Rule("Print Statement", r"\bprint\s*\(", "low", "python"),
)
RULE_SETS = {
    "Security": ("Hardcoded Secret", "SQL Injection Risk", "Insecure Deserialization"),
    "Code Quality": ("TODO Comment", "Print Statement"),
}
#: Hard-coded credentials, and comments that announce a weakness.
CREDENTIALS = (
    r"(?i)(?:password|passwd|pwd|secret|token|api[-_]?key)\s*[:=]\s*['\"][^'\"]+['\"]",
    r"(?i)(?:username|user[-_]?name|user[-_]?id)\s*[:=]\s*['\"][^'\"]+['\"]",
    r"(?i)(?:https?:\/\/[^:\/\s]+:[^@\/\s]+@)",
)
COMMENTS = (
    r"(?i)(?:fixme|todo|hack|workaround|temporary).*(?:security|auth|password|cred|token|secret)",
    r"(?i)disable\s*(?:security|authentication|auth|validation|verify|ssl)",
    r"(?i)bypass\s*(?:security|authentication|auth|validation|verify)",
)
STRONG = ("password", "secret", "token", "key", "credential")
TEST_WORDS = ("test", "example", "mock", "dummy", "fake")
COMMENT_MARKS = r"^\s*(#|//|/\*|\*|')"


def scan(lines: DataFrame, rules, language: str = "language") -> DataFrame:
    """Every rule that hits a line adds a finding: rule, severity. One pass: the rules are an array of the row, not a join."""
    may = lambda r: F.lit(True) if not r.needs else reduce(lambda a, b: a | b, (F.col("line").contains(x) for x in r.needs))
    hit = lambda r: may(r) & F.col("line").rlike(r.pattern) & (F.lit(True) if r.language is None else F.coalesce(F.col(language) == r.language, F.lit(False)))
    found = F.array(*(F.when(hit(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules))
    return lines.select("*", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_f")).select("*", "_f.rule", "_f.severity").drop("_f")


def rules_of(rule_set: str) -> tuple[Rule, ...]:
    """The line rules of a rule set."""
    return tuple(r for r in BUILT_IN if r.name in RULE_SETS[rule_set])


def _contains(text: Column, words) -> Column:
    return F.lower(text).rlike("|".join(words))


#: Severity and confidence of a comment that announces a weakness.
COMMENT_LEVELS = "low", "medium"


def credential_levels(path: Column, line: Column, match: Column) -> tuple[Column, Column]:
    """Severity and confidence of a credential: both low in test code and examples, high where the match names a secret."""
    weak = _contains(path, ("test",)) | _contains(line, TEST_WORDS)
    strong = _contains(match, STRONG)
    return F.when(weak, "low").when(strong, "high").otherwise("medium"), F.when(weak, "medium").when(strong, "high").otherwise("medium")


def credential_findings(files: DataFrame) -> DataFrame:
    """doc_id, line_no, type, severity, confidence, message: at most one per line; comment and blank lines are skipped.

    Lines that no pattern can hit are dropped before matches are cut out.
    """
    lines = explode_lines(files.select("doc_id", "path", "text").where(any_of(F.col("text"), CREDENTIALS)))
    lines = lines.where((F.trim("line") != "") & ~F.col("line").rlike(COMMENT_MARKS) & any_of(F.col("line"), CREDENTIALS))
    got = lines.withColumn("m", first_match(F.col("line"), CREDENTIALS)).where("m is not null")
    severity, confidence = credential_levels(F.col("path"), F.col("line"), F.col("m"))
    return got.select("doc_id", "line_no", F.lit("Hardcoded Credentials").alias("type"), severity.alias("severity"), confidence.alias("confidence"), F.concat(F.lit("Possible hardcoded credential found: "), "m").alias("message"))


def comment_of(line: Column) -> Column:
    """A whole comment line, else what follows the first #, else the first //; null without a comment."""
    return F.when(line.rlike(COMMENT_MARKS), line).when(line.contains("#"), F.regexp_extract(line, "#(.*)$", 0)).when(line.contains("//"), F.regexp_extract(line, "//(.*)$", 0))


def comment_findings(files: DataFrame) -> DataFrame:
    lines = explode_lines(files.select("doc_id", "text").where(any_of(F.col("text"), COMMENTS)))
    got = lines.withColumn("c", comment_of(F.col("line"))).where(any_of(F.col("c"), COMMENTS))
    return got.select("doc_id", "line_no", F.lit("Insecure Comment").alias("type"), F.lit(COMMENT_LEVELS[0]).alias("severity"), F.lit(COMMENT_LEVELS[1]).alias("confidence"), first_match(F.col("c"), COMMENTS).alias("message"))
