"""Risk and roll-ups of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import any_of, first_match, lines

#: Weights of severities and factors of confidences.
WEIGHT = {"critical": 10, "high": 7, "medium": 4, "low": 1, "info": 0}
FACTOR = {"high": 1.0, "medium": 0.8, "low": 0.5}
SENSITIVITY = {"low": ("high",), "medium": ("medium", "high"), "high": ("info", "low", "medium", "high")}
ORDER = ("info", "low", "medium", "high", "critical")


def _choose(c: Column | str, table: dict, other) -> Column:
    c, out = F.col(c) if isinstance(c, str) else c, F.lit(other)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def points(severity: Column | str = "severity", confidence: Column | str = "confidence") -> Column:
    return _choose(severity, WEIGHT, 1) * _choose(confidence, FACTOR, 1.0)


def _risk(p: Column) -> Column:
    return F.least(F.lit(100), F.floor(p / 100 * 100).cast("int"))


def risk_report(files: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, n_findings, risk (0 to 100) of every file; files without findings have 0. Findings are summed before the join."""
    per = findings.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(points()).alias("p"))
    risk = _risk(F.coalesce("p", F.lit(0.0)))  # least() skips nulls
    return files.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_findings"), risk.alias("risk"))


def file_risk(files: DataFrame) -> DataFrame:
    """risk_report of the credential and comment findings of files (doc_id, path, text), in one pass over each file's own row: nothing is joined or shuffled.

    Only texts that some pattern hits are cut into lines, and only their lines that some pattern hits are judged.
    """
    from . import rules

    text, path = F.col("text"), F.col("path")
    some = any_of(text, (*rules.CREDENTIALS, *rules.COMMENTS))
    credential = lambda x: F.when((F.trim(x) != "") & ~x.rlike(rules.COMMENT_MARKS), first_match(x, rules.CREDENTIALS))
    marked = F.transform(F.filter(lines(text), lambda x: any_of(x, (*rules.CREDENTIALS, *rules.COMMENTS))), lambda x: F.struct(x.alias("x"), credential(x).alias("m"), any_of(rules.comment_of(x), rules.COMMENTS).alias("c")))

    def worth(e: Column) -> Column:
        severity, confidence = rules.credential_levels(path, e["x"], e["m"])
        low = points(*map(F.lit, rules.COMMENT_LEVELS))
        return F.struct((e["m"].isNotNull().cast("int") + F.coalesce(e["c"], F.lit(False)).cast("int")).alias("n"), (F.when(e["m"].isNotNull(), points(severity, confidence)).otherwise(0.0) + F.when(e["c"], low).otherwise(0.0)).alias("p"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("p"))
    total = F.aggregate(F.transform(marked, worth), zero, lambda a, e: F.struct((a["n"] + e["n"]).alias("n"), (a["p"] + e["p"]).alias("p")))
    found = files.select("doc_id", F.when(some, total).otherwise(zero).alias("r"))
    return found.select("doc_id", F.coalesce("r.n", F.lit(0)).cast("long").alias("n_findings"), _risk(F.coalesce("r.p", F.lit(0.0))).alias("risk"))


def sensitivity_filter(findings: DataFrame, level: str) -> DataFrame:
    return findings.where(F.col("severity").isin(*SENSITIVITY.get(level, SENSITIVITY["high"])))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(F.col("severity").isin(*ORDER[ORDER.index(severity) :]))
