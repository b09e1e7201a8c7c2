"""Usage and performance of reviews as totals, counts by name, stage times and a report.

Defined cases: a null language is unknown, a null severity medium, a null type
Uncategorized; severities count without regard to case; without files the
averages are null; counts that are equal stand in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import split_lines

SEVERITIES = ("critical", "high", "medium", "low", "info")


def usage_totals(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: n_files, n_lines, n_issues and their averages a file. Both tables are counted where they lie."""
    f = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(F.size(split_lines(F.col("text")))), F.lit(0)).cast("long").alias("n_lines"))
    return f.join(findings.agg(F.count("*").alias("n_issues")), F.lit(True)).withColumns({"issues_per_file": F.try_divide("n_issues", "n_files"), "lines_per_file": F.try_divide("n_lines", "n_files")})


def usage_by(files: DataFrame, findings: DataFrame) -> DataFrame:
    """kind (language, severity, category), name, n. Every known severity has a row."""
    language = files.groupBy(F.coalesce("language", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("language"))
    # both kinds of a finding from one pass
    both = F.array(F.struct(F.lit("severity").alias("kind"), F.lower(F.coalesce("severity", F.lit("medium"))).alias("name")), F.struct(F.lit("category").alias("kind"), F.coalesce("type", F.lit("Uncategorized")).alias("name")))
    found = findings.select(F.explode(both).alias("e")).groupBy("e.kind", "e.name").agg(F.count("*").alias("n"))
    none = files.sparkSession.createDataFrame([("severity", s, 0) for s in SEVERITIES], "kind string, name string, n long")
    found = found.unionByName(none).groupBy("kind", "name").agg(F.sum("n").alias("n"))
    return found.unionByName(language.select("kind", "name", "n"))


def stage_times(events: DataFrame, stage: str, seconds: str) -> DataFrame:
    """stage, total_time, n_calls, avg_time; a call without a time counts with none."""
    got = events.groupBy(F.col(stage).alias("stage")).agg(F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total_time"), F.count("*").alias("n_calls"))
    return got.withColumn("avg_time", F.col("total_time") / F.col("n_calls"))


def error_statistics(errors: DataFrame, categories: dict[str, str], kind: str = "type") -> DataFrame:
    """what (total, category, type), name, n of a table of errors; categories names those of types, others are uncategorized."""
    known = F.create_map(*(F.lit(x) for kv in sorted(categories.items()) for x in kv)) if categories else None
    category = F.coalesce(F.try_element_at(known, F.col(kind)), F.lit("uncategorized")) if categories else F.lit("uncategorized")
    one = F.array(F.struct(F.lit("total").alias("what"), F.lit("").alias("name")), F.struct(F.lit("category").alias("what"), category.alias("name")), F.struct(F.lit("type").alias("what"), F.col(kind).alias("name")))
    return errors.where(F.col(kind).isNotNull()).select(F.explode(one).alias("e")).groupBy("e.what", "e.name").agg(F.count("*").alias("n"))


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c)


def report(totals: DataFrame, by: DataFrame, stages: DataFrame, title: str = "# Code Review Tool Statistics Report") -> DataFrame:
    """One row, report: the totals, the counts by severity, category and language, and the stages, in Markdown.

    The tables have a row for each name, so they are small whatever was reviewed.
    """
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("k"), "name", "n"))))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("name")), F.lit(0))
    severity = F.array_sort(F.collect_list(F.when(F.col("kind") == "severity", F.struct(place.cast("long").alias("k"), "name", "n"))))
    small = by.agg(severity.alias("s"), listed("category").alias("c"), listed("language").alias("l"))
    stage = stages.agg(F.array_sort(F.collect_list(F.struct((-F.col("total_time")).alias("k"), "stage", "total_time", "n_calls", "avg_time"))).alias("t"))
    rows = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(f"\n## {head}\n\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x["name"], F.lit(": "), x["n"].cast("string"), F.lit("\n"))), ""))).otherwise("")
    line = lambda x: F.concat(F.lit("| "), x["stage"], F.lit(" | "), _two(x["total_time"]), F.lit(" | "), x["n_calls"].cast("string"), F.lit(" | "), _two(x["avg_time"]), F.lit(" |\n"))
    table = F.when(F.size("t") > 0, F.concat(F.lit("\n## Processing Stage Performance\n\n| Stage | Total Time (s) | Calls | Avg Time (s) |\n|-------|---------------|-------|-------------|\n"), F.array_join(F.transform("t", line), ""))).otherwise("")
    number = lambda label, c: F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"), F.lit("\n"))
    average = F.when(F.col("n_files") > 0, F.concat(F.lit("- Average issues per file: "), _two(F.col("issues_per_file")), F.lit("\n"))).otherwise("")
    summary = F.concat(F.lit(f"{title}\n\n## Analysis Summary\n\n"), number("Files analyzed", "n_files"), number("Lines of code analyzed", "n_lines"), number("Issues found", "n_issues"), average)
    one = totals.join(small, F.lit(True)).join(stage, F.lit(True))  # one row each
    return one.select(F.concat(summary, rows(F.col("s"), "Issues by Severity"), rows(F.col("c"), "Issues by Category"), rows(F.col("l"), "Files by Language"), table).alias("report"))
