"""Texts around reviews: linter output, summaries, answers of a model, consolidated prompts, line differences.

Defined cases: a null or blank linter output is empty; a null review has an
empty summary; an answer that is no object, or is malformed, keeps its row with
null issues; a null version counts as empty, and as having no lines.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.functions.text import split_lines

#: Ignored codes, the mark of no issues, and what a filtered output begins with or says.
IGNORED = ("E1", "E2", "E501", "W")
NO_ISSUES = "(No issues found by flake8)"
NONE_LEFT = "  -> No significant flake8 issues found after filtering.\n"
SOME_LEFT = "  -> Filtered flake8 issues found:\n"
SUMMARY_LINES = 10
ISSUES = "struct<issues:array<struct<line_start:int,line_end:int,severity:string,description:string,recommendation:string>>>"

_FIELDS = r"^([^:]*):([^:]*):([^:]*):([\s\S]*)$"


_BLANK = r"[\s\u001c-\u001f\u0085 ]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", "")


def _ignored(line: Column, codes, prefix: bool) -> Column:
    """Whether the fourth field, stripped, begins with a code: one pattern, tried once a line."""
    some = "|".join(rf"\Q{c}\E" + ("" if prefix else rf" [\s\S]*(?!{_BLANK})[\s\S]") for c in codes)
    return line.rlike(rf"^[^:]*:[^:]*:[^:]*:{_BLANK}*+(?:{some})") if codes else F.lit(False)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filtered_linter(text: Column, codes=IGNORED, prefix: bool = False) -> Column:
    """A linter's output without the lines of ignored codes; as it is if none is dropped.

    A line has four fields, cut at colons; others are kept. A code is ignored if
    it is one of codes, or begins with one where prefix is set.
    """
    some = lambda kept: F.concat(F.lit(SOME_LEFT + "    "), F.array_join(kept, "\n    "), F.lit("\n"))
    out = lambda lines, kept: F.when(F.size(kept) == 0, NONE_LEFT).when(F.size(kept) == F.size(lines), text).otherwise(some(kept))
    cut = lambda bare: _let(F.split(bare, "\n", -1), lambda lines: _let(F.filter(lines, lambda x: ~_ignored(x, codes, prefix)), lambda kept: out(lines, kept)))
    found = _let(_strip(text), lambda bare: F.when(bare == NO_ISSUES, "").otherwise(cut(bare)))
    return F.when(text.isNull() | (text == ""), "").otherwise(found)


def linter_rows(table: DataFrame, text: str = "text") -> DataFrame:
    """The columns of table without the text, and file, line, column, code, message of each line with four fields."""
    rest = [c for c in table.columns if c != text]
    some = table.select(*rest, F.explode(F.split(_strip(F.col(text)), "\n", -1)).alias("_l")).where(F.col("_l").rlike(_FIELDS))
    part = lambda k: F.regexp_extract("_l", _FIELDS, k)
    said = _strip(part(4))
    return some.select(*rest, part(1).alias("file"), part(2).try_cast("int").alias("line"), part(3).try_cast("int").alias("column"), F.regexp_extract(said, r"^(\S*)", 1).alias("code"), _strip(F.regexp_extract(said, r"^\S*([\s\S]*)$", 1)).alias("message"))


def summary_section(review: Column) -> Column:
    """The lines from the first heading Summary to the next other heading, or the first ten lines and an ellipsis."""
    lines = F.split(F.coalesce(review, F.lit("")), "\n", -1)
    head = lambda x: F.lower(x).startswith("# summary") | F.lower(x).startswith("## summary")
    marks = F.transform(lines, lambda x: F.when(head(x), 1).when(x.startswith("#"), 2).otherwise(0))
    first = F.array_position(marks, F.lit(1)).cast("int")
    after = F.slice(marks, first, F.size(marks))
    stop = F.array_position(after, F.lit(2)).cast("int")
    own = F.slice(lines, first, F.when(stop > 0, stop - 1).otherwise(F.size(lines)))
    return F.when(review.isNull(), "").when(first > 0, F.array_join(own, "\n")).otherwise(F.concat(F.array_join(F.slice(lines, 1, SUMMARY_LINES), "\n"), F.lit("\n...")))


def parsed_issues(answer: Column) -> Column:
    """The issues of an answer that is a JSON object, typed; null where it has none or is malformed."""
    bare = _strip(answer)
    return F.when(bare.startswith("{") & bare.endswith("}"), F.from_json(answer, ISSUES)["issues"])


def consolidated(reviews: DataFrame, key: str = "path", head: str = "", foot: str = "") -> DataFrame:
    """key, n_chunks, prompt: the reviews of each file's chunks (chunk_index, start_line, end_line, review) in order under banners, between head and foot, in which {path} stands for the key."""
    one = F.struct("chunk_index", F.coalesce(F.col("start_line").cast("string"), F.lit("?")).alias("a"), F.coalesce(F.col("end_line").cast("string"), F.lit("?")).alias("b"), F.coalesce("review", F.lit("[No review content found for this chunk]")).alias("r"))
    got = reviews.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("c"))
    parts = F.transform("c", lambda x, i: F.concat(F.lit("\n\n--- REVIEW FOR CHUNK "), (i + 1).cast("string"), F.lit(" (Lines ~"), x["a"], F.lit(" - "), x["b"], F.lit(") ---\n"), x["r"]))
    named = lambda s: F.replace(F.lit(s), F.lit("{path}"), F.coalesce(F.col(key).cast("string"), F.lit("unknown")))
    return got.select(key, F.size("c").alias("n_chunks"), F.concat(named(head), F.array_join(parts, ""), named(foot)).alias("prompt"))


def edit_counts(old: list, new: list) -> tuple[int, int]:
    """(removed, added) of the shortest edit script between two lists: furthest points on the diagonals, differences by length of time and memory."""
    a = 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    b = 0
    while b < min(len(old), len(new)) - a and old[-1 - b] == new[-1 - b]:
        b += 1
    old, new = old[a : len(old) - b], new[a : len(new) - b]
    n, m = len(old), len(new)
    if not n or not m:
        return n, m
    reach = {1: 0}
    for d in range(n + m + 1):
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < n and x - k < m and old[x] == new[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                # of d edits, removals less additions are n - m
                return (d + n - m) // 2, (d - n + m) // 2
    raise AssertionError


def line_diffs(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """The columns of pairs without both texts, and lines_removed, lines_added, lines_same of the shortest edit script over lines.

    Lines travel as hashes; time grows with the lines times the differences of a pair.
    """
    rest = [c for c in pairs.columns if c not in (old, new)]
    hashes = lambda c: F.transform(split_lines(F.col(c)), lambda x: F.xxhash64(x))
    kept = pairs.select(*rest, hashes(old).alias("_a"), hashes(new).alias("_b"))
    fields = T.StructType.fromDDL("lines_removed long, lines_added long, lines_same long").fields
    schema = T.StructType(kept.schema.fields[:-2] + fields)

    def run(batches):
        for b in batches:
            rows = []
            for x, y in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                x, y = x.as_py(), y.as_py()
                removed, added = edit_counts(x, y)
                rows.append((removed, added, len(x) - removed))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)
