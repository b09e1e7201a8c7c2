"""Blocks between braces, and checks of C# methods.

A method's block ends at the brace that closes its opening one, by the running
depth of braces; braces in strings and comments count like others. Attributes
on the lines right above a method belong to it.

Defined cases: a null or empty text has no blocks; a block that nothing closes
ends with the text; a method on one line is one line; repeated rows each have
theirs. A null path is no controller and no test.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .language_rules import TEST_PATHS, has

#: The head of a method, marks of web actions, words of checked input, parameters of text, type handling.
METHOD = r"(?:public|private|protected|internal)\s+(?:async\s+)?[A-Za-z0-9_<>]+\s+[A-Za-z0-9_]+\s*\([^)]*\)\s*(?:\s*where\s+[^{]+)?\s*\{"
ACTIONS = ("[HttpGet]", "[HttpPost]", "[HttpPut]", "[HttpDelete]")
VALIDATION = ("[Required]", "[StringLength", "[RegularExpression", "[Range", "ModelState.IsValid", "FluentValidation")
STRING_PARAMETER = r"\([^)]*\bstring\b[^)]*\)"
#: The blank before the name is taken whole, else it would stand for another name.
TYPE_HANDLING = r"TypeNameHandling\s*=\s*+(?!TypeNameHandling\.None)"

_BLOCK = "start_line int, end_line int, depth int, body string"


def block_rows(text: str, head: re.Pattern):
    """(first line, last line, depth, body) of the blocks whose head ends with the opening brace; lines from 1, depth is that of the braces around it."""
    closes, opens, stack, depth_of = {}, [], [], {}
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            depth_of[m.start()] = len(stack)
            stack.append(m.start())
        elif stack:
            closes[stack.pop()] = m.start()
    feeds = [i for i, c in enumerate(text) if c == "\n"]
    line_of = lambda at: bisect_right(feeds, at - 1)
    for m in head.finditer(text):
        brace = m.end() - 1
        first, last = line_of(m.start()), line_of(closes.get(brace, len(text)))
        begin = lambda k: feeds[k - 1] + 1 if k else 0
        while first and text[begin(first - 1) : begin(first) - 1].lstrip().startswith("["):
            first -= 1
        yield first + 1, last + 1, depth_of[brace], text[begin(first) : begin(last + 1) - 1 if last < len(feeds) else len(text)]


def blocks(files: DataFrame, head: str = METHOD) -> DataFrame:
    """doc_id, path, start_line, end_line, depth, body of the blocks whose head matches."""
    kept = files.select("doc_id", "path", "text").where("text is not null")
    fields = T.StructType.fromDDL(_BLOCK).fields
    # texts without an opening brace are spared
    kept = kept.where(F.col("text").contains("{"))

    def run(batches):
        pattern = re.compile(head)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                found = [(i, row) for i, t in enumerate(some.column(2)) for row in block_rows(t.as_py(), pattern)]
                rows = list(zip(*(r for _, r in found), strict=True)) or [()] * 4
                own = pa.array([i for i, _ in found], pa.int64())
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0).take(own), some.column(1).take(own), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=["doc_id", "path", *(f.name for f in fields)])

    return kept.mapInArrow(run, T.StructType(kept.schema.fields[:2] + fields))


def innermost(lines: DataFrame, found: DataFrame) -> DataFrame:
    """lines (doc_id, line_no) with the start_line of the innermost block around each; null outside of all."""
    around = lines.join(found.select("doc_id", "start_line", "end_line"), "doc_id").where("line_no between start_line and end_line")
    inner = around.groupBy("doc_id", "line_no").agg(F.max_by("start_line", F.struct("start_line", -F.col("end_line"))).alias("start_line"))
    return lines.join(inner, ["doc_id", "line_no"], "left")


def _feeds(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1)) - 1


def method_issues(files: DataFrame) -> DataFrame:
    """doc_id, line_no, type, severity, confidence: text parameters of web actions without validation, and type handling while deserialising."""
    body = F.col("body")
    got = blocks(files)
    test = F.when(has(F.lower(F.coalesce("path", F.lit(""))), TEST_PATHS["csharp"]), "low").otherwise("medium")
    action = got.where(F.coalesce(F.col("path").contains("Controller"), F.lit(False)) & has(body, ACTIONS) & ~has(body, VALIDATION))
    # a match's line: the line feeds in what stands before it
    pieces = F.split("body", STRING_PARAMETER, -1)
    matches = F.regexp_extract_all("body", F.lit(STRING_PARAMETER), F.lit(0))
    before = F.transform(F.sequence(F.lit(1), F.size("_m")), lambda k: F.array_join(F.flatten(F.zip_with(F.slice("_p", F.lit(1), k), F.concat(F.array(F.lit("")), F.slice("_m", F.lit(1), k - 1)), lambda p, m: F.array(m, p))), ""))
    action = action.select("doc_id", "start_line", test.alias("confidence"), pieces.alias("_p"), matches.alias("_m")).where(F.size("_m") > 0)
    action = action.select("doc_id", "confidence", "start_line", F.explode(before).alias("_b")).select("doc_id", (F.col("start_line") + _feeds(F.col("_b"))).alias("line_no"), F.lit("Missing Input Validation").alias("type"), F.lit("medium").alias("severity"), "confidence")
    typed = got.where(body.contains("Deserialize") & body.contains("TypeNameHandling") & body.rlike(TYPE_HANDLING))
    typed = typed.select("doc_id", (F.col("start_line") + _feeds(F.substring_index("body", "TypeNameHandling", 1))).alias("line_no"), F.lit("Insecure Deserialization").alias("type"), F.lit("critical").alias("severity"), F.lit("high").alias("confidence"))
    return action.unionByName(typed)
