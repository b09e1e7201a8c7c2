"""Checks of JavaScript, TypeScript, Go and Rust files: patterns on lines, and folds over the ordered lines of a file.

Input: files with doc_id, path and text; output: doc_id, line_no, issue, severity. Lines are cut as Python's splitlines does; a null text has none.
A block opens at its first line and closes at the first line that is "}", so a nested block closes the outer one early.
Every fold runs inside a row, over that file's lines; nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import split_lines

#: Issue, severity and pattern of a line.
JAVASCRIPT = (
    ("Console Statement", "info", r"console\.(log|debug|info|warn|error)\("),
    ("Eval Usage", "high", r"\beval\s*\("),
    ("Loose Comparison", "medium", r"([^=!])={2}(\s*)(null|undefined)"),
    ("jQuery Usage", "info", r"(\$\(|\$\.|\bjQuery\b)"),
)
TYPESCRIPT = (
    ("Non-null Assertion", "medium", r"\w+!\.|\w+!\["),
    ("Type Assertion", "info", r"\bas\s+[A-Z]\w+|<[A-Z]\w+>\s*\w+"),
)
GO_IGNORED = r"(?:[\w\[\]]+(?:\s*,\s*)+)?_\s*:=\s*[\w\d\.\(\)\[\]]+\.[\w\d]+\("
GO_EMPTY = r"type\s+\w+\s+interface\s*\{\s*\}"
RUST_PANICS = (
    ("Unwrap Usage", "medium", r"\.\s*unwrap\s*\(\)"),
    ("Expect Usage", "low", r"""\.\s*expect\s*\(\s*["'](.*?)["']\s*\)"""),
)
RUST_CLONE = r"\.\s*clone\s*\(\)"
MAX_ANY, MAX_FIELDS, MAX_VARIANTS, MAX_BORROWS = 3, 15, 10, 5

_HITS = "array<struct<line_no:int,issue:string,severity:string>>"


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _finding(line_no: Column, issue: str, severity: str) -> Column:
    return F.struct(line_no.cast("int").alias("line_no"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))


def _where(test, issue: str, severity: str) -> Column:
    """A finding at every line (column l) for which test holds."""
    at = F.transform("l", lambda x, i: F.when(test(x), _finding(i + 1, issue, severity)))
    return F.filter(at, lambda x: x.isNotNull())


def _findings(files: DataFrame, *parts: Column) -> DataFrame:
    """Rows of the findings of parts, each an array over the columns l (lines) and path (lower case)."""
    table = files.select("doc_id", F.lower(F.coalesce("path", F.lit(""))).alias("path"), split_lines(F.col("text")).alias("l")).where(F.size("l") > 0)
    return table.select("doc_id", F.inline(F.concat(*(p.cast(_HITS) for p in parts))))


def _holding(files: DataFrame, *words: tuple[str, ...]) -> DataFrame:
    """Files whose text holds all words of a tuple: those without the words of any check have no finding."""
    tests = (reduce(and_, (F.col("text").contains(w) for w in some)) for some in words)
    return files.where(reduce(or_, tests))


def _closed(opens, hit, closes=lambda x: _trim(x) == "}", keep: bool = False, first: bool = False, over: int = -1) -> Column:
    """Blocks that close, as (start, end, n, last): lines from 1, how many inner lines hit, and the last that did; only those with more than over, so that few are held.

    A block that opens within another replaces it; its count starts anew, or goes on (keep). With first the outer one stays.
    """
    none = F.lit(None).cast("int")
    block = "struct<start:int,end:int,n:int,last:int>"
    zero = F.struct(F.lit(1).alias("at"), none.alias("start"), F.lit(0).alias("n"), none.alias("last"), F.array().cast(f"array<{block}>").alias("out"))

    def step(a, x):
        inside = a["start"].isNotNull()
        opening = F.coalesce(opens(x), F.lit(False)) & (~inside if first else F.lit(True))
        closing = ~opening & inside & closes(x)
        hits = ~opening & ~closing & inside & hit(x)
        n = F.when(closing | (opening & F.lit(not keep)), F.lit(0)).when(hits, a["n"] + 1).otherwise(a["n"])
        start = F.when(opening, a["at"]).when(closing, none).otherwise(a["start"])
        done = F.struct(a["start"].alias("start"), a["at"].alias("end"), a["n"].alias("n"), a["last"].alias("last")).cast(block)
        out = F.when(closing & (a["n"] > over), F.concat(a["out"], F.array(done))).otherwise(a["out"])
        return F.struct((a["at"] + 1).alias("at"), start.alias("start"), n.alias("n"), F.when(hits, a["at"]).otherwise(a["last"]).alias("last"), out.alias("out"))

    return F.aggregate("l", zero, step)["out"]


def _blocks(over: int, issue: str, severity: str, *found, at: str = "start", **how) -> Column:
    return F.transform(_closed(*found, over=over, **how), lambda b: _finding(b[at], issue, severity))


def javascript_issues(files: DataFrame) -> DataFrame:
    return _findings(files, *(_where(lambda x, p=p: x.rlike(p), i, s) for i, s, p in JAVASCRIPT))


def typescript_issues(files: DataFrame) -> DataFrame:
    """The checks of JavaScript and: any types, assertions, interfaces that nothing else names, enum names.

    More than MAX_ANY any types are one finding at the first line that has one; up to that, every such line is one.
    Of an interface declared twice, the last declaration counts.
    """
    total = F.aggregate("l", F.lit(0), lambda a, x: a + F.size(F.regexp_extract_all(x, F.lit(r":\s*any\b"), F.lit(0))))
    has_any = lambda x: x.rlike(r":\s*any\b")
    many = F.slice(_where(has_any, "Excessive Any Type", "medium"), 1, 1)
    anys = F.when(total > MAX_ANY, many).otherwise(_where(has_any, "Any Type", "info"))
    name = lambda x: F.regexp_extract(x, r"interface\s+(\w+)", 1)
    declared = F.filter(F.transform("l", lambda x, i: F.struct(name(x).alias("name"), (i + 1).alias("at"))), lambda d: d["name"] != "")
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform(declared, lambda d: d["name"])), lambda n: F.struct(n, F.array_max(F.transform(F.filter(declared, lambda d: d["name"] == n), lambda d: d["at"])))))
    unused = F.map_filter(last, lambda n, at: ~F.exists("l", lambda x: x.contains(n) & ~_trim(x).startswith("interface")))
    interfaces = F.transform(F.map_values(unused), lambda at: _finding(at, "Unused Interface", "info"))
    enum = lambda x: F.regexp_extract(x, r"enum\s+(\w+)", 1)
    odd = lambda x: (enum(x) != "") & (~enum(x).rlike(r"^\p{Lu}") | enum(x).contains("_"))
    lined = (_where(lambda x, p=p: x.rlike(p), i, s) for i, s, p in (*JAVASCRIPT, *TYPESCRIPT))
    return _findings(files, *lined, anys, interfaces, _where(odd, "Enum Naming", "info"))


def go_issues(files: DataFrame) -> DataFrame:
    """Ignored errors, empty interfaces, large structs (both orders of words), defers in loops, naked returns, selects with only a default, unused imports."""
    comment = lambda x: _trim(x).startswith("//")
    quiet = F.col("path").contains("test") | F.col("path").contains("mock")
    ignored = F.when(quiet, F.array().cast(_HITS)).otherwise(_where(lambda x: ~comment(x) & x.rlike(GO_IGNORED), "Ignored Error", "medium"))
    struct = lambda x: x.rlike(r"struct\s+\w+\s*\{|\bstruct\s*\{"), lambda x: (_trim(x) != "") & ~comment(x)
    loop = lambda x: x.rlike(r"^\s*for\s+"), lambda x: x.rlike(r"^\s*defer\s+")
    result = lambda x: F.element_at(F.split(x, r"\)", -1), -2)
    named = lambda x: x.rlike(r"\bfunc\s+\w+[^{]*\)\s*\([^{]*\)\s*\{") & result(x).rlike(r"\([\w\s,]+\s+[\w\[\]\*\.]+")
    return _findings(
        _holding(files, ("_", ":=", "("), ("type", "interface"), ("struct", "{"), ("for", "defer"), ("func", "return"), ("select {", "default:"), ("import", '"')),
        ignored,
        _where(lambda x: x.rlike(GO_EMPTY), "Empty Interface", "low"),
        _blocks(MAX_FIELDS, "Large Struct", "medium", *struct),
        _blocks(0, "Defer in Loop", "high", *loop, keep=True),
        _blocks(0, "Naked Return", "info", named, lambda x: _trim(x) == "return", keep=True),
        _default_only(),
        _go_unused_imports(),
    )


def _default_only() -> Column:
    """Selects whose lines up to the first with a closing brace hold a default and no case but receives.

    The lines are read from the last to the first, with what holds between a line and the next closing brace.
    """
    zero = F.struct(F.size("l").alias("at"), F.lit(False).alias("default"), F.lit(False).alias("sends"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        bare, ends = _trim(x), x.contains("}")
        default = ~ends & (a["default"] | bare.startswith("default:"))
        sends = ~ends & (a["sends"] | (bare.startswith("case ") & ~bare.startswith("case <-")))
        lonely = x.contains("select {") & a["default"] & ~a["sends"]
        return F.struct((a["at"] - 1).alias("at"), default.alias("default"), sends.alias("sends"), F.when(lonely, F.concat(a["out"], F.array(a["at"]))).otherwise(a["out"]).alias("out"))

    return F.transform(F.aggregate(F.reverse("l"), zero, step)["out"], lambda at: _finding(at, "Select With Only Default", "medium"))


def _go_unused_imports() -> Column:
    """Imports, single or in a closed block, whose package (or alias) is followed by a dot nowhere in the file."""
    code = F.array_join("l", "\n")
    used = lambda name: (name != "") & F.contains(code, F.concat(name, F.lit(".")))
    package = lambda path: F.element_at(F.split(path, "/", -1), -1)
    blocks = _closed(lambda x: _trim(x) == "import (", lambda x: F.lit(False), closes=lambda x: _trim(x) == ")", first=True)
    inner = F.flatten(F.transform(blocks, lambda b: F.when(b["end"] - b["start"] > 1, F.sequence(b["start"] + 1, b["end"] - 1)).otherwise(F.array().cast("array<int>"))))

    def listed(i):
        x = _trim(F.element_at("l", i))
        path = F.regexp_extract(x, r'"([^"]+)"', 1)
        alias = F.regexp_extract(x, r'^(\w+)\s+"', 1)
        return F.when((path != "") & ~x.startswith("//") & ~used(package(path)) & ~used(alias), _finding(i, "Unused Import", "info"))

    single = lambda x: F.regexp_extract(_trim(x), r'^import\s+"([\w./]+)"', 1)
    alone = F.transform("l", lambda x, i: F.when((single(x) != "") & ~used(package(single(x))), _finding(i + 1, "Unused Import", "info")))
    return F.filter(F.concat(alone, F.transform(inner, listed)), lambda x: x.isNotNull())


def rust_issues(files: DataFrame) -> DataFrame:
    """Unwrap, expect, clone, unsafe; a mutex in a struct (its last line), large enums, names borrowed mutably too often (first line)."""
    comment = lambda x: _trim(x).startswith("//")
    tested = lambda x: x.contains("#[test]") | x.contains("mod test") | F.col("path").contains("tests")
    panics = (_where(lambda x, p=p: ~tested(x) & ~comment(x) & x.rlike(p), i, s) for i, s, p in RUST_PANICS)
    mutex = lambda x: x.rlike(r"struct\s+(\w+)\s*\{"), lambda x: x.contains("Mutex<") | x.contains("std::sync::Mutex")
    enum = lambda x: x.rlike(r"enum\s+(\w+)\s*\{"), lambda x: ~comment(x) & x.contains(",")
    names = lambda x: F.when(comment(x), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(x, F.lit(r"&mut\s+(\w+)"), F.lit(1)))
    borrows = F.flatten(F.transform("l", lambda x, i: F.transform(names(x), lambda n: F.struct(n.alias("name"), (i + 1).alias("at")))))
    # names side by side, each with its first line: one pass counts them
    zero = F.struct(F.lit("").alias("name"), F.lit(0).alias("n"), F.lit(0).alias("first"), F.array().cast("array<int>").alias("out"))

    def count(a, b):
        same = a["name"] == b["name"]
        n, first = F.when(same, a["n"] + 1).otherwise(1), F.when(same, a["first"]).otherwise(b["at"])
        return F.struct(b["name"].alias("name"), n.alias("n"), first.alias("first"), F.when(n == MAX_BORROWS + 1, F.concat(a["out"], F.array(first))).otherwise(a["out"]).alias("out"))

    often = F.aggregate(F.array_sort(borrows), zero, count)["out"]
    return _findings(
        _holding(files, ("unwrap", "()"), ("expect", "("), ("clone", "()"), ("unsafe ",), ("struct", "Mutex"), ("enum", "{"), ("&mut",)),
        *panics,
        _where(lambda x: ~comment(x) & x.rlike(RUST_CLONE), "Clone Usage", "info"),
        _where(lambda x: x.contains("unsafe {") | x.contains("unsafe fn"), "Unsafe Code", "high"),
        _blocks(0, "Mutex in Struct", "medium", *mutex, at="last"),
        _blocks(MAX_VARIANTS, "Large Enum", "medium", *enum),
        F.transform(often, lambda at: _finding(at, "Excessive Mutable Borrowing", "low")),
    )
