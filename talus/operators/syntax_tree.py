"""Checks of Python files on their syntax trees, as queries over a table of tree nodes.

nodes() parses each file in its task and gives a row per node; every check is then a filter, join or aggregation of that table.
A query of one check names it, and gets only the kinds of nodes and the columns that this check reads.
A null text counts as empty. A file that doesn't parse gives one row of kind SyntaxError and takes no part in other checks.
Repeated doc_ids would mix their trees: give each file its own id.
"""

from __future__ import annotations

import ast
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

MAX_COMPLEXITY, MAX_METHODS, MAX_CLASS_LINES, MAX_FUNCTION_LINES, MAX_PARAMETERS, LOOP_DEPTH = 10, 15, 300, 50, 5, 3
#: Numbers that need no name, and parts of names of calls in the order in which the first that fits counts.
PLAIN_NUMBERS = (0, 1, -1, 100, 10, 2, 24, 60, 3600)
CALLS = (
    ("sql", ("execute",)),
    ("command", ("system", "popen", "subprocess.run", "subprocess.call")),
    ("load", ("pickle.load", "yaml.load")),
    ("file", ("open", "read", "write")),
    ("jwt", ("jwt.decode",)),
    ("hash", ("md5", "sha1")),
)
#: Parts of names of calls whose results come from outside.
SOURCES = ("input", "raw_input", "request.get", "request.post", "request.args.get", "request.form.get", "getattr", "eval", "exec", "open", "urllib.request.urlopen", "requests.get", "requests.post", "socket.recv", "subprocess.check_output", "json.loads")

_NODE = "node int, parent int, parent_kind string, kind string, name string, line int, end_line int, size int, value double, loops int, functions array<int>, shape string, names array<string>, flags array<string>"
#: What each check reads: kinds of nodes, and columns beside doc_id and kind.
NEEDS = {
    "complexity": (("FunctionDef", "AsyncFunctionDef", "If", "While", "For", "AsyncFor", "BoolOp", "Break", "Continue", "Try"), ("node", "name", "line", "end_line", "size", "functions")),
    "syntax_errors": (("SyntaxError",), ("line",)),
    "unused": (("Name", "alias", "Assign"), ("name", "line", "shape", "names")),
    "sizes": (("For", "While", "AsyncFor", "ClassDef", "FunctionDef", "AsyncFunctionDef", "ExceptHandler", "Constant"), ("parent_kind", "name", "line", "end_line", "size", "value", "loops", "shape")),
    "calls": (("Call", "Assign"), ("node", "name", "line", "shape", "names", "flags")),
    "imports": (("Import", "ImportFrom"), ("name", "size", "names")),
}
#: A file that holds none of a check's keywords, signs and digits has no finding of it, and isn't parsed. Python takes these in ASCII only; a name may be written in other letters, so none is here.
HINTS = {
    "complexity": ("def",),
    "unused": ("=", "import"),
    "sizes": (*"0123456789", "for", "while", "class", "def", "except"),
    "calls": ("(",),
    "imports": ("import",),
}
_LOOPS = (ast.For, ast.While, ast.AsyncFor)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _dotted(f) -> str | None:
    """The name of a call's target, as far as it is names and attributes."""
    tail = []
    while isinstance(f, ast.Attribute):
        tail.append(f.attr)
        f = f.value
    if isinstance(f, ast.Name):
        tail.append(f.id)
    return ".".join(reversed(tail)) or None


def _shape(x) -> str:
    if isinstance(x, ast.JoinedStr):
        return "fstring"
    if isinstance(x, ast.BinOp):
        return {ast.Add: "add", ast.Mod: "mod"}.get(type(x.op), "other")
    if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr == "format":
        return "format"
    return "name" if isinstance(x, ast.Name) else "other"


def _flag(k: ast.keyword) -> str:
    if isinstance(k.value, ast.Constant):
        return f"{k.arg}={k.value.value!r}"
    return f"{k.arg}:list" if isinstance(k.value, (ast.List, ast.Tuple)) else f"{k.arg}"


def _facts(n) -> dict:
    """What the checks ask of a node, beyond its place: name, size, value, shape, names, flags."""
    if isinstance(n, _FUNCTIONS):
        return {"name": n.name, "size": len(n.args.args)}
    if isinstance(n, ast.ClassDef):
        return {"name": n.name, "size": sum(isinstance(c, _FUNCTIONS) for c in n.body), "end_line": n.body[-1].end_lineno}
    if isinstance(n, ast.Name):
        return {"name": n.id, "shape": type(n.ctx).__name__}
    if isinstance(n, ast.alias):
        return {"name": n.asname or n.name.split(".")[0], "shape": n.name}
    if isinstance(n, ast.Import):
        return {"names": [a.name for a in n.names]}
    if isinstance(n, ast.ImportFrom):
        return {"name": n.module, "size": n.level, "names": [a.name for a in n.names]}
    if isinstance(n, ast.BoolOp):
        return {"size": len(n.values) - 1}
    if isinstance(n, ast.Try):
        return {"size": len(n.handlers)}
    if isinstance(n, ast.ExceptHandler):
        return {"name": n.type.id if isinstance(n.type, ast.Name) else None, "shape": "bare" if n.type is None else "typed"}
    if isinstance(n, ast.Constant) and type(n.value) in (int, float):
        return {"value": float(n.value) if abs(n.value) < 1e300 else float("inf")}
    if isinstance(n, ast.Assign):
        bound = [e for t in n.targets for e in (t.elts if isinstance(t, ast.Tuple) else [t])]
        whole = [t.id for t in n.targets if isinstance(t, ast.Name)] if isinstance(n.value, ast.Call) else []
        return {"names": [e.id for e in bound if isinstance(e, ast.Name)], "flags": whole, "shape": _dotted(n.value.func) if isinstance(n.value, ast.Call) else None}
    if isinstance(n, ast.Call):
        first = n.args[0] if n.args else None
        inner = sorted({x.id for x in ast.walk(first) if isinstance(x, ast.Name)}) if first is not None else []
        return {"name": _dotted(n.func), "shape": _shape(first) if n.args else None, "names": inner, "flags": [_flag(k) for k in n.keywords]}
    return {}


def tree_rows(text: str | None, kinds=None):
    """Rows of one file's nodes, or of those of some kinds, parents before children; the depth is held in a list, not in the call stack."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        line = getattr(e, "lineno", None) or 1
        if kinds is None or "SyntaxError" in kinds:
            yield {"node": 0, "kind": "SyntaxError", "line": line}
        return
    if kinds is not None and set(kinds) == {"SyntaxError"}:
        return
    at, stack = 0, [(tree, None, None, 0, (), 1)]
    while stack:
        n, parent, parent_kind, loops, functions, line = stack.pop()
        kind = type(n).__name__
        line = getattr(n, "lineno", line)
        if isinstance(n, _LOOPS):
            loops += 1
        elif isinstance(n, _FUNCTIONS):
            functions = (*functions, at)
        if kinds is None or kind in kinds:
            yield {"node": at, "parent": parent, "parent_kind": parent_kind, "kind": kind, "line": line, "end_line": getattr(n, "end_lineno", line), "loops": loops, "functions": functions} | _facts(n)
        for f in n._fields:
            c = getattr(n, f, None)
            if isinstance(c, ast.AST):
                stack.append((c, at, kind, loops, functions, line))
            elif isinstance(c, list):
                stack += [(x, at, kind, loops, functions, line) for x in c if isinstance(x, ast.AST)]
        at += 1


def _holds(text: Column, hint: str) -> Column:
    """Whether a text holds a sign, or a keyword as a whole word; the plain search goes first, as few texts need the slow one."""
    plain = text.contains(hint)
    return plain & text.rlike(f"(?<![A-Za-z0-9_]){hint}(?![A-Za-z0-9_])") if hint.isalpha() else plain


def nodes(files: DataFrame, need: str | None = None, batch_rows: int = 20_000) -> DataFrame:
    """doc_id and a row per node of the files' trees; batches of bounded size, so a long file doesn't fill a task.

    need names a check of NEEDS: then only its kinds of nodes and its columns are made; names that a file loads again, and constants that are no numbers, are left out, and files without any of its HINTS aren't parsed.
    The parser keeps every name that it meets as long as the Python worker lives; files passed over cost no memory there.
    """
    kept = files.select("doc_id", "text")
    if need in HINTS:
        kept = kept.where(reduce(or_, (_holds(F.col("text"), h) for h in HINTS[need])))
    kinds, columns = NEEDS[need] if need else (None, None)
    fields = [f for f in StructType.fromDDL(_NODE).fields if columns is None or f.name in columns or f.name == "kind"]
    schema = StructType([StructField("doc_id", kept.schema["doc_id"].dataType), *fields])
    names = [f.name for f in fields]

    def rows(text):
        loaded = set()
        for row in tree_rows(text, kinds):
            if need == "unused" and row["kind"] == "Name":
                if row["shape"] != "Load" or row["name"] in loaded:
                    continue
                loaded.add(row["name"])
            if need == "sizes" and row["kind"] == "Constant" and "value" not in row:
                continue
            yield tuple(map(row.get, names))

    def parse(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def full(ids, held):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, *zip(*held, strict=True)), arrow.types, strict=True)], schema=arrow)

        ids, held = [], []
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                key = i.as_py()
                for row in rows(text.as_py()):
                    ids.append(key)
                    held.append(row)
                    if len(held) >= batch_rows:
                        yield full(ids, held)
                        ids, held = [], []
        if held:
            yield full(ids, held)

    return kept.mapInArrow(parse, schema)


def _issue(table: DataFrame, issue, severity) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return table.select("doc_id", F.col("line").alias("line_no"), as_col(issue).alias("issue"), as_col(severity).alias("severity"))


def _of(tree: DataFrame, *kinds: str) -> DataFrame:
    return tree.where(F.col("kind").isin(*kinds))


def complexity(tree: DataFrame, strict: bool = True) -> DataFrame:
    """doc_id, name, line_no, end_line, complexity of every function, inner functions counted in the outer ones too.

    strict counts break, continue and except clauses as well.
    """
    kind = F.col("kind")
    points = F.when(kind.isin("If", "While", "For", "AsyncFor"), 1).when(kind == "BoolOp", F.col("size"))
    if strict:
        points = points.when(kind.isin("Break", "Continue"), 1).when(kind == "Try", F.col("size"))
    inside = tree.select("doc_id", F.explode("functions").alias("function"), F.coalesce(points, F.lit(0)).alias("p"), F.when(F.col("node") == F.col("function"), F.struct("name", "line", "end_line")).alias("head"))
    got = inside.groupBy("doc_id", "function").agg((F.sum("p") + 1).alias("complexity"), F.first("head", ignorenulls=True).alias("head"))
    return got.select("doc_id", "head.name", F.col("head.line").alias("line_no"), F.col("head.end_line").alias("end_line"), "complexity")


def complex_functions(tree: DataFrame, strict: bool = True) -> DataFrame:
    """Functions above MAX_COMPLEXITY: the sixth built-in rule if strict, else the looser check."""
    got = complexity(tree, strict).where(F.col("complexity") > MAX_COMPLEXITY)
    return got.select("doc_id", "line_no", F.lit("Function Complexity" if strict else "Complex Function").alias("issue"), F.lit("medium").alias("severity"))


def syntax_errors(tree: DataFrame) -> DataFrame:
    return _issue(_of(tree, "SyntaxError"), "Syntax Error", "error")


def unused(tree: DataFrame) -> DataFrame:
    """Imports and variables that are loaded nowhere in their file; variables aside that are self, cls or begin with an underscore."""
    kind, none = F.col("kind"), F.array().cast("array<struct<name:string,line:int,issue:string>>")
    row = lambda name, line, issue: F.struct(name.alias("name"), line.cast("int").alias("line"), issue.cast("string").alias("issue"))
    bound = F.filter("names", lambda n: ~n.isin("self", "cls") & ~n.startswith("_"))
    rows = F.when((kind == "Name") & (F.col("shape") == "Load"), F.array(row(F.col("name"), F.lit(None), F.lit(None))))
    rows = rows.when((kind == "alias") & (F.col("name") != "*"), F.array(row(F.col("name"), F.col("line"), F.lit("Unused Import"))))
    rows = rows.when(kind == "Assign", F.transform(bound, lambda n: row(n, F.col("line"), F.lit("Unused Variable")))).otherwise(none)
    # one pass over the tree: a name's loads meet its bindings in its file
    named = _of(tree, "Name", "alias", "Assign").select("doc_id", F.inline(rows)).groupBy("doc_id", "name")
    lost = named.agg(F.max(F.col("issue").isNull()).alias("used"), F.collect_list(F.when(F.col("issue").isNotNull(), F.struct("line", "issue"))).alias("at")).where("not used")
    return _issue(lost.select("doc_id", F.inline("at")), F.col("issue"), "info")


def sizes(tree: DataFrame) -> DataFrame:
    """Deep loops, large classes, long functions, long parameter lists, bare and broad except clauses, magic numbers."""
    n_lines = F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(1))
    kind, size = F.col("kind"), F.col("size")
    function, number = kind.isin("FunctionDef", "AsyncFunctionDef"), (kind == "Constant") & F.col("value").isNotNull()
    checks = (
        (kind.isin("For", "While", "AsyncFor") & (F.col("loops") >= LOOP_DEPTH), "Deeply Nested Loops", "medium"),
        ((kind == "ClassDef") & (size > MAX_METHODS), "Large Class (Methods)", "medium"),
        ((kind == "ClassDef") & (n_lines > MAX_CLASS_LINES), "Large Class (Lines)", "medium"),
        (function & (n_lines > MAX_FUNCTION_LINES), "Long Function/Method", "low"),
        (function & (size > MAX_PARAMETERS), "Long Parameter List", "medium"),
        ((kind == "ExceptHandler") & (F.col("shape") == "bare"), "Bare Except", "medium"),
        ((kind == "ExceptHandler") & (F.col("name") == "Exception"), "Broad Exception Handling", "low"),
        (number & (F.col("parent_kind") != "Assign") & ~F.col("value").isin(*map(float, PLAIN_NUMBERS)), "Magic Number", "info"),
    )
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(i).alias("issue"), F.lit(s).alias("severity"))) for c, i, s in checks)), lambda x: x.isNotNull())
    return tree.select("doc_id", F.col("line").alias("line_no"), F.inline(found))


def dangerous_calls(tree: DataFrame) -> DataFrame:
    """Calls that run SQL, commands, loaders, files, tokens, weak hashes or code; a call counts for the first kind in CALLS that its name fits.

    Tainted are names that the file assigns directly from a call to one of SOURCES.
    """
    low, shape, flag = F.lower("name"), F.col("shape"), lambda x: F.array_contains("flags", x)
    fits = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    group = None
    for g, words in CALLS:
        group = (F if group is None else group).when(fits(low, words), g)
    group = group.when(F.col("name").isin("eval", "exec"), "code")
    # one pass over the tree: a file's calls meet the names that it taints
    source = (F.col("kind") == "Assign") & F.col("shape").isNotNull() & fits(F.col("shape"), SOURCES)
    rows = _of(tree, "Call", "Assign").withColumn("group", F.when((F.col("kind") == "Call") & F.col("name").isNotNull(), group)).where(F.col("group").isNotNull() | source)
    tainted = F.flatten(F.collect_set(F.when(source, F.col("flags"))).over(Window.partitionBy("doc_id")))
    call = rows.withColumn("_tainted", tainted).where("group is not null").withColumn("_t", F.arrays_overlap("names", "_tainted"))
    g, bad = F.col("group"), F.coalesce(F.col("_t"), F.lit(False))
    checks = (
        ((g == "sql") & shape.isin("fstring", "add", "mod", "format"), F.lit("SQL Injection"), "critical"),
        ((g == "command") & flag("shell=True"), F.lit("Command Injection Risk"), "high"),
        ((g == "command") & shape.isin("add", "fstring", "format"), F.lit("Command Injection"), "critical"),
        (g == "load", F.lit("Insecure Deserialization"), "high"),
        ((g == "file") & bad & shape.isin("name", "add"), F.lit("Path Traversal"), "high"),
        ((g == "jwt") & flag("verify=False"), F.lit("Insecure JWT Verification"), "high"),
        ((g == "jwt") & ~flag("algorithms:list"), F.lit("JWT Algorithm Vulnerability"), "medium"),
        (g == "hash", F.lit("Weak Hashing Algorithm"), "medium"),
        (g == "code", F.concat(F.lit("Use of "), "name"), "high"),
        ((g == "code") & bad, F.concat(F.lit("Dangerous "), "name", F.lit(" with tainted data")), "critical"),
    )
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(i.alias("issue"), F.lit(s).alias("severity"))) for c, i, s in checks)), lambda x: x.isNotNull())
    return call.select("doc_id", F.col("line").alias("line_no"), F.inline(found))


def imports(tree: DataFrame) -> DataFrame:
    """doc_id, module, level (leading dots) and distinct: what each file imports; 'from . import x' gives module x."""
    # one pass over the tree: a statement's row holds all that it imports
    each = F.transform("names", lambda n: F.struct(F.coalesce("name", n).alias("module"), F.coalesce("size", F.lit(0)).alias("level")))
    return _of(tree, "Import", "ImportFrom").select("doc_id", F.inline(each)).distinct()
