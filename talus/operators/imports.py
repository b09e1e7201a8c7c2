"""Import statements of a table of files (path, text), and the files they name.

Paths are relative to the project's root, with slashes. Requests for a target
are made distinct before candidates are: each request explodes to candidate
keys with a priority, one join against the keys of all files and folders keeps
those that exist, and the first of them wins. So a module that a third of all
files import is looked up once, and only the last join holds its importers;
its other side has one row a request, which Spark may split the importers for.
Requests and what they name are read several times and so written first: a file
is parsed once.

Defined cases: a null path or text has no imports; a file of no known extension
is a target only; a file that doesn't parse is read line by line; repeated paths
add nothing; a file's import of itself is no edge; an empty table gives no rows.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.sources.scratch import discard, stored

#: Modules that are never looked up, and script extensions in the order in which they are tried.
STANDARD = ("os", "sys", "re", "json", "time", "datetime", "pathlib", "collections", "typing", "logging", "math", "random", "sqlite3", "io", "tempfile", "traceback", "unittest")
SCRIPTS = ("", ".js", ".jsx", ".ts", ".tsx")
#: Import and require in scripts.
SCRIPT_IMPORT = r"""import\s+(?:[^;]+\s+from\s+)?['"]([^'";]+)['"]"""
SCRIPT_REQUIRE = r"""require\s*\(\s*['"]([^'")]+)['"]\s*\)"""
#: A file that doesn't parse: imports at the beginning of a line, up to its end.
_PLAIN = re.compile(r"^(?:from[ \t]+([\w.]+)[ \t]+import|import[ \t]+([\w., \t]+))", re.MULTILINE)

_STATEMENT = "path string, module string, level int, names array<string>"


def import_rows(text: str):
    """(module, level, names) of each import of a Python source; names is None for a plain import."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        for named, plain in _PLAIN.findall(text):
            yield from [(named, 0, None)] if named else ((m.strip(), 0, None) for m in plain.split(",") if m.strip())
        return
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            yield from ((a.name, 0, None) for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            yield n.module, n.level, [a.name for a in n.names]


def python_imports(files: DataFrame) -> DataFrame:
    """path, module, level, names of the imports of .py files."""

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("module", pa.string()), ("level", pa.int32()), ("names", pa.list_(pa.string()))])
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                some = b.slice(at, 1_000)
                rows = [{"path": p, "module": m, "level": k, "names": n} for p, t in zip(some.column(0).to_pylist(), some.column(1), strict=True) for m, k, n in import_rows(t.as_py())]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.where(F.col("path").endswith(".py") & F.col("text").isNotNull()).select("path", "text").mapInArrow(run, _STATEMENT)


def folder_of(path: Column) -> Column:
    """The folder of a path; the root's is empty."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def joined(*parts: Column) -> Column:
    """Path parts joined by slashes, empty ones left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")


def normal(path: Column) -> Column:
    """path without empty and . parts, .. taken back; null above the root."""
    none = F.lit(None).cast("array<string>")
    step = lambda have, p: F.when(p.isin("", "."), have).when(p != "..", F.array_append(have, p)).when(F.size(have) > 0, F.slice(have, F.lit(1), F.size(have) - 1)).otherwise(none)
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda have, p: F.when(have.isNull(), none).otherwise(step(have, p))), "/")


def above(folder: Column, levels: Column) -> Column:
    """The folder so many levels up; null above the root."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.when(levels <= F.size(parts), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - levels), "/"))


def python_requests(files: DataFrame) -> DataFrame:
    """src, kind, what, gate: what each import of Python files asks for.

    kind module: a dotted name; folder, file: a path without extension. A row
    with a gate counts only where the gate's module is found elsewhere than in
    src itself: the names taken from a module may be its submodules.
    """
    i = python_imports(files)
    here = above(folder_of(F.col("path")), F.col("level") - 1)
    ask = lambda kind, what, gate=None: F.struct(F.lit(kind).alias("kind"), what.alias("what"), (F.lit(None).cast("string") if gate is None else gate).alias("gate"))
    module, names = F.col("module"), F.coalesce("names", F.array().cast("array<string>"))
    star = F.array_contains(names, "*")
    inside = F.when(F.col("level") > 0, joined(here, F.coalesce(F.replace(module, F.lit("."), F.lit("/")), F.lit(""))))
    plain = F.concat(F.array(ask("module", module)), F.when(star, F.array().cast("array<struct<kind:string,what:string,gate:string>>")).otherwise(F.transform(names, lambda n: ask("module", F.concat_ws(".", module, n), module))))
    beside = F.concat(F.array(ask("folder", inside), ask("file", F.when(module.isNotNull(), inside))), F.transform(names, lambda n: ask("file", joined(inside, n))))
    rows = i.select(F.col("path").alias("src"), F.explode(F.when(F.col("level") > 0, beside).otherwise(plain)).alias("r")).select("src", "r.*")
    skip = (F.col("kind") == "module") & F.col("what").isin(*STANDARD)
    return rows.where(F.col("what").isNotNull() & ~skip).distinct()


def script_requests(files: DataFrame) -> DataFrame:
    """src, kind, what, gate: the relative and rooted paths that scripts import or require."""
    some = files.where(F.col("path").rlike(r"\.(js|jsx|ts|tsx)$"))
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (SCRIPT_IMPORT, SCRIPT_REQUIRE)))
    # only texts that hold one of the words are searched
    some = some.where(F.col("text").contains("import") | F.col("text").contains("require"))
    rows = some.select(F.col("path").alias("src"), F.explode(F.array_distinct(found)).alias("p")).where(F.col("p").rlike(r"^(\./|\.\./|/)"))
    what = F.when(F.col("p").startswith("/"), normal(F.col("p"))).otherwise(normal(F.concat_ws("/", folder_of(F.col("src")), "p")))
    return rows.select("src", F.lit("script").alias("kind"), what.alias("what"), F.lit(None).cast("string").alias("gate")).where("what is not null").distinct()


def targets(files: DataFrame) -> DataFrame:
    """key, dst: f:path of files, d:folder of all folders, m:folder of those with a Python file, i:folder of those with an __init__.py.

    A folder above others comes once for each folder below it that holds files.
    """
    path, folder = F.col("path"), F.col("folder")
    row = lambda mark, dst: F.struct(F.concat(F.lit(mark), dst).alias("key"), dst.alias("dst"))
    held = F.array(row("f:", path), row("d:", folder), F.when(path.endswith(".py"), row("m:", folder)), F.when(path.rlike(r"(^|/)__init__\.py$"), row("i:", folder)))
    rows = files.where("path is not null").select("path", folder_of(path).alias("folder")).select(F.explode(held).alias("t")).where("t is not null and t.dst <> ''").select("t.*").distinct()
    parts = F.split("dst", "/")
    above_it = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: row("d:", F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return rows.select(F.explode(F.when(F.col("key").startswith("d:"), above_it).otherwise(F.array(F.struct("key", "dst")))).alias("t")).where("t.dst <> ''").select("t.*")


def _candidates() -> Column:
    """Keys of a request (kind, what) in the order in which they are tried."""
    what = F.col("what")
    path = F.replace(what, F.lit("."), F.lit("/"))
    parts = F.split(what, r"\.")
    shorter = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    key = lambda mark, c, end="": F.concat(F.lit(mark), c, F.lit(end))
    module = F.concat(F.array(key("m:", path), key("f:", path, ".py")), F.flatten(F.transform(shorter, lambda p: F.array(key("f:", p, ".py"), key("i:", p)))))
    script = F.array(*(k for e in SCRIPTS for k in (key("f:", what, e), key("f:", what, f"/index{e}"))))
    return F.when(F.col("kind") == "module", module).when(F.col("kind") == "folder", F.array(key("d:", what))).when(F.col("kind") == "file", F.array(key("f:", what, ".py"))).otherwise(script)


def resolved(requests: DataFrame, files: DataFrame) -> DataFrame:
    """kind, what, dst of the distinct requests that name something in the project."""
    one = requests.select("kind", "what").union(requests.where("gate is not null").select(F.lit("module"), "gate")).distinct()
    tried = one.select("kind", "what", F.posexplode(_candidates()).alias("at", "key"))
    return tried.join(targets(files), "key").groupBy("kind", "what").agg(F.min_by("dst", "at").alias("dst"))


def import_edges(files: DataFrame, scripts: bool = True, python: bool = True) -> DataFrame:
    """Distinct (src, dst): src imports the file or package folder dst."""
    some = [make(files) for make, wanted in ((python_requests, python), (script_requests, scripts)) if wanted]
    requests, requests_path = stored(some[0] if len(some) == 1 else some[0].unionByName(some[1]), "import-requests")
    found, found_path = stored(resolved(requests, files), "import-targets")
    gates = found.where("kind = 'module'").select(F.col("what").alias("gate"), F.col("dst").alias("gate_dst"))
    edges = requests.join(found, ["kind", "what"]).join(gates, "gate", "left")
    open_ = F.col("gate").isNull() | (F.col("gate_dst") != F.col("src"))
    out, _ = stored(edges.where(open_ & (F.col("dst") != F.col("src"))).select("src", "dst").distinct(), "import-edges")
    discard(files.sparkSession, requests_path, found_path)
    return out
