"""Source trees as tables: a data source that walks folders on the executors.

The driver lists only the top of the tree, until it has a few hundred folders;
each of them is a partition, whose task walks what lies below, leaves out
excluded folders without entering them and excluded files without opening them,
and hands the rest on in small batches. Spark's own file sources pass over names
that begin with an underscore or a dot, and so over __init__.py; this one
doesn't. Any file system that pyarrow opens by its URI will do.

Rows: path (relative, with slashes), size, modified, binary, md5, text. A file
is binary by its extension or by a NUL in its first 1,024 bytes; its text is
null. Bytes that are no UTF-8 are replaced, or dropped with errors=ignore.

Defined cases: empty files, unless binary, and binary files by extension above
100 MiB are left out; a file that vanishes or can't be read has a row with null
md5 and text; a link to a folder isn't followed where the file system tells it
apart; an empty tree gives no rows; a missing root raises.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders and files left out by default, extensions of binary files, of sources with imports, sizes.
EXCLUDED = (
    "**/.git/",
    "**/.svn/",
    "**/.hg/",
    "**/node_modules/",
    "**/bower_components/",
    "**/vendor/",
    "**/build/",
    "**/dist/",
    "**/target/",
    "**/.fingerprint/",
    "**/debug/",
    "**/release/",
    "**/__pycache__/",
    "**/*.pyc",
    "**/*.pyo",
    "**/*.png",
    "**/*.jpg",
    "**/*.jpeg",
    "**/*.gif",
    "**/*.ico",
    "**/*.svg",
    "**/*.ttf",
    "**/*.woff",
    "**/*.pdf",
    "**/*.zip",
    "**/*.gz",
    "**/*.tar",
    "**/*.mp3",
    "**/*.mp4",
    "**/*.wav",
    "**/*.mov",
)
BINARY = (".bin", ".lock", ".part.bin", ".o", ".so", ".dylib", ".dll")
IMPORTING = (".py", ".js", ".jsx", ".ts", ".tsx")
MOST_BINARY = 100 << 20
NUL_BYTES = 1_024
#: Folders from which partitions are made; bytes and rows of a batch.
FOLDERS = 256
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1_000

DDL = "path string, size long, modified timestamp, binary boolean, md5 string, text string"


def glob_pattern(glob: str) -> str:
    """A path pattern as an anchored regular expression: ** stands for any folders, * and ? stay inside one name, and a pattern that ends with a slash covers all below."""
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        else:
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[at], re.escape(glob[at])), at + 1
    return f"^{out}{'.*' if glob.endswith('/') else ''}$"


def plain_pattern(glob: str) -> str:
    """A pattern whose * and ? take slashes too."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


FLAVOURS = {"path": glob_pattern, "plain": plain_pattern, "regex": lambda p: f"^(?:{p})"}


class _Walk:
    """What the options say, for the driver and the tasks."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.types = tuple(t if t.startswith(".") else f".{t}" for t in json.loads(options.get("types", "[]")))
        self.flavour = options.get("flavour", "path")
        exclude = json.loads(options.get("exclude", "[]"))
        self.exclude = re.compile("|".join(FLAVOURS[self.flavour](p) for p in exclude), re.S) if exclude else None
        self.errors = options.get("errors", "replace")

    def system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{posixpath.abspath(self.root)}")

    def listed(self, files, base: str, folder: str):
        """(folders, files) of a folder by name, without what is excluded."""
        from pyarrow import fs

        folders, some = [], []
        for f in sorted(files.get_file_info(fs.FileSelector(posixpath.join(base, folder) if folder else base)), key=lambda f: f.base_name):
            path = posixpath.join(folder, f.base_name)
            if f.type == fs.FileType.Directory:
                if not (self.exclude and self.flavour == "path" and self.exclude.match(f"{path}/")):
                    folders.append(path)
            elif f.type == fs.FileType.File and not (self.exclude and self.exclude.match(path)) and self.wanted(path, f.size):
                some.append((path, f))
        return folders, some

    def wanted(self, path: str, size: int) -> bool:
        end = posixpath.splitext(path)[1].lower()
        if self.types and end not in self.types:
            return False
        return not (end in BINARY and size > MOST_BINARY) and not (end not in BINARY and size == 0)


class _Folders(InputPartition):
    def __init__(self, folder: str, whole: bool):
        self.folder, self.whole = folder, whole


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """Folders breadth first; those that are already listed give their own files, the others all that lies below."""
        walk = _Walk(self.options)
        files, base = walk.system()
        listed, ahead = [], [""]
        while ahead and len(ahead) + len(listed) < FOLDERS:
            folder = ahead.pop(0)
            listed.append(folder)
            ahead += walk.listed(files, base, folder)[0]
        return [*(_Folders(f, False) for f in listed), *(_Folders(f, True) for f in ahead)]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        walk = _Walk(self.options)
        files, base = walk.system()
        ahead, rows, held = [partition.folder], [], 0
        while ahead:
            folders, some = walk.listed(files, base, ahead.pop())
            ahead += reversed(folders) if partition.whole else ()
            for path, info in some:
                rows.append(_row(files, path, info, walk.errors))
                held += info.size
                if held >= BATCH_BYTES or len(rows) == BATCH_ROWS:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _row(files, path: str, info, errors: str) -> dict:
    out = {"path": path, "size": info.size, "modified": info.mtime, "binary": posixpath.splitext(path)[1].lower() in BINARY, "md5": None, "text": None}
    try:
        with files.open_input_stream(info.path) as f:
            data = f.read()
    except OSError:
        return out
    out |= {"binary": out["binary"] or b"\0" in data[:NUL_BYTES], "md5": hashlib.md5(data).hexdigest()}
    return out | ({} if out["binary"] else {"text": data.decode("utf-8", errors)})


_SCHEMA = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("binary", pa.bool_()), ("md5", pa.string()), ("text", pa.string())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _SCHEMA)


class SourceTree(DataSource):
    """format("source_tree") with the options path, types, exclude (lists as JSON), flavour (path, plain or regex) and errors."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def scan(spark: SparkSession, root: str, types=(), exclude=EXCLUDED, flavour: str = "path", errors: str = "replace") -> DataFrame:
    """The files below root, of the extensions in types (with or without a dot; none: all)."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("types", json.dumps(list(types))).option("exclude", json.dumps(list(exclude))).option("flavour", flavour).option("errors", errors).load(root)


def dependency_walk(spark: SparkSession, root: str, exclude=()) -> DataFrame:
    """Sources that can import others; patterns take slashes."""
    return scan(spark, root, IMPORTING, exclude, "plain", "ignore")


def project_walk(spark: SparkSession, root: str, exclude=()) -> DataFrame:
    """Sources that can import others; exclusions are regular expressions at the beginning of the path."""
    return scan(spark, root, IMPORTING, exclude, "regex", "ignore")
