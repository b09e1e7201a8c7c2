"""The corpus as tables of files and lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import lines

#: Languages by file extension.
LANGUAGES = {
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "jsx": "javascript",
    "tsx": "typescript",
    "java": "java",
    "c": "c",
    "cpp": "cpp",
    "h": "c",
    "hpp": "cpp",
    "cs": "csharp",
    "go": "go",
    "rb": "ruby",
    "php": "php",
    "swift": "swift",
    "kt": "kotlin",
    "rs": "rust",
    "md": "markdown",
    "html": "html",
    "css": "css",
    "scss": "scss",
    "json": "json",
    "yml": "yaml",
    "yaml": "yaml",
    "xml": "xml",
}


def files(documents: DataFrame) -> DataFrame:
    """documents as files: doc_id, path, language, text."""
    return documents.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), "text")


def explode_lines(table: DataFrame, text: str = "text", cut=lines) -> DataFrame:
    """One row per line with line_no from 1 and line; the text is left out. cut: lines or split_lines of talus.functions.text."""
    return table.select("*", F.posexplode(cut(F.col(text))).alias("_at", "line")).withColumn("line_no", F.col("_at") + 1).drop("_at", text)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in sorted(LANGUAGES.items()) for x in kv))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def glob_regex(glob: str) -> str:
    """A path pattern with * and ? as an anchored regular expression."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def excluded(path: Column, globs) -> Column:
    return reduce(lambda a, g: a | path.rlike(glob_regex(g)), globs, F.lit(False))


def adaptive_chunk_size(n_bytes: Column, size: int = 1000, low: int = 512, high: int = 8192) -> Column:
    """Chunk size by the size of a text."""
    mib = 1 << 20
    return F.when(n_bytes > 5 * mib, min(size, 2048)).when(n_bytes > mib, min(size, 4096)).otherwise(max(low, min(size, high))).cast("long")
