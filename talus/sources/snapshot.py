"""Keyed tables kept in versions.

A version is a numbered folder that Spark writes; it counts once the writer's
job has committed, which Spark marks by a _SUCCESS file as its last act. A write
that is killed leaves a folder without the mark: readers stay with the version
before, and the next write takes the next number. Writers at the same time
can't share a number, since Spark refuses to write to a folder that exists.

Defined cases: without a version the table is empty, with the columns asked
for; of rows that repeat a key in one merge the last by the order column stays,
ties to the greatest row; a null in a key is a value of its own; an empty merge
still makes a version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshot:
    """A versioned table at a path, with one row for each key."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], columns: str):
        self.spark, self.path, self.keys, self.columns = spark, path.rstrip("/"), keys, columns

    def _folders(self) -> dict[int, bool]:
        """Version numbers, and whether each is committed."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return {}
        found = {}
        for f in files.listStatus(at):
            name = f.getPath().getName()
            if name.startswith("v") and name[1:].isdigit():
                found[int(name[1:])] = files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))
        return found

    def version(self) -> int | None:
        return max((v for v, done in self._folders().items() if done), default=None)

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v is None:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).parquet(f"{self.path}/v{v}")

    def _same(self, a: str, b: str) -> Column:
        return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in self.keys))

    def _write(self, rows: DataFrame) -> int:
        v = max(self._folders(), default=0) + 1
        rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/v{v}")
        return v

    def merge(self, rows: DataFrame, order: str | None = None) -> int:
        """A new version in which rows replace or join those of their keys; its number."""
        names = self.spark.createDataFrame([], self.columns).columns
        rest = [c for c in names if c not in self.keys]
        by = F.struct(*([order] if order else []), *rest)
        new = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*self.keys, "_r.*").select(*names)
        kept = self.read().alias("a").join(new.alias("b"), self._same("a", "b"), "left_anti")
        return self._write(kept.unionByName(new))

    def remove(self, condition: Column) -> int:
        """A new version without the rows that fulfil the condition, such as expired ones; its number."""
        return self._write(self.read().where(~F.coalesce(condition, F.lit(False))))

    def changed(self, rows: DataFrame, mark: str) -> DataFrame:
        """Rows whose key the table lacks or holds with another mark; a null mark always counts as changed."""
        known = self.read().select(*self.keys, mark)
        same = self._same("a", "b") & (F.col(f"a.{mark}") == F.col(f"b.{mark}"))
        return rows.alias("a").join(known.alias("b"), same, "left_anti")

    def stats(self, value: str, now: Column | None = None, expiry: str | None = None) -> DataFrame:
        """n_entries, n_expired, n_bytes (of the value's UTF-8) of the present version."""
        late = F.coalesce(F.col(expiry) < now, F.lit(False)) if expiry and now is not None else F.lit(False)
        return self.read().agg(F.count("*").alias("n_entries"), F.count(F.when(late, 1)).alias("n_expired"), F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).cast("long").alias("n_bytes"))


def changed_files(files: DataFrame, path: str) -> DataFrame:
    """The files (path, md5) that are new or changed since the last run that was kept at path."""
    return Snapshot(files.sparkSession, path, ["path"], "path string, md5 string").changed(files, "md5")


def keep_files(files: DataFrame, path: str) -> int:
    """Keep the files' hashes for the next run."""
    return Snapshot(files.sparkSession, path, ["path"], "path string, md5 string").merge(files.select("path", "md5"))
