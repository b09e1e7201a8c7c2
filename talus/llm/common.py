"""Shared storage and connected components for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import PART_ROWS, parts

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode, if the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="talus-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and return it as read back, with its path: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(*paths: str) -> None:
    """Remove scratch tables. Where pyarrow knows no client for the file system they stay, to be cleared with the folder."""
    from pyarrow import ArrowException, fs

    for p in paths:
        try:
            files, at = fs.FileSystem.from_uri(p if "://" in p else f"file://{p}")
            files.delete_dir(at)
        except (ArrowException, OSError):
            continue


def bitmap(df: DataFrame, key: str, log2_bits: int = 22) -> DataFrame:
    """The hashes of a column as words of a bitmap: at most 2^log2_bits / 64 rows, whatever df holds.

    Columns: word long, bits long. A key whose bit is unset is surely absent from df.
    """
    h = _bit_of(F.col(key), log2_bits)
    return df.select(F.shiftright(h, 6).alias("word"), h.bitwiseAND(F.lit(63)).cast("int").alias("_bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("bits"))


def maybe_in(bits: DataFrame, df: DataFrame, key: str, flag: str, log2_bits: int = 22) -> DataFrame:
    """df with a boolean column: false means that the key is surely not in the bitmap."""
    h = _bit_of(F.col(key), log2_bits)
    out = df.withColumn("_word", F.shiftright(h, 6)).withColumn("_bit", h.bitwiseAND(F.lit(63)).cast("int"))
    side = F.broadcast(bits.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))  # at most 2^16 rows
    return out.join(side, "_word", "left").withColumn(flag, F.expr("coalesce(shiftright(_bits, _bit) & 1, 0) = 1")).drop("_word", "_bit", "_bits")


def _bit_of(key, log2_bits: int):
    return F.xxhash64(key).bitwiseAND(F.lit((1 << log2_bits) - 1))


def components(edges: DataFrame, label: str = "cc", task_edges: int = 1 << 20, tasks: int | None = None, native: bool = False) -> tuple[DataFrame, str]:
    """Connected components of undirected edges (src, dst), as (node, component).

    component is the smallest node of the component. Nodes without an edge to
    another node don't appear. First every task joins about task_edges edges
    into stars by itself, as many tasks as that takes; where one task is enough,
    nothing remains to be done. Elsewhere large-star and small-star steps
    alternate, each a partial aggregation and a join whose large side Spark may
    split, so a hub is no hot task. Every round is written to the shared folder;
    the older round is removed. Also returns the path of the result, to be
    discarded. tasks: those that write the edges first, where their number is
    known to be small. native: DataFrame functions alone, so only the steps.
    """
    now = edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, path = stored(now.coalesce(tasks) if tasks else now, label)
    tasks = -(-now.count() // task_edges)
    if tasks and not native:
        new, new_path_ = stored(now.coalesce(tasks).mapInArrow(_joined_up, now.schema), label)
        discard(path)
        now, path = new, new_path_
    while tasks > (0 if native else 1) and not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new, new_path_ = stored(small, label)
        discard(path)
        now, path = new, new_path_
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")), path


def _joined_up(batches):
    """The edges (u, v) of a task as stars: every node with the smallest one of its component there."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    both = pa.chunked_array([*t.column("u").chunks, *t.column("v").chunks]).combine_chunks()
    kind = both.type
    # numbers of the nodes in their order
    nodes = both.unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    number = np.asarray(pc.index_in(both, nodes))
    a, b = number[: t.num_rows].astype(np.int64), number[t.num_rows :].astype(np.int64)
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while True:  # roots of roots
            further = root[root]
            if (further == root).all():
                break
            root = further
    some = np.flatnonzero(root != np.arange(len(nodes)))
    for at in range(0, len(some), 1 << 16):
        k = some[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(k)).cast(kind), nodes.take(pa.array(root[k])).cast(kind)], names=["u", "v"])


def _stars(edges: DataFrame) -> bool:
    """Whether every u of the edges (u, v), u > v, has one v, which is no u itself."""
    ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.lit(None).cast(edges.schema["v"].dataType).alias("v")))
    return ends.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("k"), F.count("v").alias("out")).where("out > 0 and (a <> b or k > out)").isEmpty()


def small_batches(spark: SparkSession, rows: int = PART_ROWS) -> None:
    """Arrow batches of some rows, where the session keeps Spark's default of 10,000: so many long texts fill a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def with_columns(df: DataFrame, make, ddl: str) -> DataFrame:
    """df with more columns: make(record batch) gives their arrays. Columns of these names are replaced.

    One pass over the rows in Arrow batches; nothing is shuffled.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    small_batches(df.sparkSession)
    fields = T.StructType.fromDDL(ddl).fields
    df = df.drop(*(f.name for f in fields))
    schema = T.StructType(df.schema.fields + fields)

    def run(batches):
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, *make(b)], names=schema.names)

    return df.mapInArrow(run, schema)


def apart(docs: DataFrame, needs: list[str], run) -> DataFrame:
    """run over the columns in needs alone, all others kept aside in a struct, so that no helper column can clash with them; the columns of docs come back."""
    rest = [c for c in docs.columns if c not in needs]
    some = docs.select(*needs, *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest")] if rest else []))
    return run(some).select(*(F.col(c) if c in needs else F.col("_rest").getField(c).alias(c) for c in docs.columns))
