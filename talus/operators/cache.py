"""Content hashes, and an access log read as a keyed cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_hash(files: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return files.select("doc_id", F.sha2(F.concat_ws(":", "path", text), 256).alias("cache_key"), F.md5(text).alias("md5"))


def changed(files: DataFrame, snapshot: DataFrame, keys=("md5",)) -> DataFrame:
    """Rows of files that the snapshot doesn't hold."""
    return files.join(snapshot.select(*keys).distinct(), list(keys), "left_anti")


def latest(log: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The last row of each key; an aggregation, so a hot key is combined before the shuffle."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_r")).select(key, "_r.*")


def expired(entries: DataFrame, ts: str, now, ttl_seconds: int) -> DataFrame:
    return entries.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp")) > ttl_seconds)


def lru_keep(log: DataFrame, key: str, ts: str, items: int) -> DataFrame:
    """The items keys used last, with their rank; ties to the smaller key."""
    last = log.groupBy(key).agg(F.max(ts).alias("last_access"), F.count("*").alias("access_count"))
    top = last.orderBy(F.col("last_access").desc(), key).limit(items)
    return top.withColumn("lru_rank", F.row_number().over(W.orderBy(F.col("last_access").desc(), key)))  # of items rows
