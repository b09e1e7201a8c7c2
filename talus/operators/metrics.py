"""Usage and error metrics over a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPE, VALUE, TS = "event_type", "value", "ts"


def usage(events: DataFrame) -> DataFrame:
    """Per event type: n_events, n_users, total and average value (null values count in n_events only)."""
    return events.groupBy(TYPE).agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"), F.round(F.sum(VALUE), 4).alias("total_value"), F.round(F.avg(VALUE), 6).alias("avg_value"))


def by_date(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format(TS, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n_events"), F.count_if(F.col(TYPE) == "error").alias("n_errors"))


def cache_stats(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """Accesses as cache reads by user: a hit if the user's last access is at most ttl_seconds ago."""
    from pyspark.sql import Window as W

    before = F.lag("s").over(W.partitionBy("user_id").orderBy("s", "event_id"))
    got = events.select("user_id", "event_id", F.unix_timestamp(F.col(TS).cast("timestamp")).alias("s")).withColumn("b", before)
    hit = F.coalesce(F.col("s") - F.col("b") <= ttl_seconds, F.lit(False))
    return got.agg(F.count("*").alias("accesses"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.countDistinct("user_id").alias("entries"))
