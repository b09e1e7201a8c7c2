"""Event metrics as a structured stream, run over what is available now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.sources.scratch import new_path


def hourly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts per hour and event type of a stream or a table of events.

    A stream's watermark lets it drop an hour's state once it is `late` behind, in the modes append and update; complete mode keeps all of them.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    got = timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n_events"))
    return got.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n_events")


def run_available(spark: SparkSession, path: str) -> DataFrame:
    """hourly_counts of the Parquet files at path, streamed; the state after the last batch, from a written table."""
    out, own = new_path(spark, "metrics"), new_path(spark, "metrics-state")
    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(table.schema)
    stream = source.parquet(path) if table.inputFiles() and not table.inputFiles()[0].endswith("/" + name) else source.option("pathGlobFilter", name).parquet(folder)
    got = hourly_counts(stream)
    last: list[int] = []

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{k}")
        last[:] = [k]

    got.writeStream.outputMode("complete").option("checkpointLocation", own).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(got.schema).parquet(f"{out}/{last[0]}") if last else spark.createDataFrame([], got.schema)
