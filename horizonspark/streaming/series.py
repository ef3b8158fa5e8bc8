"""Windowed totals of an event stream, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, demand, n of each window; events later than `late` are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(F.sum("value").alias("demand"), F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "demand", "n")


def keep_table(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each window once it can't change any more; runs through what is there and stops."""
    return totals.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
