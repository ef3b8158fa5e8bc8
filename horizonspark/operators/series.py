"""Splits, padding and checks of daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horizonspark.operators.history import day_spine


def pad_future(daily: DataFrame, days: int = 28) -> DataFrame:
    """The series with `days` more days of unknown demand and the last known capacity."""
    ends = daily.groupBy("series_id").agg(F.max("date").alias("last"), F.max_by("floortables", "date").alias("floortables"))
    ahead = ends.select("series_id", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("k"), "last", "floortables")
    return daily.select("series_id", "date", "demand", "floortables").unionByName(ahead.select("series_id", F.date_add("last", F.col("k")).alias("date"), F.lit(None).cast("double").alias("demand"), "floortables"))


def gaps(daily: DataFrame) -> DataFrame:
    """Days within a series' span without a row."""
    ends = daily.groupBy("series_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = ends.select("series_id", F.explode(F.sequence("a", "b")).alias("date"))
    return days.join(daily.select("series_id", "date"), ["series_id", "date"], "left_anti")


def _from_last():
    return F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("date").desc()))


def trailing(daily: DataFrame, n: int) -> DataFrame:
    return daily.withColumn("_n", _from_last()).where(F.col("_n") <= n).select("series_id", "date", "demand")


def holdout_split(daily: DataFrame, n: int) -> DataFrame:
    return daily.select("*", (_from_last() <= n).alias("in_holdout"))


def train_split(matrix: DataFrame, last: str | Column) -> DataFrame:
    """Rows to train on: known targets up to `last`."""
    last = F.lit(last).cast("date") if isinstance(last, str) else last
    return matrix.where((F.col("target_date") <= last) & F.col("y").isNotNull())


def coverage(daily: DataFrame) -> DataFrame:
    span = F.datediff(F.max("date"), F.min("date")) + 1
    return daily.groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), span.alias("span_days"), (span - F.count("*")).alias("n_gaps"), (F.count("*") / span).alias("coverage")
    )


__all__ = ["coverage", "day_spine", "gaps", "holdout_split", "pad_future", "trailing", "train_split"]
