"""Hourly patterns of holidays, and the hourly split of a run, from tables to tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horizonspark import calendars
from horizonspark.operators import calendar as cal
from horizonspark.operators import hourly as H

CELL = ["holiday", "day_offset"]


def _holidays(anchors: DataFrame) -> DataFrame:
    return calendars.holiday_days(anchors).select(F.col("holiday_day").alias("date")).distinct()


def patterns(hourly: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions with their occurrences side by side (occ1_date, ...), and profiles (holiday, day_offset, hour, share) of the decided cells.

    Occurrences are the days of the holidays' windows, so both tables are as small as the calendar.
    """
    occurrences = calendars.holiday_days(anchors).select(*CELL, F.col("holiday_day").alias("date")).distinct()
    shares = H.hourly_shares(hourly)
    met = occurrences.join(shares.select("date").distinct(), "date", "left_semi")
    baselines = H.dow_baseline(shares, met.select(F.col("date").alias("ref")).distinct(), _holidays(anchors))
    best = H.best_bucket(H.tvd_to_buckets(met, shares, baselines))
    decided = H.decisions(best)
    nth = best.withColumn("i", F.row_number().over(Window.partitionBy(*CELL).orderBy("date")))
    most = nth.agg(F.max("i")).first()[0] or 0
    kinds = [("date", F.col("date")), ("best_bucket", F.col("best_bucket")), ("best_tvd", F.round("best_tvd", 4))]
    columns = [F.max(F.when(F.col("i") == k, c)).alias(f"occ{k}_{name}") for k in range(1, most + 1) for name, c in kinds]
    wide = decided.withColumn("tvd_mean", F.round("tvd_mean", 4)).withColumn("tvd_max", F.round("tvd_max", 4))
    if columns:
        wide = wide.join(nth.groupBy(*CELL).agg(*columns), CELL)
    profile = H.profiles(occurrences, shares).join(decided.select(*CELL), CELL, "left_semi")
    return wide, profile.select(*CELL, "hour", F.round("share", 6).alias("share"))


def split_run(predictions: DataFrame, run_date: dt.date, hourly: DataFrame, anchors: DataFrame, decided: DataFrame, profile: DataFrame) -> DataFrame:
    """Hourly p10, p50, p90 and strategy of a run's days (date, p10, p50, p90); weekday baselines are of the 90 days to the run date."""
    ref = hourly.sparkSession.sql(f"SELECT date'{run_date + dt.timedelta(days=1)}' AS ref")
    base = H.dow_baseline(H.hourly_shares(hourly), ref, _holidays(anchors)).select("bucket", "hour", "share")
    membership = cal.holiday_membership(predictions.select("date").distinct(), anchors, "date")
    return H.split_daily(predictions, membership, decided, profile, base)
