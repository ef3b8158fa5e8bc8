"""Versioned forecast runs: schedule, summaries, picks, tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def natural_schedule(targets: DataFrame) -> DataFrame:
    """The i-th target date of a series is forecast i days ahead."""
    nth = F.row_number().over(Window.partitionBy("series_id").orderBy("target_date"))
    return targets.distinct().select("series_id", "target_date", nth.alias("horizon"))


def run_summary(predictions: DataFrame, keys: list[str] = ["run_date"]) -> DataFrame:  # noqa: B006
    return predictions.groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min("p50").alias("p50_min"), F.max("p50").alias("p50_max"), F.avg("p50").alias("p50_mean"), F.sum("p50").alias("p50_sum")
    )


def latest_runs(predictions: DataFrame, k: int = 6) -> DataFrame:
    """Rows of the k newest runs; the runs are ranked, not the rows."""
    runs = predictions.select("run_date").distinct()
    newest = runs.orderBy(F.col("run_date").desc()).limit(k)
    return predictions.join(F.broadcast(newest), "run_date", "left_semi")


def run_picks(runs: DataFrame) -> DataFrame:
    """The newest run, and the newest one that froze an initial plan."""
    return runs.agg(F.max("run_date").alias("latest_run"), F.max(F.when(F.col("initial_forecast"), F.col("run_date"))).alias("initial_run"))


def tracking(predictions: DataFrame, picks: DataFrame, actuals: DataFrame, span: DataFrame) -> DataFrame:
    """Each day of span (one row: first, last) with the initial plan, the newest forecast and the actual value, null where there is none."""
    days = span.where("first <= last").select(F.explode(F.sequence("first", "last")).alias("date"))
    p = predictions.join(F.broadcast(picks), (F.col("run_date") == F.col("latest_run")) | (F.col("run_date") == F.col("initial_run")))
    of_day = p.groupBy("date").agg(F.max(F.when(F.col("run_date") == F.col("initial_run"), F.col("p50"))).alias("initial_p50"), F.max(F.when(F.col("run_date") == F.col("latest_run"), F.col("p50"))).alias("latest_p50"))
    return days.join(of_day, "date", "left").join(actuals.select("date", F.col("demand").alias("actual")), "date", "left")


# Families of features and the parts of a name that tell them, in order.
CATEGORIES = [
    ("block", ["mainland_", "block_"]),
    ("holiday", ["Labour", "CNY", "GoldenWeek", "MidAutumn", "is_New", "is_Christmas", "is_Easter", "is_ChingMing", "holiday"]),
    ("temporal", ["lag", "rolling", "ewma", "same_dow", "yoy"]),
    ("calendar", ["dow", "month", "day", "week", "year", "weekend", "friday", "saturday", "sunday", "doy", "quarter"]),
    ("reservation", ["res_"]),
]


def feature_category(features: DataFrame, name: str = "feature") -> DataFrame:
    """The family a feature's name belongs to; the first that fits counts."""
    out = F.lit("other")
    for kind, keys in reversed(CATEGORIES):
        out = F.when(F.col(name).rlike("|".join(keys)), kind).otherwise(out)
    return features.select("*", out.alias("category"))


def importance_summary(rows: DataFrame, top: int = 30) -> DataFrame:
    """Mean, sample deviation and maximum of each feature's importance over horizons; the `top` by mean, ties by name."""
    s = rows.groupBy("feature").agg(F.round(F.avg("importance"), 9).alias("mean"), F.stddev_samp("importance").alias("std"), F.max("importance").alias("max"))
    return s.orderBy(F.col("mean").desc(), "feature").limit(top)
