"""History features, whole or for some target dates, and their refresh after some days have changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonspark.operators import history as hist

DAY = ["series_id", "target_date"]
#: The longest window that ends on a base date, and the days from there to the nearest and farthest target.
REACH = max(max(hist.WINDOWS), 3 * max(hist.SPANS))
NEAREST, FARTHEST = 2, hist.HORIZONS + 1
YEAR = 365


def history_matrix(daily: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Lags, anchored lags, same-weekday means, windows, averages and the yearly ratio of each (series_id, target_date, horizon).

    With targets (series_id, target_date) only theirs: days that they do not look back to are not read into any window.
    """
    columns = hist.rolling_columns() | hist.ewma_columns()
    if targets is None:
        matrix, past, near = hist.horizon_matrix(daily), hist.offset_map(daily), daily
    else:
        asked = targets.select(*DAY).distinct()
        matrix = hist.horizon_matrix(daily.join(asked.withColumnRenamed("target_date", "date"), ["series_id", "date"], "left_semi"))
        past = hist.offset_map(daily, targets=asked)
        ends = asked.groupBy("series_id").agg(F.date_sub(F.min("target_date"), FARTHEST + REACH).alias("from"), F.max("target_date").alias("to"))
        near = daily.join(ends, "series_id").where("date between from and to").drop("from", "to")
    matrix = hist.yoy_ratio(hist.with_base(hist.with_past(matrix, past), hist.base_features(near, columns)), daily)
    more = hist.lag_columns() | hist.lag_anchor_columns() | hist.same_dow_columns()
    return matrix.select(*hist.KEY, "floortables", "y", *columns, "yoy_ratio", *[c.alias(n) for n, c in more.items()])


def changed_days(old: DataFrame, new: DataFrame) -> DataFrame:
    """(series_id, date) of the days that were added, removed or given other values."""
    columns = ["series_id", "date", "demand", "floortables"]
    a, b = old.select(columns), new.select(columns)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("series_id", "date").distinct()


def reached_targets(changed: DataFrame) -> DataFrame:
    """(series_id, target_date) whose features may read a changed day: the day itself, the offsets of lags, and what is in reach of a window or the yearly ratio."""
    spans = F.concat(
        F.array(F.lit(0), *[F.lit(n) for n in hist.OFFSETS]),
        F.sequence(F.lit(NEAREST), F.lit(REACH - 1 + FARTHEST)),
        F.sequence(F.lit(YEAR + NEAREST), F.lit(YEAR + FARTHEST)),
    )
    return changed.select("series_id", F.explode(F.array_distinct(spans)).alias("k"), "date").select("series_id", F.date_add("date", F.col("k")).alias("target_date")).distinct()


def refresh_matrix(matrix: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The history matrix of the days new, from that of the days old: only target dates within reach of a changed day are made again, all others are taken over."""
    reached = reached_targets(changed_days(old, new))
    return matrix.join(reached, DAY, "left_anti").unionByName(history_matrix(new, reached))
