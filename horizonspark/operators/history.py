"""Leakage-safe features of a series' past, for every target date and horizon.

A forecast made `horizon` days ahead of T may read nothing newer than the base
date B = T - (horizon + 1). What depends on B alone (rolling windows, averages,
slopes) is computed once for each day of the series and joined on B: 28 times less work than
for each row of the matrix. What depends on T and fixed offsets comes from one map
of offsets for each T, filled by a single shuffle. All windows count calendar days, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horizonspark.functions import at_least, base_date

# Offsets and window lengths in days.
LAGS = [2, 3, 4, 5, 6, 7, 8, 9, 10, 14, 21, 28, 35, 42, 56, 91, 182, 365, 728]
ANCHOR_LAGS = [7, 14, 21, 28, 56, 91, 182, 365]
WINDOWS = [3, 7, 14, 28]
SPANS = [3, 7, 14, 28]
HORIZONS = 28

KEY = ["series_id", "target_date", "horizon"]
OFFSETS = sorted({*LAGS, *range(2, HORIZONS + 2), *(7 * k for k in range(1, 13)), *(365 + 7 * k for k in range(1, 13)), 364})

#: Those of them that the interactions' lags and means read.
INTERACTION_OFFSETS = sorted({*range(7, HORIZONS + 2), 365, *(7 * k for k in range(1, 5))})


def horizon_matrix(daily: DataFrame, horizons: int = HORIZONS) -> DataFrame:
    """series_id, target_date, horizon, base_date, floortables, y: a row for each observed day and horizon."""
    rows = daily.select("series_id", F.col("date").alias("target_date"), F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("horizon"), "floortables", F.col("demand").alias("y"))
    return rows.select(*KEY, base_date().alias("base_date"), "floortables", "y")


def day_spine(daily: DataFrame, after: int = 0) -> DataFrame:
    """Every day of each series from its first to its last (and `after` more), with its values or null."""
    ends = daily.groupBy("series_id").agg(F.min("date").alias("a"), F.date_add(F.max("date"), after).alias("b"))
    days = ends.select("series_id", F.explode(F.sequence("a", "b")).alias("date"))
    return days.join(daily, ["series_id", "date"], "left")


def offset_map(daily: DataFrame, offsets: list[int] = OFFSETS, targets: DataFrame | None = None) -> DataFrame:
    """(series_id, target_date, past): past maps an offset L to the demand L days before, where there is one; for targets only, if given."""
    seen = daily.where("demand is not null").select("series_id", "date", "demand", F.explode(F.array(*map(F.lit, offsets))).alias("back"))
    moved = seen.select("series_id", F.date_add("date", F.col("back")).alias("target_date"), "back", "demand")
    if targets is not None:
        moved = moved.join(targets, ["series_id", "target_date"], "left_semi")
    return moved.groupBy("series_id", "target_date").agg(F.map_from_entries(F.collect_list(F.struct("back", "demand"))).alias("past"))


def with_past(matrix: DataFrame, past: DataFrame) -> DataFrame:
    return matrix.join(past, ["series_id", "target_date"], "left")


def past(offset: Column) -> Column:
    return F.try_element_at(F.col("past"), offset.cast("int"))


def lag_columns() -> dict[str, Column]:
    h = F.col("horizon")
    return {f"lag_{n}": F.when(h + 1 <= n, past(F.lit(n))) for n in LAGS}


def lag_anchor_columns() -> dict[str, Column]:
    return {f"lag_anchor_{n}": past(F.greatest(F.lit(n), F.col("horizon") + 1)) for n in ANCHOR_LAGS}


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def _weeks(last: int, shift: int = 0) -> Column:
    """Demand on the target's weekday 1 to `last` weeks before (and `shift` days more), safe weeks only, without gaps."""
    weeks = F.filter(F.sequence(F.lit(1), F.lit(last)), lambda k: k * 7 >= F.col("horizon") + 1)
    return F.filter(F.transform(weeks, lambda k: past(k * 7 + shift)), lambda v: v.isNotNull())


def same_dow_columns() -> dict[str, Column]:
    return {f"same_dow_mean_{k}w": _mean(_weeks(k)) for k in (4, 8)}


def yoy_growth_dow_column() -> Column:
    """Mean of the four newest same-weekday values over that of the four newest 365 days earlier."""
    now, then = F.slice(_weeks(12), 1, 4), F.slice(_weeks(12, 365), 1, 4)
    return F.when((F.size(now) >= 2) & (F.size(then) >= 2) & (_mean(then) > 0), _mean(now) / F.nullif(_mean(then), F.lit(0.0)))


def _days(first: int, last: int) -> Window:
    return Window.partitionBy("series_id").orderBy(F.unix_date("date")).rangeBetween(first, last)


def rolling_columns(windows: list[int] = WINDOWS) -> dict[str, Column]:
    """Mean, population deviation (of two values at least), maximum and minimum of the last days."""
    out: dict[str, Column] = {}
    for w in windows:
        days = _days(1 - w, 0)
        out[f"rolling_mean_{w}"] = F.avg("demand").over(days)
        out[f"rolling_std_{w}"] = F.when(F.count("demand").over(days) > 1, F.stddev_pop("demand").over(days))
        out[f"rolling_max_{w}"] = F.max("demand").over(days)
        out[f"rolling_min_{w}"] = F.min("demand").over(days)
    return out


def ewma_columns(spans: list[int] = SPANS) -> dict[str, Column]:
    """Weights (1 - a)^k for the value k days back, k < 3 * span, over the values that are there."""
    day = F.unix_date("date")

    def average(span: int) -> Column:
        keep = 1 - 2 / (span + 1)
        seen = F.collect_list(F.when(F.col("demand").isNotNull(), F.struct(day.alias("d"), F.col("demand").alias("v")))).over(_days(1 - 3 * span, 0))
        top = F.aggregate(seen, F.lit(0.0), lambda s, x: s + x["v"] * F.pow(F.lit(keep), day - x["d"]))
        bottom = F.aggregate(seen, F.lit(0.0), lambda s, x: s + F.pow(F.lit(keep), day - x["d"]))
        return F.when(bottom > 0, top / F.nullif(bottom, F.lit(0.0)))

    return {f"ewma_{span}": average(span) for span in spans}


def trend_columns() -> dict[str, Column]:
    """Slopes a day over 90 and 180 days (30 and 60 values at least), and growth of four weeks over eight weeks earlier."""
    out: dict[str, Column] = {}
    first = F.min(F.unix_date("date")).over(Window.partitionBy("series_id"))
    x = (F.unix_date("date") - first).cast("double")
    for w, least in ((90, 30), (180, 60)):
        days = _days(1 - w, 0)
        out[f"trend_slope_{w}d"] = F.when(F.count("demand").over(days) >= least, F.regr_slope(F.col("demand"), x).over(days))
    new, old = _days(-27, 0), _days(-83, -56)
    enough = (F.count("demand").over(new) >= 14) & (F.count("demand").over(old) >= 14) & (F.avg("demand").over(old) > 0)
    out["growth_28_vs_84d"] = F.when(enough, F.avg("demand").over(new) / F.nullif(F.avg("demand").over(old), F.lit(0.0)))
    out["growth_28_vs_84d_diff"] = F.when(enough, F.avg("demand").over(new) - F.avg("demand").over(old))
    return out


def base_features(daily: DataFrame, columns: dict[str, Column], after: int = HORIZONS + 1) -> DataFrame:
    """The given window columns for every day of the spine, as base_date."""
    return day_spine(daily, after).select("series_id", F.col("date").alias("base_date"), *[c.alias(n) for n, c in columns.items()])


def with_base(matrix: DataFrame, base: DataFrame) -> DataFrame:
    return matrix.join(base, ["series_id", "base_date"], "left")


def yoy_ratio(matrix: DataFrame, daily: DataFrame) -> DataFrame:
    """Demand on the base date over that 365 days earlier, where the latter is above 0."""
    d = daily.select("series_id", "date", "demand")
    now = d.select("series_id", F.col("date").alias("base_date"), F.col("demand").alias("_now"))
    then = d.select("series_id", F.date_add("date", 365).alias("base_date"), F.col("demand").alias("_then"))
    both = now.join(then, ["series_id", "base_date"]).select("series_id", "base_date", F.when(F.col("_then") > 0, F.col("_now") / F.nullif(F.col("_then"), F.lit(0.0))).alias("yoy_ratio"))
    return with_base(matrix, both)


def same_holiday_last_year(dates: DataFrame, daily: DataFrame, workdays: DataFrame) -> DataFrame:
    """Demand 364 days earlier if that day and the target date are both known to be days off."""
    off = workdays.where(~F.col("is_workday")).select("date")
    then = daily.join(off, "date", "left_semi").select("series_id", F.date_add("date", 364).alias("target_date"), F.col("demand").alias("same_holiday_lastyear_lag"))
    then = then.join(off.withColumnRenamed("date", "target_date"), "target_date", "left_semi")
    return dates.join(then, ["series_id", "target_date"], "left")


RECENT = ("CNY", "GoldenWeek", "Labour", "MidAutumn")


def interaction_columns() -> dict[str, Column]:
    """Ratios and differences of the matrix's features; denominators count as 1 at least, null stays null."""
    week, fortnight, month = F.col("lag_anchor_7"), F.col("lag_anchor_14"), F.col("rolling_mean_28")
    over = lambda top, bottom: top / at_least(bottom, 1.0)
    ratios = {
        "lag_anchor_7_per_table": over(week, F.col("floortables")),
        "lag_anchor_14_per_table": over(fortnight, F.col("floortables")),
        "trend_7_vs_28": over(F.col("rolling_mean_7"), month),
        "trend_diff_7_28": F.col("rolling_mean_7") - month,
        "lag_anchor_7_zscore": over(week - month, F.col("rolling_std_28")),
        "same_dow_vs_overall": over(F.col("same_dow_mean_4w"), month),
        "yoy_anchor_diff": week - F.col("lag_365"),
    }
    return ratios | {f"{h}_x_recent": F.col(f"is_{h}") * month for h in RECENT}


def cross_holiday_expected(matrix: DataFrame, daily: DataFrame, blocks: DataFrame, back: int = 798, most: int = 5) -> DataFrame:
    """Mean demand of the newest `most` days off, up to the base date, at the same position of a block of two days or more."""
    pos = blocks.where("mainland_block_length >= 2").select("date", F.col("mainland_block_day_index").alias("pos"))
    days = daily.where("demand is not null").join(F.broadcast(pos), "date").select("series_id", "pos", "date", "demand")
    rows = matrix.join(F.broadcast(pos.withColumnRenamed("date", "target_date")), "target_date")
    # the history of a position as one sorted array for each series: a few hundred days at most
    held = days.groupBy("series_id", "pos").agg(F.sort_array(F.collect_list(F.struct("date", "demand")), False).alias("seen"))
    near = F.slice(F.filter("seen", lambda x: (x["date"] <= F.col("base_date")) & (x["date"] >= F.date_sub("base_date", back))), 1, most)
    out = rows.join(held, ["series_id", "pos"], "left").select(*KEY, _mean(F.transform(near, lambda x: x["demand"])).alias("expected_demand_at_block_pos"))
    return matrix.join(out, KEY, "left")


def sample_weights(matrix: DataFrame, holiday_flags: list[str], half_life: float = 240.0, holiday_factor: float = 3.0) -> DataFrame:
    """0.5 ^ (days before the horizon's newest date / half_life), three times as much on days with any holiday flag."""
    newest = matrix.groupBy("series_id", "horizon").agg(F.max("target_date").alias("_newest"))
    any_flag = sum((F.col(c) for c in holiday_flags), F.lit(0)) > 0
    age = F.datediff("_newest", "target_date")
    w = F.pow(F.lit(0.5), age / half_life) * F.when(any_flag, holiday_factor).otherwise(1.0)
    return matrix.join(newest, ["series_id", "horizon"]).select(*matrix.columns, w.alias("weight"))
