"""Features of the target date alone: calendar, holidays, anchor distances, workday blocks, storms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horizonspark import calendars
from horizonspark.functions import flag
from horizonspark.operators.islands import island_starts


def calendar_columns(d: Column) -> dict[str, Column]:
    dow = F.weekday(d)
    out = {
        "dow": dow,
        "day": F.dayofmonth(d),
        "week_of_month": F.floor((F.dayofmonth(d) - 1) / 7).cast("int") + 1,
        "month": F.month(d),
        "quarter": F.quarter(d),
        "year": F.year(d),
        "day_of_year": F.dayofyear(d),
        "is_weekend": flag(dow >= 5),
        "is_friday": flag(dow == 4),
        "is_saturday": flag(dow == 5),
        "is_sunday": flag(dow == 6),
        "is_month_start": flag(F.dayofmonth(d) <= 3),
        "is_month_end": flag(F.dayofmonth(d) >= 28),
    }
    for name, x, period in (("dow", dow, 7), ("month", F.month(d), 12), ("doy", F.dayofyear(d), 365)):
        out[f"{name}_sin"] = F.sin(2 * math.pi * x / period)
        out[f"{name}_cos"] = F.cos(2 * math.pi * x / period)
    return out


def calendar_features(dates: DataFrame, date_col: str = "target_date") -> DataFrame:
    return dates.select("*", *[c.alias(n) for n, c in calendar_columns(F.col(date_col)).items()])


def holiday_columns() -> list[str]:
    return [f"is_{h}" for h in calendars.ANCHORS]


def offset_name(holiday: str, offset: int) -> str:
    return f"{holiday}_d{'m' if offset < 0 else 'p'}{abs(offset)}"


def holiday_flags(dates: DataFrame, anchors: DataFrame, date_col: str = "target_date") -> DataFrame:
    """is_<holiday> for each holiday whose window holds the date; windows are expanded to days for an equi-join."""
    days = calendars.holiday_days(anchors).groupBy("holiday_day").agg(*[F.max(flag(F.col("holiday") == h)).alias(f"is_{h}") for h in calendars.ANCHORS])
    joined = dates.join(F.broadcast(days), F.col(date_col) == F.col("holiday_day"), "left")
    return joined.select(*dates.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in holiday_columns()])


def holiday_onehots(dates: DataFrame, anchors: DataFrame, date_col: str = "target_date") -> DataFrame:
    """One column for each offset of four holidays, their product with the weekday, and any holiday by weekday."""
    names = [(h, o) for h in calendars.ONE_HOT for o in range(calendars.WINDOWS[h][0], calendars.WINDOWS[h][1] + 1)]
    aggs = [F.max(flag((F.col("holiday") == h) & (F.col("day_offset") == o))).alias(offset_name(h, o)) for h, o in names]
    aggs += [F.max(flag(F.col("holiday") == h)).alias(f"_{h}") for h in calendars.ONE_HOT] + [F.lit(1).alias("_any")]
    days = calendars.holiday_days(anchors).groupBy("holiday_day").agg(*aggs)
    joined = dates.join(F.broadcast(days), F.col(date_col) == F.col("holiday_day"), "left")
    dow = F.weekday(F.col(date_col))
    by_dow = [flag((F.col(f"_{h}") == 1) & (dow == k)).alias(f"{h}_dow{k}") for h in calendars.ONE_HOT for k in range(7)]
    by_dow += [flag((F.col("_any") == 1) & (dow == k)).alias(f"holiday_dow{k}") for k in range(7)]
    return joined.select(*dates.columns, *[F.coalesce(offset_name(h, o), F.lit(0)).alias(offset_name(h, o)) for h, o in names], *by_dow)


def holiday_distance(dates: DataFrame, anchors: DataFrame, date_col: str = "target_date") -> DataFrame:
    """Days to the next anchor and from the last one, the day itself counting as both; 366 where there is none."""
    sorted_days = anchors.agg(F.array_sort(F.collect_set("anchor")).alias("days"))
    d = F.col(date_col)
    after = F.array_min(F.filter("days", lambda a: a >= d))
    before = F.array_max(F.filter("days", lambda a: a <= d))
    far = calendars.NO_ANCHOR
    joined = dates.crossJoin(F.broadcast(sorted_days))  # a single row: the sorted anchors as one array
    return joined.select(
        *dates.columns,
        F.coalesce(F.least(F.datediff(after, d), F.lit(far)), F.lit(far)).alias("days_to_next_holiday"),
        F.coalesce(F.least(F.datediff(d, before), F.lit(far)), F.lit(far)).alias("days_from_last_holiday"),
    )


def holiday_membership(dates: DataFrame, anchors: DataFrame, date_col: str = "target_date") -> DataFrame:
    """The first holiday, by priority, whose window holds the date; null where none does."""
    first = calendars.holiday_days(anchors).groupBy("holiday_day").agg(F.min(F.struct("ord", "anchor_ord", "holiday", "day_offset")).alias("m"))
    joined = dates.join(F.broadcast(first), F.col(date_col) == F.col("holiday_day"), "left")
    return joined.select(*dates.columns, F.col("m.holiday").alias("holiday"), F.col("m.day_offset").alias("day_offset"))


def workday_blocks(calendar: DataFrame) -> DataFrame:
    """Blocks of consecutive days off, for a calendar (date, is_workday) that should reach past the dates of interest.

    Workdays and unknown days have block 0; an unknown or missing day ends a block.
    """
    off = calendar.where(~F.col("is_workday")).select("date", F.unix_date("date").alias("at"))
    member = island_starts(off, [], "at", width=366)
    ends = member.groupBy("island_start").agg((F.max("at") - F.col("island_start") + 1).cast("int").alias("n"))
    blocks = member.join(ends, "island_start").select("date", "n", (F.col("at") - F.col("island_start") + 1).cast("int").alias("i"))
    joined = calendar.join(blocks, "date", "left")
    n, i = F.coalesce("n", F.lit(0)), F.coalesce("i", F.lit(0))
    return joined.select(
        "date",
        n.alias("mainland_block_length"),
        i.alias("mainland_block_day_index"),
        flag((i == 1) & (n > 0)).alias("mainland_is_first_block_day"),
        flag((i == n) & (n > 0)).alias("mainland_is_last_block_day"),
        F.when(F.col("is_workday").isNull(), -1).otherwise(F.col("is_workday").cast("int")).alias("mainland_is_workday"),
        F.when(n > 0, i / F.greatest(n, F.lit(1))).otherwise(0.0).alias("mainland_block_pos_norm"),
    )


def typhoon_flag(dates: DataFrame, storms: DataFrame, date_col: str = "target_date", least_signal: int = 8) -> DataFrame:
    days = storms.where(F.col("highest_signal") >= least_signal).select(F.to_date("date").alias("_storm")).distinct()
    return dates.join(F.broadcast(days), F.col(date_col) == F.col("_storm"), "left").select(*dates.columns, flag(F.col("_storm").isNotNull()).alias("is_typhoon_t8plus"))


def influence_mask(dates: DataFrame, anchors: DataFrame, post: int, date_col: str = "target_date") -> DataFrame:
    """in_influence: the date is in a fixed-date holiday's window or up to `post` days after it."""
    fixed = anchors.where(F.col("holiday").isin(*calendars.FIXED_DATE)).withColumn("we", F.col("we") + post)
    days = calendars.holiday_days(fixed).select("holiday_day").distinct()
    return dates.join(F.broadcast(days), F.col(date_col) == F.col("holiday_day"), "left").select(*dates.columns, F.col("holiday_day").isNotNull().alias("in_influence"))
