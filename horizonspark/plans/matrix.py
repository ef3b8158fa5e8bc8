"""The whole feature matrix, one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonspark import calendars
from horizonspark.operators import calendar as cal
from horizonspark.operators import history as hist

NOT_HOLIDAY = {"is_weekend", "is_friday", "is_saturday", "is_sunday", "is_month_start", "is_month_end"}


def feature_names() -> list[str]:
    """The features of the matrix without the trend block, in groups."""
    date = "dow day week_of_month month quarter year day_of_year is_weekend is_friday is_saturday is_sunday is_month_start is_month_end dow_sin dow_cos month_sin month_cos doy_sin doy_cos".split()
    hot = [cal.offset_name(h, o) for h in calendars.ONE_HOT for o in range(calendars.WINDOWS[h][0], calendars.WINDOWS[h][1] + 1)]
    by_dow = [f"{h}_dow{k}" for h in (*calendars.ONE_HOT, "holiday") for k in range(7)]
    blocks = [f"mainland_{x}" for x in ("block_length", "block_day_index", "is_first_block_day", "is_last_block_day", "is_workday", "block_pos_norm")]
    past = [f"lag_{n}" for n in hist.LAGS] + [f"lag_anchor_{n}" for n in hist.ANCHOR_LAGS] + [f"rolling_{f}_{w}" for w in hist.WINDOWS for f in ("mean", "std", "max", "min")] + [f"ewma_{n}" for n in hist.SPANS]
    past += ["same_dow_mean_4w", "same_dow_mean_8w", "yoy_ratio", "same_holiday_lastyear_lag", "floortables"]
    mixed = ["lag_anchor_7_per_table", "lag_anchor_14_per_table", "trend_7_vs_28", "trend_diff_7_28", "lag_anchor_7_zscore", "same_dow_vs_overall", "yoy_anchor_diff", *(f"{h}_x_recent" for h in ("CNY", "GoldenWeek", "Labour", "MidAutumn"))]
    return [*date, *cal.holiday_columns(), *hot, "days_to_next_holiday", "days_from_last_holiday", *by_dow, *blocks, *past, *mixed, "is_typhoon_t8plus"]


def holiday_mask_columns(columns: list[str]) -> list[str]:
    """Flags that count as holidays for weights: every is_ column but the calendar's own; storm days are among them."""
    return [c for c in columns if c.startswith("is_") and c not in NOT_HOLIDAY]


def feature_matrix(spark: SparkSession, daily: DataFrame, workdays: DataFrame, trend: bool = False) -> DataFrame:
    """All features for each (series_id, target_date, horizon), with floortables and y.

    Features of the date alone are built for distinct dates and broadcast, as a
    calendar has a few thousand rows whatever the number of series.
    """
    anchors = calendars.holiday_anchors(spark)
    dates = daily.select(F.col("date").alias("target_date")).distinct()
    of_date = cal.typhoon_flag(cal.holiday_distance(cal.holiday_onehots(cal.holiday_flags(cal.calendar_features(dates), anchors), anchors), anchors), calendars.storm_days(spark))
    blocks = cal.workday_blocks(workdays).withColumnRenamed("date", "target_date")
    of_date = of_date.join(F.broadcast(blocks), "target_date", "left")
    matrix = hist.with_past(hist.horizon_matrix(daily), hist.offset_map(daily))
    columns = hist.rolling_columns() | hist.ewma_columns() | (hist.trend_columns() if trend else {})
    matrix = hist.yoy_ratio(hist.with_base(matrix, hist.base_features(daily, columns)), daily)
    matrix = hist.same_holiday_last_year(matrix, daily, workdays).join(F.broadcast(of_date), "target_date")
    if trend:
        matrix = hist.cross_holiday_expected(matrix, daily, cal.workday_blocks(workdays))
    more = hist.lag_columns() | hist.lag_anchor_columns() | hist.same_dow_columns() | ({"yoy_growth_same_dow": hist.yoy_growth_dow_column()} if trend else {})
    matrix = matrix.select("*", *[c.alias(n) for n, c in more.items()]).drop("past")
    out = matrix.select("*", *[c.alias(n) for n, c in hist.interaction_columns().items()])
    if trend:
        n, i = F.col("mainland_block_length"), F.col("mainland_block_day_index")
        out = out.select(
            "*",
            cal.flag((i == 1) & (n >= 4)).alias("block_day1_4plus"),
            *[cal.flag((i == k) & (n >= 2)).alias(f"block_day{k}") for k in (1, 2, 3)],
            cal.flag((i == n) & (n >= 2)).alias("block_last_day"),
            (F.col("expected_demand_at_block_pos") / cal_at_least("rolling_mean_28")).alias("block_pos_uplift_ratio"),
        )
    return out


def cal_at_least(name: str):
    from horizonspark.functions import at_least

    return at_least(F.col(name), 1.0)
