import datetime as dt

from pyspark.sql import functions as F

from horizonspark import calendars
from horizonspark.operators import calendar as C


def dates(spark, *days):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "target_date date")


def test_anchor_distance(spark):
    rows = C.holiday_distance(dates(spark, "2023-12-20", "2026-05-01", "2026-05-02", "2026-10-02"), calendars.holiday_anchors(spark)).collect()
    got = {str(r["target_date"]): (r["days_to_next_holiday"], r["days_from_last_holiday"]) for r in rows}
    assert got == {"2023-12-20": (12, 366), "2026-05-01": (0, 0), "2026-05-02": (48, 1), "2026-10-02": (366, 1)}


def test_membership_by_priority(spark):
    rows = C.holiday_membership(dates(spark, "2025-10-06", "2026-04-04", "2026-04-03", "2026-06-17", "2026-07-01"), calendars.holiday_anchors(spark)).collect()
    got = {str(r["target_date"]): (r["holiday"], r["day_offset"]) for r in rows}
    assert got == {"2025-10-06": ("GoldenWeek", 5), "2026-04-04": ("ChingMing", 0), "2026-04-03": ("Easter", -2), "2026-06-17": ("DragonBoat", -2), "2026-07-01": (None, None)}


def test_blocks_and_unknown_days(spark):
    cal = calendars.weekday_calendar(spark, "2024-01-01", "2024-01-21")
    cal = cal.withColumn("is_workday", F.when(F.col("date") == F.lit("2024-01-14").cast("date"), None).otherwise(F.col("is_workday")))
    got = {r["date"].day: tuple(r)[1:] for r in C.workday_blocks(cal).collect()}
    assert got[6] == (2, 1, 1, 0, 0, 0.5) and got[7] == (2, 2, 0, 1, 0, 1.0) and got[8] == (0, 0, 0, 0, 1, 0.0)
    assert got[13] == (1, 1, 1, 1, 0, 1.0) and got[14] == (0, 0, 0, 0, -1, 0.0)


def test_typhoon(spark):
    got = {str(r[0]): r[1] for r in C.typhoon_flag(dates(spark, "2024-09-05", "2024-09-07"), calendars.storm_days(spark)).collect()}
    assert got == {"2024-09-05": 1, "2024-09-07": 0}


def test_feature_names_are_the_matrix_columns(spark):
    from horizonspark.plans.matrix import feature_matrix, feature_names

    d = spark.createDataFrame([("s", dt.date(2024, 3, 1), 1.0, 2.0)], "series_id string, date date, demand double, floortables double")
    m = feature_matrix(spark, d, calendars.weekday_calendar(spark, "2024-01-01", "2024-12-31"))
    assert sorted(feature_names()) == sorted(set(m.columns) - {"series_id", "target_date", "horizon", "base_date", "y"}) and len(feature_names()) == 169
    wide = feature_matrix(spark, d, calendars.weekday_calendar(spark, "2024-01-01", "2024-12-31"), trend=True)
    assert {"trend_slope_90d", "trend_slope_180d", "growth_28_vs_84d", "yoy_growth_same_dow", "block_day1_4plus", "block_last_day", "block_pos_uplift_ratio"} <= set(wide.columns)
    assert m.count() == 28
