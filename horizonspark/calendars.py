"""Holiday, storm and workday calendars as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Anchor days of each holiday, in order of priority; the window of days
# around an anchor that belongs to it; days with a storm signal of 8 or more; the
# holidays whose date is the same each year.
ANCHORS = {
    "CNY": ["2024-02-10", "2025-01-29", "2026-02-17"],
    "GoldenWeek": ["2024-10-01", "2025-10-01", "2026-10-01"],
    "Labour": ["2024-05-01", "2025-05-01", "2026-05-01"],
    "MidAutumn": ["2024-09-17", "2025-10-06", "2026-09-25"],
    "NewYear": ["2024-01-01", "2025-01-01", "2026-01-01"],
    "Christmas": ["2024-12-25", "2025-12-25"],
    "ChingMing": ["2024-04-04", "2025-04-04", "2026-04-04"],
    "Easter": ["2024-03-31", "2025-04-20", "2026-04-05"],
    "DragonBoat": ["2024-06-10", "2025-05-31", "2026-06-19"],
}
WINDOWS = {
    "CNY": (-7, 10),
    "GoldenWeek": (0, 6),
    "Labour": (0, 4),
    "MidAutumn": (-1, 1),
    "NewYear": (0, 0),
    "Christmas": (-3, 3),
    "ChingMing": (0, 0),
    "Easter": (-2, 1),
    "DragonBoat": (-2, 1),
}
FIXED_DATE = ("NewYear", "Christmas", "ChingMing", "Labour", "GoldenWeek")
ONE_HOT = ("CNY", "GoldenWeek", "Labour", "DragonBoat")
STORMS = [
    ("2023-07-17", "TALIM", 8),
    ("2023-09-01", "SAOLA", 10),
    ("2023-09-02", "SAOLA", 10),
    ("2023-10-08", "KOINU", 9),
    ("2023-10-09", "KOINU", 8),
    ("2024-09-05", "YAGI", 8),
    ("2024-09-06", "YAGI", 8),
    ("2024-11-13", "TORAJI", 8),
    ("2024-11-14", "TORAJI", 8),
    ("2025-07-20", "WIPHA", 10),
    ("2025-09-07", "TAPAH", 8),
    ("2025-09-08", "TAPAH", 8),
    ("2025-09-23", "RAGASA", 8),
    ("2025-09-24", "RAGASA", 10),
]
NO_ANCHOR = 366


def _literal(spark: SparkSession, rows: list[str], names: str) -> DataFrame:
    """A small table as a literal of the plan, for which no Python worker starts."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})")


def holiday_anchors(spark: SparkSession, anchors: dict[str, list[str]] = ANCHORS, windows: dict[str, tuple[int, int]] = WINDOWS) -> DataFrame:
    """holiday, ord, anchor, anchor_ord, ws, we: a few rows a holiday and year."""
    rows = [f"('{h}', {i}, DATE'{a}', {j}, {windows[h][0]}, {windows[h][1]})" for i, (h, days) in enumerate(anchors.items()) for j, a in enumerate(days)]
    return _literal(spark, rows, "holiday, ord, anchor, anchor_ord, ws, we")


def holiday_days(anchors: DataFrame) -> DataFrame:
    """One row for each day of each anchor's window: holiday_day, holiday, ord, anchor_ord, day_offset."""
    offsets = anchors.withColumn("day_offset", F.explode(F.sequence("ws", "we")))
    return offsets.select(F.date_add("anchor", F.col("day_offset")).alias("holiday_day"), "holiday", "ord", "anchor_ord", "day_offset")


def storm_days(spark: SparkSession) -> DataFrame:
    return _literal(spark, [f"(DATE'{d}', '{n}', {s})" for d, n, s in STORMS], "date, typhoon_name, highest_signal")


def weekdays_around(daily: DataFrame) -> DataFrame:
    """The default calendar from a month before the first date of daily to two after the last; no days if daily has none."""
    ends = daily.agg(F.date_sub(F.min("date"), 31).alias("a"), F.date_add(F.max("date"), 64).alias("b"))
    return _weekdays(ends.select(F.explode(F.sequence("a", "b")).alias("date")))


def _weekdays(days: DataFrame) -> DataFrame:
    return days.select("date", (F.weekday("date") < 5).alias("is_workday"))


def weekday_calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """The default workday calendar, Monday to Friday; a real one is an input table of the same shape."""
    return _weekdays(spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS date"))
