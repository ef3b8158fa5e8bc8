"""Signal intervals to days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals_to_days(intervals: DataFrame, since_year: int, least_signal: int) -> DataFrame:
    """(date, names, highest_signal): each day of each interval, names trimmed, upper-cased, distinct, sorted and comma-joined; an empty name is UNNAMED.

    Intervals of one name and signal are merged first (of those that start on one day the longest counts), so that what is
    expanded grows with names, signals and days covered, not with the number and length of the intervals.
    """
    rows = intervals.where((F.year("start") >= since_year) & (F.col("signal") >= least_signal) & (F.col("start") <= F.col("end")))
    name = F.upper(F.trim("name"))
    rows = rows.select("start", "end", F.when(name.isNull() | (name == ""), "UNNAMED").otherwise(name).alias("name"), "signal").groupBy("name", "signal", "start").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy("name", "signal").orderBy("start")
    reach = F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", (reach.isNull() | (F.col("start") > F.date_add(reach, 1))).cast("int")).withColumn("merged", F.sum("new").over(earlier))
    spans = rows.groupBy("name", "signal", "merged").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    days = spans.select(F.explode(F.sequence("start", "end")).alias("date"), "name", "signal")
    return days.groupBy("date").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"), F.max("signal").alias("highest_signal"))
