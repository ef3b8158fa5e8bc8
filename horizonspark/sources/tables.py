"""Domain tables from the star-schema tables: daily series, reservations, hourly series, intervals.

Order and ship dates are moved by 28 years (1,461 weeks), which keeps weekdays
and leap years and brings them to the years of the holiday anchors.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHIFT = 10_227


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moved(c: str) -> Column:
    return F.date_add(F.to_date(c), SHIFT)


def _stored(day: str, after: int = 0) -> Column:
    """The start of a day, moved back to the stored years."""
    return F.lit(dt.datetime.fromisoformat(day) + dt.timedelta(days=after - SHIFT)).cast("timestamp_ntz")


def daily_series(spark: SparkSession, sf_dir: str, first: str | None = None, last: str | None = None, by: str | None = "o_orderpriority") -> DataFrame:
    """series_id, date, demand (orders a day), floortables (customers a day); a series for each order priority, or one of all orders if by is None.

    All of orders, or those from the day first to the day last.
    """
    orders = read(spark, sf_dir, "orders")
    # on the stored column, so that the scan skips what lies outside
    if first:
        orders = orders.where(F.col("o_orderdate") >= _stored(first))
    if last:
        orders = orders.where(F.col("o_orderdate") < _stored(last, 1))
    orders = orders.select((F.col(by) if by else F.lit("all")).alias("series_id"), moved("o_orderdate").alias("date"), "o_custkey")
    return orders.groupBy("series_id", "date").agg(F.count("*").cast("double").alias("demand"), F.countDistinct("o_custkey").cast("double").alias("floortables"))


def series_ends(spark: SparkSession, sf_dir: str, by: str = "o_orderpriority") -> DataFrame:
    """series_id, last: each daily series' newest date, from the orders themselves, so that no series is built for it."""
    return read(spark, sf_dir, "orders").groupBy(F.col(by).alias("series_id")).agg(F.max(moved("o_orderdate")).alias("last"))


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patron-level reservations: update_date, inhouse_date, patron_id, seq (input order)."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    i = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return i.join(o, i.l_orderkey == o.o_orderkey).select(
        moved("o_orderdate").alias("update_date"), moved("l_shipdate").alias("inhouse_date"), F.col("o_custkey").alias("patron_id"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    )


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, hour, demand: summed values of the events."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(F.sum("value").alias("demand"))


def signal_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """start, end, signal, name, from orders and their lines."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"))
    i = read(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("b"), "l_linenumber", "l_returnflag")
    return i.join(o, i.l_orderkey == o.o_orderkey).select(F.least("a", "b").alias("start"), F.greatest("a", "b").alias("end"), F.col("l_linenumber").cast("int").alias("signal"), F.concat(F.lit(" "), F.lower("l_returnflag")).alias("name"))
