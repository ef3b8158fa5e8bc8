"""Reservations on the books: snapshots by pair of dates, and features of a target date as seen from the base date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_LEAD = 60


def snapshot(stays: DataFrame, most_lead: int = MOST_LEAD) -> DataFrame:
    """Rooms on the books for each (update_date, inhouse_date) with a lead of 1 to most_lead days, one for each patron row."""
    lead = F.datediff("inhouse_date", "update_date")
    rows = stays.where(F.col("update_date").isNotNull() & F.col("inhouse_date").isNotNull() & lead.between(1, most_lead))
    return rows.groupBy("update_date", "inhouse_date").agg(F.count("*").cast("double").alias("rooms_otb"), F.max(lead).alias("lead_time"))


def keep_last(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key by input order, aggregated without a sort of whole groups."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def reservation_features(matrix: DataFrame, snaps: DataFrame) -> DataFrame:
    """res_otb: rooms known for the target date at the base date; res_pickup_7d: how many of them came in the week before."""
    s = snaps.select("update_date", F.col("inhouse_date").alias("target_date"), "rooms_otb")
    now = s.select("target_date", F.col("update_date").alias("base_date"), F.col("rooms_otb").alias("res_otb"))
    week = s.select("target_date", F.date_add("update_date", 7).alias("base_date"), F.col("rooms_otb").alias("_week"))
    both = now.join(week, ["target_date", "base_date"], "left").select("target_date", "base_date", "res_otb", (F.col("res_otb") - F.col("_week")).alias("res_pickup_7d"))
    return matrix.join(both, ["target_date", "base_date"], "left")


def zscore_by_dow(rows: DataFrame, least: int = 3) -> DataFrame:
    """res_dow_zscore of res_otb among the rows of its weekday, of which `least` must be known and differ."""
    rows = rows.withColumn("_dow", F.weekday("target_date"))
    stats = rows.groupBy("_dow").agg(F.avg("res_otb").alias("_m"), F.stddev_pop("res_otb").alias("_s"), F.count("res_otb").alias("_n"))
    z = F.when((F.col("_n") >= least) & (F.col("_s") > 0), (F.col("res_otb") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)))
    return rows.join(F.broadcast(stats), "_dow").select(*[c for c in rows.columns if c != "_dow"], z.alias("res_dow_zscore"))
