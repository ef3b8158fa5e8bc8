"""Hourly profiles: shares of the day, weekday baselines, decisions for holidays, and the split of daily values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horizonspark.functions import round_exact

# Weekday buckets in order; distances under which a holiday is as good as a bucket.
BUCKETS = ["weekday", "friday", "saturday", "sunday"]
CLOSE, BORDERLINE, MARGIN = 0.05, 0.10, 0.03
WINDOW_DAYS, MIN_SAMPLES, MIN_OCCURRENCES = 90, 5, 2


def bucket(d: Column) -> Column:
    dow = F.weekday(d)
    return F.when(dow < 4, "weekday").when(dow == 4, "friday").when(dow == 5, "saturday").otherwise("sunday")


def bucket_ord(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BUCKETS)), name)


def hourly_shares(hourly: DataFrame) -> DataFrame:
    """(date, hour, share) of the days with all 24 hours and a positive total."""
    day = Window.partitionBy("date")
    hours = F.size(F.collect_set(F.when(F.col("demand").isNotNull(), F.col("hour"))).over(day))
    total = F.sum("demand").over(day)
    return hourly.withColumn("_n", hours).withColumn("_t", total).where((F.col("_n") == 24) & (F.col("_t") > 0)).select("date", "hour", (F.col("demand") / F.col("_t")).alias("share"))


def dow_baseline(shares: DataFrame, refs: DataFrame, holidays: DataFrame, window: int = WINDOW_DAYS, least: int = MIN_SAMPLES) -> DataFrame:
    """(ref, bucket, hour, share, n): mean shares of each bucket over the `window` days before ref, without holidays; `least` days at least.

    refs (ref) are the days asked about, a few for each holiday and year; days meet them by an equi-join on the days of their windows.
    """
    usual = shares.join(F.broadcast(holidays.select(F.col("date")).distinct()), "date", "left_anti")
    days = refs.select("ref", F.explode(F.sequence(F.date_sub("ref", window), F.date_sub("ref", 1))).alias("date"))
    met = usual.join(F.broadcast(days), "date").withColumn("bucket", bucket(F.col("date")))
    return met.groupBy("ref", "bucket", "hour").agg(F.avg("share").alias("share"), F.count("*").alias("n")).where(F.col("n") >= least)


def tvd_to_buckets(occurrences: DataFrame, shares: DataFrame, baselines: DataFrame) -> DataFrame:
    """(holiday, day_offset, date, bucket, tvd): total variation distance of each occurrence from its own baselines."""
    p = occurrences.join(shares, "date").select("holiday", "day_offset", "date", "hour", "share")
    q = baselines.select(F.col("ref").alias("date"), "hour", "bucket", F.col("share").alias("q"))
    return p.join(q, ["date", "hour"]).groupBy("holiday", "day_offset", "date", "bucket").agg((0.5 * F.sum(F.abs(F.col("share") - F.col("q")))).alias("tvd"))


def best_bucket(tvds: DataFrame) -> DataFrame:
    best = tvds.groupBy("holiday", "day_offset", "date").agg(F.min(F.struct(F.round("tvd", 9).alias("tvd"), bucket_ord(F.col("bucket")).alias("o"), "bucket")).alias("b"))
    return best.select("holiday", "day_offset", "date", F.col("b.bucket").alias("best_bucket"), F.col("b.tvd").alias("best_tvd"))


def decisions(best: DataFrame, least: int = MIN_OCCURRENCES) -> DataFrame:
    """One decision for each (holiday, day_offset) with `least` occurrences that have a baseline; votes tie by their first date."""
    cell = ["holiday", "day_offset"]
    votes = best.groupBy(*cell, "best_bucket").agg(F.count("*").alias("votes"), F.min("date").alias("seen"))
    modal = votes.groupBy(*cell).agg(F.min(F.struct((-F.col("votes")).alias("v"), "seen", "best_bucket")).alias("m"))
    stats = best.groupBy(*cell).agg(F.count("*").alias("n"), F.avg("best_tvd").alias("tvd_mean"), F.max("best_tvd").alias("tvd_max")).where(F.col("n") >= least)
    d = stats.join(modal, cell).select(*cell, F.col("n").cast("int").alias("n_occurrences"), "tvd_mean", "tvd_max", F.col("m.best_bucket").alias("modal_bucket"), (-F.col("m.v")).cast("int").alias("modal_count"))
    agreed = F.col("modal_count") >= F.greatest(F.lit(2), F.floor(F.col("n_occurrences") / 2) + 1)
    use = F.concat(F.lit("USE_"), F.upper("modal_bucket"))
    close = (F.col("tvd_mean") < CLOSE) & (F.col("tvd_max") < CLOSE + MARGIN) & agreed
    border = (F.col("tvd_mean") < BORDERLINE) & agreed
    reason = F.when(close, "consistent_close_match").when(border, "borderline_flag_review").when(F.col("tvd_mean") >= BORDERLINE, "strong_difference").otherwise("inconsistent_match")
    return d.select("*", F.when(close | border, use).otherwise("USE_HOLIDAY_PROFILE").alias("decision"), reason.alias("reason"))


def profiles(occurrences: DataFrame, shares: DataFrame, least: int = MIN_OCCURRENCES) -> DataFrame:
    """(holiday, day_offset, hour, share): mean over all complete occurrences, weights rising evenly from 1 for the oldest to 1.5 for the newest."""
    cell = ["holiday", "day_offset"]
    days = occurrences.join(shares.select("date").distinct(), "date", "left_semi").select(*cell, "date").distinct()
    w = Window.partitionBy(*cell)
    ranked = days.select(*cell, "date", F.row_number().over(w.orderBy("date")).alias("i"), F.count("*").over(w).alias("n")).where(F.col("n") >= least)
    weighted = ranked.withColumn("w", 1 + 0.5 * (F.col("i") - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    return weighted.join(shares, "date").groupBy(*cell, "hour").agg((F.sum(F.col("share") * F.col("w")) / F.sum("w")).alias("share"))


def split_daily(predictions: DataFrame, membership: DataFrame, decided: DataFrame, profile: DataFrame, baselines: DataFrame) -> DataFrame:
    """Hourly p10, p50, p90 and the strategy of each day.

    A holiday follows its decision, if the shares that it names are known; every other day, and what is left, its own
    weekday bucket; a day without either is left out. baselines: (bucket, hour, share) as of the run.
    """
    days = predictions.join(membership, "date", "left").join(F.broadcast(decided.select("holiday", "day_offset", "decision")), ["holiday", "day_offset"], "left").withColumn("own", bucket(F.col("date")))
    hours = days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    named = F.lower(F.regexp_replace("decision", "^USE_", ""))
    a = F.broadcast(profile.select("holiday", "day_offset", "hour", F.col("share").alias("of_profile")))
    b = F.broadcast(baselines.select(F.col("bucket").alias("named"), "hour", F.col("share").alias("of_named")))
    c = F.broadcast(baselines.select(F.col("bucket").alias("own"), "hour", F.col("share").alias("of_own")))
    joined = hours.withColumn("named", named).join(a, ["holiday", "day_offset", "hour"], "left").join(b, ["named", "hour"], "left").join(c, ["own", "hour"], "left")
    chosen = F.when(F.col("decision") == "USE_HOLIDAY_PROFILE", F.col("of_profile")).otherwise(F.col("of_named"))
    share = F.coalesce(chosen, F.col("of_own"))
    offset = F.concat(F.when(F.col("day_offset") >= 0, "+").otherwise("-"), F.abs("day_offset").cast("string"))
    how = F.when(F.col("decision") == "USE_HOLIDAY_PROFILE", "holiday_profile").otherwise(F.concat(F.lit("use_"), F.col("named")))
    followed = F.col("decision").isNotNull() & chosen.isNotNull()
    strategy = F.when(followed, F.concat("holiday", F.lit("_d"), offset, F.lit("_"), how)).otherwise(F.concat(F.lit("dow_"), F.col("own")))
    return joined.where(share.isNotNull()).select("date", "hour", *[round_exact(F.col(p) * share).alias(p) for p in ("p10", "p50", "p90")], strategy.alias("strategy"))


def reconcile(daily: DataFrame, hourly: DataFrame, tolerance: float = 1.0) -> DataFrame:
    sums = hourly.groupBy("date").agg(F.sum("p50").alias("hourly_sum"))
    return daily.join(sums, "date").select("date", "p50", "hourly_sum", (F.abs(F.col("hourly_sum") - F.col("p50")) > tolerance).alias("is_off"))


def strategy_counts(hourly: DataFrame) -> DataFrame:
    return hourly.select("date", "strategy").distinct().groupBy("strategy").agg(F.count("*").alias("n_days"))
