"""Queries of the hourly split, interval ingest and the run registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonspark import calendars
from horizonspark.functions import rounded
from horizonspark.operators import calendar as cal
from horizonspark.operators import hourly as H
from horizonspark.operators import ingest, runs
from horizonspark.plans import features
from horizonspark.plans import sql as S
from horizonspark.sources import files, tables

LEAST = 3  # a month of events holds four Fridays only
#: Days of each month of events that stand for holidays: (holiday, day_offset, day of the month).
OCCURRENCES = [("A", 0, 17), ("A", 0, 24), ("A", 1, 26), ("A", 1, 27), ("B", 0, 28), ("B", 0, 29), ("B", 0, 30)]
_OF_MONTH = ", ".join(map(str, OCCURRENCES))


def _occurrences(spark, sf_dir) -> DataFrame:
    """(holiday, day_offset, date) of all months that have events."""
    rule = spark.sql(f"SELECT * FROM VALUES {_OF_MONTH} AS t(holiday, day_offset, day)")
    days = tables.hourly_series(spark, sf_dir).select("date").distinct().withColumn("day", F.dayofmonth("date"))
    return days.join(F.broadcast(rule), "day").select("holiday", "day_offset", "date")


def _shares(spark, sf_dir):
    return H.hourly_shares(tables.hourly_series(spark, sf_dir))


def _holidays(spark):
    return calendars.holiday_days(calendars.holiday_anchors(spark)).select(F.col("holiday_day").alias("date"))


def _baselines(spark, sf_dir):
    refs = _occurrences(spark, sf_dir).select(F.col("date").alias("ref")).distinct()
    return H.dow_baseline(_shares(spark, sf_dir), refs, _holidays(spark), least=LEAST - 1)


def _tvds(spark, sf_dir):
    return H.tvd_to_buckets(_occurrences(spark, sf_dir), _shares(spark, sf_dir), _baselines(spark, sf_dir))


def hourly_shares(spark, sf_dir):
    return _shares(spark, sf_dir).select("date", "hour", rounded(F.col("share"), 9).alias("share"))


def hourly_dow_baseline(spark, sf_dir):
    return _baselines(spark, sf_dir).select("ref", "bucket", "hour", rounded(F.col("share"), 9).alias("share"), "n")


def hourly_tvd(spark, sf_dir):
    return _tvds(spark, sf_dir).select("holiday", "day_offset", "date", "bucket", rounded(F.col("tvd")).alias("tvd"))


def hourly_decisions(spark, sf_dir):
    d = H.decisions(H.best_bucket(_tvds(spark, sf_dir)))
    return d.select("holiday", "day_offset", "n_occurrences", rounded(F.col("tvd_mean")).alias("tvd_mean"), rounded(F.col("tvd_max")).alias("tvd_max"), "modal_bucket", "modal_count", "decision", "reason")


def hourly_profiles(spark, sf_dir):
    return H.profiles(_occurrences(spark, sf_dir), _shares(spark, sf_dir)).select("holiday", "day_offset", "hour", rounded(F.col("share"), 9).alias("share"))


def _daily_p50(spark, sf_dir):
    """A day's total as its forecast, for the days of the month of events."""
    d = tables.hourly_series(spark, sf_dir).groupBy("date").agg(F.round(F.sum("demand"), 2).alias("p50"))
    return d.select("date", (F.col("p50") * 0.5).alias("p10"), "p50", (F.col("p50") * 1.5).alias("p90"))


def _split(spark, sf_dir):
    refs = tables.hourly_series(spark, sf_dir).agg(F.date_add(F.max("date"), 1).alias("ref"))
    base = H.dow_baseline(_shares(spark, sf_dir), refs, _holidays(spark), least=LEAST).select("bucket", "hour", "share")
    decided = H.decisions(H.best_bucket(_tvds(spark, sf_dir)))
    profile = H.profiles(_occurrences(spark, sf_dir), _shares(spark, sf_dir))
    return H.split_daily(_daily_p50(spark, sf_dir), _occurrences(spark, sf_dir), decided, profile, base)


def hourly_split(spark, sf_dir):
    return _split(spark, sf_dir)


def hourly_reconcile(spark, sf_dir):
    r = H.reconcile(_daily_p50(spark, sf_dir), _split(spark, sf_dir))
    return r.select("date", rounded(F.col("p50"), 2).alias("p50"), rounded(F.col("hourly_sum"), 2).alias("hourly_sum"), "is_off")


def strategy_counts(spark, sf_dir):
    return H.strategy_counts(_split(spark, sf_dir))


def record_lines(spark, sf_dir) -> DataFrame:
    """Tab-separated records made of the lines' columns, some of them broken."""
    i = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.to_date("l_shipdate").alias("d"))
    day = lambda d: [part(d).cast("string") for part in (F.dayofmonth, F.month, F.year)]
    f = [F.col("l_orderkey").cast("string"), F.lit("T"), F.col("l_returnflag"), F.when(F.col("l_linenumber") == 5, "x").otherwise(F.col("l_linenumber").cast("string")), F.lit("N"), F.lit("0000")]
    f += [*day("d"), F.lit("+"), F.lit("0100"), *day(F.date_add("d", F.col("l_linenumber"))), F.lit("+")]
    last = F.when(F.col("l_linenumber") == 6, "").otherwise("1200")
    return i.select(F.concat_ws("\t", *f, last).alias("value"))


def interval_parse(spark, sf_dir):
    return files.parse_signals(record_lines(spark, sf_dir))


def interval_to_daily(spark, sf_dir):
    return ingest.intervals_to_days(tables.signal_intervals(spark, sf_dir), 1996, 3)


def weekly_runs(spark, sf_dir) -> DataFrame:
    """A run for each week of all orders: it forecasts the next 28 days by the demand of the 28 days up to its date."""
    d = tables.daily_series(spark, sf_dir).groupBy("date").agg(F.sum("demand").alias("demand"))
    starts = d.agg(F.explode(F.sequence(F.date_add(F.min("date"), 28), F.max("date"), F.expr("interval 7 days"))).alias("run_date"))
    ahead = starts.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(28)))).select("run_date", F.date_add("run_date", F.col("k")).alias("date"), F.date_add("run_date", F.col("k") - 28).alias("from"))
    p = ahead.join(d.withColumnRenamed("date", "from"), "from")
    return p.select("run_date", "date", (F.col("demand") * 0.9).alias("p10"), F.col("demand").alias("p50"), (F.col("demand") * 1.1).alias("p90"))


def run_summary(spark, sf_dir):
    return runs.run_summary(weekly_runs(spark, sf_dir)).select("run_date", "n_days", "first_date", "last_date", *[rounded(F.col(c)).alias(c) for c in ("p50_min", "p50_max", "p50_mean", "p50_sum")])


def _marked(spark, sf_dir):
    return weekly_runs(spark, sf_dir).select("run_date").distinct().withColumn("initial_forecast", F.dayofmonth("run_date") <= 7)


def run_picks(spark, sf_dir):
    return runs.run_picks(_marked(spark, sf_dir))


def runs_latest_k(spark, sf_dir):
    return runs.latest_runs(weekly_runs(spark, sf_dir), 6).select("run_date", "date", "p50")


def tracking_join(spark, sf_dir):
    """From the newest initial plan's first day to the newest run's last."""
    actual = tables.daily_series(spark, sf_dir).groupBy("date").agg(F.sum("demand").alias("demand"))
    picks = runs.run_picks(_marked(spark, sf_dir))
    span = picks.select(F.date_add("initial_run", 1).alias("first"), F.date_add("latest_run", 28).alias("last"))
    return runs.tracking(weekly_runs(spark, sf_dir), picks, actual, span)


def feature_category(spark, sf_dir):
    """The features of the dates that have orders, with the sum of each and the family that its name belongs to."""
    dates = tables.daily_series(spark, sf_dir).select(F.col("date").alias("target_date")).distinct()
    wide = cal.holiday_flags(cal.calendar_features(dates), calendars.holiday_anchors(spark)).drop("target_date")
    sums = wide.agg(*[rounded(F.sum(c), 3).alias(c) for c in wide.columns]).unpivot([], wide.columns, "feature", "total")
    return runs.feature_category(sums)


def importance_summary(spark, sf_dir):
    """Importances by horizon: the summed quantities of the lines of each part and line number stand for them."""
    i = tables.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("horizon")).agg(F.sum("l_quantity").alias("importance"))
    return runs.importance_summary(i.select(F.concat(F.lit("part_"), F.col("part").cast("string")).alias("feature"), "horizon", "importance")).select("feature", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "max")])


QUERIES = {
    f.__name__: f
    for f in (
        hourly_shares, hourly_dow_baseline, hourly_tvd, hourly_decisions, hourly_profiles, hourly_split, hourly_reconcile, strategy_counts, interval_parse, interval_to_daily,
        run_summary, run_picks, runs_latest_k, tracking_join, feature_category, importance_summary,
    )
}

_OCC = f"occ AS (SELECT holiday, day_offset, date FROM (SELECT DISTINCT date FROM hourly) JOIN (VALUES {_OF_MONTH}) t(holiday, day_offset, d) ON day(date) = d)"
_BUCKET = "CASE WHEN isodow({0}) < 5 THEN 'weekday' WHEN isodow({0}) = 5 THEN 'friday' WHEN isodow({0}) = 6 THEN 'saturday' ELSE 'sunday' END"
_BASE = f"""refs AS (SELECT DISTINCT date AS ref FROM occ),
usual AS (SELECT *, {_BUCKET.format("date")} AS bucket FROM shares WHERE date NOT IN (SELECT day FROM hdays)),
base AS (SELECT ref, bucket, hour, avg(share) AS share, count(*) AS n FROM usual JOIN refs ON date BETWEEN ref - 90 AND ref - 1 GROUP BY ALL HAVING count(*) >= {LEAST - 1}),
tvds AS (SELECT o.holiday, o.day_offset, o.date, b.bucket, 0.5 * sum(abs(s.share - b.share)) AS tvd FROM occ o JOIN shares s ON s.date = o.date JOIN base b ON b.ref = o.date AND b.hour = s.hour GROUP BY ALL),
best AS (SELECT holiday, day_offset, date, bucket, round(tvd, 9) AS tvd FROM tvds QUALIFY row_number() OVER (PARTITION BY holiday, day_offset, date ORDER BY round(tvd, 9), list_position({H.BUCKETS!r}, bucket)) = 1),
votes AS (SELECT holiday, day_offset, bucket, count(*) AS c, min(date) AS seen FROM best GROUP BY ALL),
modal AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY holiday, day_offset ORDER BY c DESC, seen) = 1),
stats AS (SELECT holiday, day_offset, count(*) AS n, avg(tvd) AS m, max(tvd) AS x FROM best GROUP BY ALL HAVING count(*) >= 2),
dec AS (SELECT s.holiday, s.day_offset, n, m, x, bucket, c, CASE WHEN m < 0.05 AND x < 0.08 AND c >= greatest(2, n // 2 + 1) THEN 'consistent_close_match' WHEN m < 0.1 AND c >= greatest(2, n // 2 + 1) THEN 'borderline_flag_review'
  WHEN m >= 0.1 THEN 'strong_difference' ELSE 'inconsistent_match' END AS reason FROM stats s JOIN modal USING (holiday, day_offset)),
decided AS (SELECT *, CASE WHEN reason IN ('consistent_close_match', 'borderline_flag_review') THEN 'USE_' || upper(bucket) ELSE 'USE_HOLIDAY_PROFILE' END AS decision FROM dec),
prof AS (SELECT o.holiday, o.day_offset, hour, sum(share * (1 + 0.5 * (i - 1) / greatest(k - 1, 1))) / sum(1 + 0.5 * (i - 1) / greatest(k - 1, 1)) AS share
  FROM (SELECT *, row_number() OVER (PARTITION BY holiday, day_offset ORDER BY date) AS i, count(*) OVER (PARTITION BY holiday, day_offset) AS k FROM occ WHERE date IN (SELECT date FROM shares)) o JOIN shares s ON s.date = o.date WHERE k >= 2 GROUP BY ALL)"""
_H = S.with_(S.HOURLY, S.SHARES, S.ANCHORS, S.HOLIDAY_DAYS, _OCC, _BASE)


def _exact(x: str, high: str) -> str:
    """A double rounded to four digits by its exact value, halves to even; high is its upper half."""
    n = f"floor({x} * 10000)"
    above = f"(({high} * 20000 - (2 * {n} + 1)) + ({x} - {high}) * 20000)"
    return f"(CASE WHEN {above} > 0 THEN {n} + 1 WHEN {above} < 0 THEN {n} ELSE {n} + {n} % 2 END) / 10000"


_SPLIT = f"""now AS (SELECT bucket, hour, avg(share) AS share FROM usual WHERE date BETWEEN (SELECT max(date) - 89 FROM hourly) AND (SELECT max(date) FROM hourly) GROUP BY ALL HAVING count(*) >= {LEAST}),
preds AS (SELECT date, round(sum(demand), 2) AS p50, round(sum(demand), 2) * 0.5 AS p10, round(sum(demand), 2) * 1.5 AS p90 FROM hourly GROUP BY ALL),
hours AS (SELECT p.*, h::INT AS hour, o.holiday, o.day_offset, d.decision, {_BUCKET.format("p.date")} AS own FROM preds p LEFT JOIN occ o ON o.date = p.date LEFT JOIN decided d ON d.holiday = o.holiday AND d.day_offset = o.day_offset, range(0, 24) t(h)),
ch AS (SELECT h.*, CASE WHEN decision = 'USE_HOLIDAY_PROFILE' THEN f.share ELSE n.share END AS chosen, w.share AS of_own FROM hours h
  LEFT JOIN prof f ON f.holiday = h.holiday AND f.day_offset = h.day_offset AND f.hour = h.hour LEFT JOIN now n ON n.bucket = lower(substr(decision, 5)) AND n.hour = h.hour LEFT JOIN now w ON w.bucket = own AND w.hour = h.hour),
cut AS (SELECT *, x10 * 134217729 - (x10 * 134217729 - x10) AS g10, x50 * 134217729 - (x50 * 134217729 - x50) AS g50, x90 * 134217729 - (x90 * 134217729 - x90) AS g90
  FROM (SELECT *, p10 * coalesce(chosen, of_own) AS x10, p50 * coalesce(chosen, of_own) AS x50, p90 * coalesce(chosen, of_own) AS x90 FROM ch)),
split AS (SELECT date, hour, {_exact('x10', 'g10')} AS p10, {_exact('x50', 'g50')} AS p50, {_exact('x90', 'g90')} AS p90,
  CASE WHEN decision IS NOT NULL AND chosen IS NOT NULL THEN holiday || '_d' || CASE WHEN day_offset >= 0 THEN '+' ELSE '-' END || abs(day_offset) || CASE WHEN decision = 'USE_HOLIDAY_PROFILE' THEN '_holiday_profile' ELSE '_use_' || lower(substr(decision, 5)) END ELSE 'dow_' || own END AS strategy FROM cut WHERE coalesce(chosen, of_own) IS NOT NULL)"""
_HS = _H.rstrip() + ",\n" + _SPLIT + "\n"
RUNS_SQL = """total AS (SELECT date, sum(demand) AS demand FROM daily GROUP BY ALL),
starts AS (SELECT unnest(range(min(date) + 28, max(date) + 1, INTERVAL 7 DAY))::DATE AS run_date FROM total),
runs AS (SELECT run_date, run_date + k::INT AS date, demand AS p50 FROM starts, range(1, 29) b(k), total t WHERE t.date = run_date + k::INT - 28)"""
_R = S.with_(S.DAILY, RUNS_SQL)
_PICKS = "picks AS (SELECT max(run_date) AS latest_run, max(CASE WHEN day(run_date) <= 7 THEN run_date END) AS initial_run FROM runs)"

SQL = {
    "hourly_shares": S.with_(S.HOURLY, S.SHARES) + "SELECT date, hour, round(share, 9) AS share FROM shares",
    "hourly_dow_baseline": _H + "SELECT ref, bucket, hour, round(share, 9) AS share, n FROM base",
    "hourly_tvd": _H + "SELECT holiday, day_offset, date, bucket, round(tvd, 6) AS tvd FROM tvds",
    "hourly_decisions": _H + "SELECT holiday, day_offset, n::INT AS n_occurrences, round(m, 6) AS tvd_mean, round(x, 6) AS tvd_max, bucket AS modal_bucket, c::INT AS modal_count, decision, reason FROM decided",
    "hourly_profiles": _H + "SELECT holiday, day_offset, hour, round(share, 9) AS share FROM prof",
    "hourly_split": _HS + "SELECT * FROM split",
    "hourly_reconcile": _HS + "SELECT date, round(p.p50, 2) AS p50, round(s, 2) AS hourly_sum, abs(s - p.p50) > 1 AS is_off FROM preds p JOIN (SELECT date, sum(p50) AS s FROM split GROUP BY ALL) USING (date)",
    "strategy_counts": _HS + "SELECT strategy, count(DISTINCT date) AS n_days FROM split GROUP BY ALL",
    "interval_parse": 'SELECT CAST(l_shipdate AS DATE) AS start, CAST(l_shipdate AS DATE) + l_linenumber AS "end", l_linenumber::INT AS signal, l_returnflag AS name FROM lineitem WHERE l_linenumber NOT IN (5, 6)',
    "interval_to_daily": """WITH i AS (SELECT least(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS a, greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS b, l_linenumber::INT AS signal, l_returnflag AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        d AS (SELECT unnest(range(a, b + 1, INTERVAL 1 DAY))::DATE AS date, upper(trim(name)) AS name, signal FROM (SELECT DISTINCT * FROM i) WHERE year(a) >= 1996 AND signal >= 3)
        SELECT date, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(signal) AS highest_signal FROM d GROUP BY ALL""",
    "run_summary": _R + "SELECT run_date, count(*) AS n_days, min(date) AS first_date, max(date) AS last_date, round(min(p50), 6) AS p50_min, round(max(p50), 6) AS p50_max, round(avg(p50), 6) AS p50_mean, round(sum(p50), 6) AS p50_sum FROM runs GROUP BY ALL",
    "run_picks": _R.rstrip() + f", {_PICKS} SELECT * FROM picks",
    "runs_latest_k": _R + "SELECT run_date, date, p50 FROM runs QUALIFY dense_rank() OVER (ORDER BY run_date DESC) <= 6",
    "tracking_join": _R.rstrip() + f", {_PICKS}, s AS (SELECT unnest(range(initial_run + 1, latest_run + 29, INTERVAL 1 DAY))::DATE AS date FROM picks)" + """
        SELECT s.date, i.p50 AS initial_p50, l.p50 AS latest_p50, t.demand AS actual FROM s CROSS JOIN picks LEFT JOIN runs i ON i.date = s.date AND i.run_date = initial_run LEFT JOIN runs l ON l.date = s.date AND l.run_date = latest_run LEFT JOIN total t ON t.date = s.date""",
    "feature_category": f"""WITH c AS ({features.SQL["calendar_features"]}), h AS ({features.SQL["holiday_flags"]}), w AS (SELECT * EXCLUDE (target_date) FROM c JOIN h USING (target_date)),
        u AS (UNPIVOT (SELECT round(sum(COLUMNS(*))::DOUBLE, 3) FROM w) ON COLUMNS(*) INTO NAME feature VALUE total)
        SELECT feature, total, CASE """ + " ".join(f"WHEN {' OR '.join(f'contains(feature, {k!r})' for k in keys)} THEN '{kind}'" for kind, keys in runs.CATEGORIES) + " ELSE 'other' END AS category FROM u",
    "importance_summary": """WITH i AS (SELECT 'part_' || l_partkey AS feature, l_linenumber, sum(l_quantity) AS importance FROM lineitem GROUP BY ALL)
        SELECT feature, round(round(avg(importance), 9), 6) AS mean, round(stddev_samp(importance), 6) AS std, round(max(importance), 6) AS max FROM i GROUP BY ALL ORDER BY round(avg(importance), 9) DESC, feature LIMIT 30""",
}
