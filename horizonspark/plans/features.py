"""Queries of the feature operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonspark import calendars
from horizonspark.functions import rounded
from horizonspark.operators import calendar as cal
from horizonspark.operators import history as hist
from horizonspark.operators import reservations as res
from horizonspark.plans import sql as S
from horizonspark.sources import tables

KEY = hist.KEY


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.daily_series(spark, sf_dir).select(F.col("date").alias("target_date")).distinct()


def _round(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[c if c in keys or t != "double" else rounded(F.col(c)).alias(c) for c, t in df.dtypes])


def _workdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.weekdays_around(tables.daily_series(spark, sf_dir))


def daily_series(spark, sf_dir):
    return tables.daily_series(spark, sf_dir)


def pad_future(spark, sf_dir):
    from horizonspark.operators.series import pad_future as pad

    return pad(tables.daily_series(spark, sf_dir))


def gap_check(spark, sf_dir):
    from horizonspark.operators.series import gaps

    return gaps(tables.daily_series(spark, sf_dir))


def trailing_actuals(spark, sf_dir):
    from horizonspark.operators.series import trailing

    return trailing(tables.daily_series(spark, sf_dir), 60)


def holdout_split(spark, sf_dir):
    from horizonspark.operators.series import holdout_split as split

    return split(tables.daily_series(spark, sf_dir), 28)


def train_split(spark, sf_dir):
    from horizonspark.operators.series import train_split as split

    d = tables.daily_series(spark, sf_dir)
    m = hist.horizon_matrix(d)
    return split(m, F.date_sub(d.agg(F.max("date")).scalar(), S.AHEAD)).groupBy("series_id", "horizon").agg(F.count("*").alias("n_rows"), F.min("target_date").alias("first_date"), F.max("target_date").alias("last_date"))


def horizon_matrix(spark, sf_dir):
    return hist.horizon_matrix(tables.daily_series(spark, sf_dir))


def calendar_features(spark, sf_dir):
    return _round(cal.calendar_features(_dates(spark, sf_dir)), [])


def holiday_dates(spark, sf_dir):
    """The days of orders that lie in a holiday's window."""
    days = calendars.holiday_days(calendars.holiday_anchors(spark)).select(F.col("holiday_day").alias("date")).distinct()
    return _dates(spark, sf_dir).select(F.col("target_date").alias("date")).join(F.broadcast(days), "date", "left_semi")


def holiday_flags(spark, sf_dir):
    return cal.holiday_flags(_dates(spark, sf_dir), calendars.holiday_anchors(spark))


def holiday_onehots(spark, sf_dir):
    return cal.holiday_onehots(_dates(spark, sf_dir), calendars.holiday_anchors(spark))


def holiday_distance(spark, sf_dir):
    return cal.holiday_distance(_dates(spark, sf_dir), calendars.holiday_anchors(spark))


def holiday_membership(spark, sf_dir):
    return cal.holiday_membership(_dates(spark, sf_dir), calendars.holiday_anchors(spark))


def workday_blocks(spark, sf_dir):
    blocks = cal.workday_blocks(_workdays(spark, sf_dir))
    return _round(blocks.join(_dates(spark, sf_dir), F.col("date") == F.col("target_date"), "left_semi"), [])


def typhoon_flag(spark, sf_dir):
    return cal.typhoon_flag(_dates(spark, sf_dir), calendars.storm_days(spark))


def _with_past(spark, sf_dir):
    d = tables.daily_series(spark, sf_dir)
    return hist.with_past(hist.horizon_matrix(d), hist.offset_map(d))


def lag_features(spark, sf_dir):
    return _with_past(spark, sf_dir).select(*KEY, *[c.alias(n) for n, c in hist.lag_columns().items()])


def lag_anchor_features(spark, sf_dir):
    return _with_past(spark, sf_dir).select(*KEY, *[c.alias(n) for n, c in hist.lag_anchor_columns().items()])


def same_dow_features(spark, sf_dir):
    return _with_past(spark, sf_dir).select(*KEY, *[rounded(c).alias(n) for n, c in hist.same_dow_columns().items()])


def yoy_growth_dow(spark, sf_dir):
    return _with_past(spark, sf_dir).select(*KEY, rounded(hist.yoy_growth_dow_column()).alias("yoy_growth_same_dow"))


def _based(spark, sf_dir, columns):
    d = tables.daily_series(spark, sf_dir)
    m = hist.with_base(hist.horizon_matrix(d), hist.base_features(d, columns))
    return _round(m.select(*KEY, *columns), KEY)


def rolling_features(spark, sf_dir):
    return _based(spark, sf_dir, hist.rolling_columns())


def ewma_features(spark, sf_dir):
    return _based(spark, sf_dir, hist.ewma_columns())


def trend_slope(spark, sf_dir):
    return _based(spark, sf_dir, {k: v for k, v in hist.trend_columns().items() if "slope" in k})


def growth_28_84(spark, sf_dir):
    return _based(spark, sf_dir, {k: v for k, v in hist.trend_columns().items() if "growth" in k})


def yoy_ratio(spark, sf_dir):
    d = tables.daily_series(spark, sf_dir)
    return hist.yoy_ratio(hist.horizon_matrix(d), d).select(*KEY, rounded(F.col("yoy_ratio")).alias("yoy_ratio"))


def same_holiday_last_year(spark, sf_dir):
    d = tables.daily_series(spark, sf_dir)
    return hist.same_holiday_last_year(d.select("series_id", F.col("date").alias("target_date")), d, _workdays(spark, sf_dir))


def interaction_features(spark, sf_dir):
    """Only what the interactions name is built, not the whole matrix."""
    d = tables.daily_series(spark, sf_dir)
    means = {k: v for k, v in hist.rolling_columns([7, 28]).items() if k in ("rolling_mean_7", "rolling_mean_28", "rolling_std_28")}
    flags = cal.holiday_flags(_dates(spark, sf_dir), calendars.holiday_anchors(spark)).select("target_date", *[f"is_{h}" for h in hist.RECENT])
    m = hist.with_base(hist.with_past(hist.horizon_matrix(d), hist.offset_map(d, hist.INTERACTION_OFFSETS)), hist.base_features(d, means)).join(F.broadcast(flags), "target_date")
    lags = hist.lag_anchor_columns() | hist.lag_columns() | hist.same_dow_columns()
    m = m.select("*", *[lags[n].alias(n) for n in ("lag_anchor_7", "lag_anchor_14", "lag_365", "same_dow_mean_4w")])
    return _round(m.select(*KEY, *[c.alias(n) for n, c in hist.interaction_columns().items()]), KEY)


def sample_weights(spark, sf_dir):
    from horizonspark.plans.matrix import holiday_mask_columns

    d = tables.daily_series(spark, sf_dir)
    m = cal.typhoon_flag(cal.holiday_flags(hist.horizon_matrix(d), calendars.holiday_anchors(spark)), calendars.storm_days(spark))
    return hist.sample_weights(m, holiday_mask_columns(m.columns)).select(*KEY, rounded(F.col("weight")).alias("weight"))


def cross_holiday_expected(spark, sf_dir):
    d = tables.daily_series(spark, sf_dir)
    return hist.cross_holiday_expected(hist.horizon_matrix(d), d, cal.workday_blocks(_workdays(spark, sf_dir))).select(*KEY, rounded(F.col("expected_demand_at_block_pos")).alias("expected_demand_at_block_pos"))


def ratio_baseline(spark, sf_dir):
    d = tables.daily_series(spark, sf_dir)
    m = hist.with_base(hist.with_past(hist.horizon_matrix(d), hist.offset_map(d)), hist.base_features(d, hist.rolling_columns([7, 28])))
    base = F.coalesce(hist.same_dow_columns()["same_dow_mean_4w"], "rolling_mean_28", "rolling_mean_7")
    return m.select(*KEY, rounded(base).alias("baseline"))


def reservation_snapshot(spark, sf_dir):
    return res.snapshot(tables.stays(spark, sf_dir))


def reservation_dedup(spark, sf_dir):
    return res.keep_last(tables.stays(spark, sf_dir).select("update_date", "inhouse_date", "patron_id", "seq"), ["update_date", "inhouse_date"])


def _reserved(spark, sf_dir):
    m = hist.horizon_matrix(tables.daily_series(spark, sf_dir))
    return res.reservation_features(m.select(*KEY, "base_date"), res.snapshot(tables.stays(spark, sf_dir)))


def reservation_features(spark, sf_dir):
    return _reserved(spark, sf_dir).select(*KEY, "res_otb", "res_pickup_7d")


def reservation_zscore(spark, sf_dir):
    return res.zscore_by_dow(_reserved(spark, sf_dir)).select(*KEY, rounded(F.col("res_dow_zscore")).alias("res_dow_zscore"))


def coverage_report(spark, sf_dir):
    from horizonspark.operators.series import coverage

    return _round(coverage(tables.daily_series(spark, sf_dir)), [])


QUERIES = {
    f.__name__: f
    for f in (
        daily_series, pad_future, gap_check, trailing_actuals, holdout_split, train_split, horizon_matrix, calendar_features, holiday_dates, holiday_flags, holiday_onehots,
        holiday_distance, holiday_membership, workday_blocks, typhoon_flag, lag_features, lag_anchor_features, same_dow_features, yoy_growth_dow, rolling_features, ewma_features,
        trend_slope, growth_28_84, yoy_ratio, same_holiday_last_year, interaction_features, sample_weights, cross_holiday_expected, ratio_baseline, reservation_snapshot,
        reservation_dedup, reservation_features, reservation_zscore, coverage_report,
    )
}

_D = S.with_(S.DAILY)
_G = S.with_(S.DAILY, S.GRID)
_B = S.with_(S.DAILY, S.GRID, S.BASES)
_T = S.with_(S.DAILY, S.DATES)
_K = "g.series_id, g.target_date, g.horizon"
_BLOCKS = """off AS (SELECT date, date - row_number() OVER (ORDER BY date)::INT AS island FROM workdays WHERE NOT is_workday),
blk AS (SELECT date, count(*) OVER (PARTITION BY island)::INT AS n, (date - min(date) OVER (PARTITION BY island))::INT + 1 AS i FROM off)"""


def _based_sql(columns: dict[str, str]) -> str:
    inner = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return _B + f"SELECT {_K}, " + ", ".join(f"round(f.{n}, 6) AS {n}" for n in columns) + f" FROM grid g JOIN (SELECT b.series_id, b.base_date, {inner} FROM bases b) f ON f.series_id = g.series_id AND f.base_date = g.base_date"


def _rolling_sql(windows=hist.WINDOWS) -> dict[str, str]:
    out = {}
    for w in windows:
        out[f"rolling_mean_{w}"] = S.window("avg(demand)", w)
        out[f"rolling_std_{w}"] = S.window("CASE WHEN count(demand) > 1 THEN stddev_pop(demand) END", w)
        out[f"rolling_max_{w}"] = S.window("max(demand)", w)
        out[f"rolling_min_{w}"] = S.window("min(demand)", w)
    return out


def _same_dow(k: int) -> str:
    return f"(SELECT avg(d.demand) FROM daily d, range(1, {k + 1}) t(k) WHERE d.series_id = g.series_id AND d.date = g.target_date - 7 * k::INT AND 7 * k >= g.horizon + 1)"


def _lag(n: int) -> str:
    return f"CASE WHEN {n} >= g.horizon + 1 THEN (SELECT d.demand FROM daily d WHERE d.series_id = g.series_id AND d.date = g.target_date - {n}) END"


def _anchor(n: int) -> str:
    return f"(SELECT d.demand FROM daily d WHERE d.series_id = g.series_id AND d.date = g.target_date - greatest({n}, g.horizon + 1))"


def _ewma(span: int) -> str:
    w = f"pow({1 - 2 / (span + 1)!r}, b.base_date - d.date)"
    return f"(SELECT sum(d.demand * {w}) / sum({w}) FROM daily d WHERE d.series_id = b.series_id AND d.date BETWEEN b.base_date - {3 * span - 1} AND b.base_date)"


def _dow4(shift: int) -> str:
    """The four newest same-weekday values of each target date, from the first safe week on."""
    return f"""SELECT series_id, target_date, first_week, avg(v) AS m, count(*) AS n FROM (
        SELECT w.series_id, w.target_date, first_week, d.demand AS v, row_number() OVER (PARTITION BY w.series_id, w.target_date, first_week ORDER BY k) AS rn
        FROM weeks w JOIN daily d ON d.series_id = w.series_id AND d.date = w.target_date - {shift} - 7 * w.k WHERE k >= first_week) WHERE rn <= 4 GROUP BY ALL"""


_GROWTH_OK = f"{S.window('count(demand)', 28)} >= 14 AND {S.window('count(demand)', 28, 56)} >= 14 AND {S.window('avg(demand)', 28, 56)} > 0"


def _interaction_sql() -> str:
    floor_ = lambda x: f"CASE WHEN {x} IS NOT NULL THEN greatest({x}, 1) END"
    base = ", ".join(f"{e} AS {n}" for n, e in _rolling_sql([7, 28]).items() if n in ("rolling_mean_7", "rolling_mean_28", "rolling_std_28"))
    flags = ", ".join(f"(EXISTS (SELECT 1 FROM hdays WHERE day = g.target_date AND holiday = '{h}'))::INT AS is_{h}" for h in ("CNY", "GoldenWeek", "Labour", "MidAutumn"))
    cols = {
        "lag_anchor_7_per_table": f"a7 / {floor_('floortables')}",
        "lag_anchor_14_per_table": f"a14 / {floor_('floortables')}",
        "trend_7_vs_28": f"rolling_mean_7 / {floor_('rolling_mean_28')}",
        "trend_diff_7_28": "rolling_mean_7 - rolling_mean_28",
        "lag_anchor_7_zscore": f"(a7 - rolling_mean_28) / {floor_('rolling_std_28')}",
        "same_dow_vs_overall": f"s4 / {floor_('rolling_mean_28')}",
        "yoy_anchor_diff": "a7 - l365",
    } | {f"{h}_x_recent": f"is_{h} * rolling_mean_28" for h in ("CNY", "GoldenWeek", "Labour", "MidAutumn")}
    return S.with_(
        S.DAILY, S.GRID, S.BASES, S.ANCHORS, S.HOLIDAY_DAYS, f"f AS (SELECT b.series_id, b.base_date, {base} FROM bases b)", f"flags AS (SELECT target_date, {flags} FROM (SELECT DISTINCT target_date FROM grid) g)",
        f"x AS (SELECT {_K}, g.floortables, f.* EXCLUDE (series_id, base_date), flags.* EXCLUDE (target_date), {_anchor(7)} AS a7, {_anchor(14)} AS a14, {_lag(365)} AS l365, {_same_dow(4)} AS s4 "
        "FROM grid g JOIN f ON f.series_id = g.series_id AND f.base_date = g.base_date JOIN flags ON flags.target_date = g.target_date)",
    ) + "SELECT series_id, target_date, horizon, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in cols.items()) + " FROM x"


_SQL_CAL = ["isodow(target_date) - 1", "day(target_date)", "(day(target_date) - 1) // 7 + 1", "month(target_date)", "quarter(target_date)", "year(target_date)", "dayofyear(target_date)"]
_SINCOS = ", ".join(f"round({f}({2 * math.pi!r} * {x} / {p}), 6) AS {n}_{f}" for n, x, p in (("dow", "(isodow(target_date) - 1)", 7), ("month", "month(target_date)", 12), ("doy", "dayofyear(target_date)", 365)) for f in ("sin", "cos"))

SQL = {
    "daily_series": _D + "SELECT * FROM daily",
    "pad_future": _D + """, e AS (SELECT series_id, max(date) AS last, max_by(floortables, date) AS ft FROM daily GROUP BY ALL)
        SELECT series_id, date, demand, floortables FROM daily UNION ALL SELECT series_id, last + k::INT, NULL, ft FROM e, range(1, 29) t(k)""",
    "gap_check": _D + """, e AS (SELECT series_id, min(date) AS a, max(date) AS b FROM daily GROUP BY ALL), s AS (SELECT series_id, unnest(range(a, b + 1, INTERVAL 1 DAY))::DATE AS date FROM e)
        SELECT * FROM s EXCEPT SELECT series_id, date FROM daily""",
    "trailing_actuals": _D + "SELECT series_id, date, demand FROM daily QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 60",
    "holdout_split": _D + "SELECT series_id, date, demand, floortables, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 28 AS in_holdout FROM daily",
    "train_split": _G + "SELECT series_id, horizon, count(*) AS n_rows, min(target_date) AS first_date, max(target_date) AS last_date FROM grid WHERE target_date <= (SELECT max(date) - 28 FROM daily) AND y IS NOT NULL GROUP BY ALL",
    "horizon_matrix": _G + "SELECT * FROM grid",
    "calendar_features": _T + f"""SELECT target_date, {_SQL_CAL[0]} AS dow, {_SQL_CAL[1]} AS day, {_SQL_CAL[2]} AS week_of_month, {_SQL_CAL[3]} AS month, {_SQL_CAL[4]} AS quarter, {_SQL_CAL[5]} AS year, {_SQL_CAL[6]} AS day_of_year,
        (isodow(target_date) > 5)::INT AS is_weekend, (isodow(target_date) = 5)::INT AS is_friday, (isodow(target_date) = 6)::INT AS is_saturday, (isodow(target_date) = 7)::INT AS is_sunday,
        (day(target_date) <= 3)::INT AS is_month_start, (day(target_date) >= 28)::INT AS is_month_end, {_SINCOS} FROM dates""",
    "holiday_dates": S.with_(S.DAILY, S.DATES, S.ANCHORS, S.HOLIDAY_DAYS) + "SELECT target_date AS date FROM dates WHERE target_date IN (SELECT day FROM hdays)",
    "holiday_flags": S.with_(S.DAILY, S.DATES, S.ANCHORS) + "SELECT target_date, " + ", ".join(f"(EXISTS (SELECT 1 FROM anchors WHERE holiday = '{h}' AND target_date BETWEEN anchor + ws AND anchor + we))::INT AS is_{h}" for h in calendars.ANCHORS) + " FROM dates",
    "holiday_onehots": S.with_(S.DAILY, S.DATES, S.ANCHORS, S.HOLIDAY_DAYS) + "SELECT target_date, " + ", ".join(
        [f"coalesce(max((holiday = '{h}' AND day_offset = {o})::INT), 0) AS {cal.offset_name(h, o)}" for h in calendars.ONE_HOT for o in range(calendars.WINDOWS[h][0], calendars.WINDOWS[h][1] + 1)]
        + [f"coalesce(max((isodow(target_date) = {k + 1} AND holiday = '{h}')::INT), 0) AS {h}_dow{k}" for h in calendars.ONE_HOT for k in range(7)]
        + [f"coalesce(max((isodow(target_date) = {k + 1} AND holiday IS NOT NULL)::INT), 0) AS holiday_dow{k}" for k in range(7)]
    ) + " FROM dates LEFT JOIN hdays ON day = target_date GROUP BY target_date",
    "holiday_distance": S.with_(S.DAILY, S.DATES, S.ANCHORS) + """SELECT target_date, least(366, coalesce((SELECT min(anchor) FROM anchors WHERE anchor >= target_date) - target_date, 366))::INT AS days_to_next_holiday,
        least(366, coalesce(target_date - (SELECT max(anchor) FROM anchors WHERE anchor <= target_date), 366))::INT AS days_from_last_holiday FROM dates""",
    "holiday_membership": S.with_(S.DAILY, S.DATES, S.ANCHORS, S.HOLIDAY_DAYS) + """, m AS (SELECT * FROM hdays QUALIFY row_number() OVER (PARTITION BY day ORDER BY ord, anchor_ord) = 1)
        SELECT target_date, holiday, day_offset FROM dates LEFT JOIN m ON day = target_date""",
    "workday_blocks": S.with_(S.DAILY, S.DATES, S.WORKDAYS, _BLOCKS) + """SELECT w.date, coalesce(n, 0) AS mainland_block_length, coalesce(i, 0) AS mainland_block_day_index, coalesce(i = 1, false)::INT AS mainland_is_first_block_day,
        coalesce(i = n, false)::INT AS mainland_is_last_block_day, w.is_workday::INT AS mainland_is_workday, round(coalesce(i / n, 0.0), 6) AS mainland_block_pos_norm
        FROM workdays w JOIN dates ON target_date = w.date LEFT JOIN blk ON blk.date = w.date""",
    "typhoon_flag": S.with_(S.DAILY, S.DATES, S.STORMS) + "SELECT target_date, (EXISTS (SELECT 1 FROM storms WHERE date = target_date AND highest_signal >= 8))::INT AS is_typhoon_t8plus FROM dates",
    "lag_features": _G + f"SELECT {_K}, " + S.lag_selects() + " FROM grid g " + S.lag_joins(),
    "lag_anchor_features": _G + f"SELECT {_K}, " + ", ".join(f"a{n}.demand AS lag_anchor_{n}" for n in hist.ANCHOR_LAGS) + " FROM grid g " + S.anchor_joins(),
    "same_dow_features": _G + f""", weeks AS (SELECT series_id, date AS target_date, f::INT AS first_week, k::INT AS k FROM daily, range(1, 6) a(f), range(1, 9) b(k)),
        s AS (SELECT w.series_id, w.target_date, first_week, avg(CASE WHEN k <= 4 THEN demand END) AS m4, avg(demand) AS m8 FROM weeks w JOIN daily d ON d.series_id = w.series_id AND d.date = w.target_date - 7 * w.k WHERE k >= first_week GROUP BY ALL)
        SELECT {_K}, round(m4, 6) AS same_dow_mean_4w, round(m8, 6) AS same_dow_mean_8w FROM (SELECT *, (horizon + 7) // 7 AS first_week FROM grid) g LEFT JOIN s ON s.series_id = g.series_id AND s.target_date = g.target_date AND s.first_week = g.first_week""",
    "yoy_growth_dow": _G + f""", weeks AS (SELECT series_id, date AS target_date, f::INT AS first_week, k::INT AS k FROM daily, range(1, 6) a(f), range(1, 13) b(k)), a AS ({_dow4(0)}), o AS ({_dow4(365)})
        SELECT {_K}, round(CASE WHEN a.n >= 2 AND o.n >= 2 AND o.m > 0 THEN a.m / o.m END, 6) AS yoy_growth_same_dow FROM (SELECT *, (horizon + 7) // 7 AS first_week FROM grid) g
        LEFT JOIN a ON a.series_id = g.series_id AND a.target_date = g.target_date AND a.first_week = g.first_week LEFT JOIN o ON o.series_id = g.series_id AND o.target_date = g.target_date AND o.first_week = g.first_week""",
    "rolling_features": _based_sql(_rolling_sql()),
    "ewma_features": _based_sql({f"ewma_{s}": _ewma(s) for s in hist.SPANS}),
    "trend_slope": _based_sql({f"trend_slope_{w}d": S.window(f"CASE WHEN count(demand) >= {n} THEN regr_slope(demand, (date - DATE '2024-01-01')::DOUBLE) END", w) for w, n in ((90, 30), (180, 60))}),
    "growth_28_84": _based_sql({
        "growth_28_vs_84d": f"CASE WHEN {_GROWTH_OK} THEN {S.window('avg(demand)', 28)} / {S.window('avg(demand)', 28, 56)} END",
        "growth_28_vs_84d_diff": f"CASE WHEN {_GROWTH_OK} THEN {S.window('avg(demand)', 28)} - {S.window('avg(demand)', 28, 56)} END",
    }),
    "yoy_ratio": _G + f"SELECT {_K}, round(CASE WHEN o.demand > 0 THEN n.demand / o.demand END, 6) AS yoy_ratio FROM grid g LEFT JOIN daily n ON n.series_id = g.series_id AND n.date = g.base_date LEFT JOIN daily o ON o.series_id = g.series_id AND o.date = g.base_date - 365",
    "same_holiday_last_year": S.with_(S.DAILY, S.WORKDAYS) + """SELECT d.series_id, d.date AS target_date, CASE WHEN NOT w.is_workday AND NOT p.is_workday THEN l.demand END AS same_holiday_lastyear_lag
        FROM daily d LEFT JOIN workdays w ON w.date = d.date LEFT JOIN workdays p ON p.date = d.date - 364 LEFT JOIN daily l ON l.series_id = d.series_id AND l.date = d.date - 364""",
    "interaction_features": _interaction_sql(),
    "sample_weights": S.with_(S.DAILY, S.GRID, S.ANCHORS, S.STORMS) + f"""SELECT {_K}, round(pow(0.5, (max(target_date) OVER (PARTITION BY series_id, horizon) - target_date) / 240.0)
        * CASE WHEN EXISTS (SELECT 1 FROM anchors WHERE target_date BETWEEN anchor + ws AND anchor + we) OR EXISTS (SELECT 1 FROM storms WHERE date = target_date AND highest_signal >= 8) THEN 3.0 ELSE 1.0 END, 6) AS weight FROM grid g""",
    "cross_holiday_expected": "WITH " + S.DAILY.replace("daily AS (", "daily AS MATERIALIZED (") + ",\n" + ",\n".join([S.WORKDAYS, _BLOCKS]) + """, p AS MATERIALIZED (SELECT date, i FROM blk WHERE n >= 2),
        seen AS MATERIALIZED (SELECT d.series_id, p.i, d.date, d.demand, row_number() OVER (PARTITION BY d.series_id, p.i ORDER BY d.date) AS rn FROM daily d JOIN p USING (date) WHERE d.demand IS NOT NULL),
        g AS MATERIALIZED (SELECT series_id, date AS target_date, h::INT AS horizon, date - (h::INT + 1) AS base_date, p.i FROM daily LEFT JOIN p USING (date), range(1, 29) t(h)),
        q AS MATERIALIZED (SELECT DISTINCT series_id, i, base_date FROM g WHERE i IS NOT NULL),
        f AS MATERIALIZED (SELECT q.*, s.rn AS top FROM q ASOF JOIN seen s ON s.series_id = q.series_id AND s.i = q.i AND q.base_date >= s.date),
        a AS MATERIALIZED (SELECT f.series_id, f.i, f.base_date, avg(s.demand) AS e FROM f, range(0, 5) t(k), seen s WHERE s.series_id = f.series_id AND s.i = f.i AND s.rn = f.top - k AND s.date >= f.base_date - 798 GROUP BY ALL)
        SELECT g.series_id, g.target_date, g.horizon, round(a.e, 6) AS expected_demand_at_block_pos FROM g LEFT JOIN a ON a.series_id = g.series_id AND a.i = g.i AND a.base_date = g.base_date""",
    "ratio_baseline": _B + f", f AS (SELECT b.series_id, b.base_date, {S.window('avg(demand)', 28)} AS r28, {S.window('avg(demand)', 7)} AS r7 FROM bases b) SELECT {_K}, round(coalesce({_same_dow(4)}, r28, r7), 6) AS baseline FROM grid g JOIN f ON f.series_id = g.series_id AND f.base_date = g.base_date",
    "reservation_snapshot": S.with_(S.STAYS, S.SNAPS) + "SELECT * FROM snaps",
    "reservation_dedup": S.with_(S.STAYS) + "SELECT * FROM stays QUALIFY row_number() OVER (PARTITION BY update_date, inhouse_date ORDER BY seq DESC) = 1",
    "reservation_features": S.with_(S.DAILY, S.GRID, S.STAYS, S.SNAPS) + f"SELECT {_K}, n.rooms_otb AS res_otb, n.rooms_otb - o.rooms_otb AS res_pickup_7d FROM grid g LEFT JOIN snaps n ON n.inhouse_date = g.target_date AND n.update_date = g.base_date LEFT JOIN snaps o ON o.inhouse_date = g.target_date AND o.update_date = g.base_date - 7",
    "reservation_zscore": S.with_(S.DAILY, S.GRID, S.STAYS, S.SNAPS) + f""", r AS (SELECT {_K}, n.rooms_otb AS x FROM grid g LEFT JOIN snaps n ON n.inhouse_date = g.target_date AND n.update_date = g.base_date),
        z AS (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s, count(x) OVER w AS n FROM r WINDOW w AS (PARTITION BY isodow(target_date)))
        SELECT series_id, target_date, horizon, round(CASE WHEN n >= 3 AND s > 0 THEN (x - m) / s END, 6) AS res_dow_zscore FROM z""",
    "coverage_report": _D + """SELECT series_id, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, (max(date) - min(date))::INT + 1 AS span_days, (max(date) - min(date) + 1 - count(*))::BIGINT AS n_gaps, round(count(*) / (max(date) - min(date) + 1), 6) AS coverage FROM daily GROUP BY ALL""",
}
