"""Common table expressions of the SQL that the queries are checked against."""

from __future__ import annotations

from horizonspark import calendars
from horizonspark.operators.history import ANCHOR_LAGS, LAGS
from horizonspark.sources.tables import SHIFT

DAILY = f"""daily AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) + {SHIFT} AS date, count(*)::DOUBLE AS demand, count(DISTINCT o_custkey)::DOUBLE AS floortables
  FROM orders GROUP BY ALL)"""
#: A series' newest date; the schedule is its newest AHEAD days, and the validation all days before.
AHEAD = 28
ENDS = "ends AS (SELECT series_id, max(date) AS last FROM daily GROUP BY ALL)"
DATES = "dates AS (SELECT DISTINCT date AS target_date FROM daily)"
GRID = """grid AS (
  SELECT series_id, date AS target_date, h::INT AS horizon, date - (h::INT + 1) AS base_date, floortables, demand AS y FROM daily, range(1, 29) t(h))"""
BASES = "bases AS (SELECT DISTINCT series_id, base_date FROM grid)"
ANCHORS = "anchors(holiday, ord, anchor, anchor_ord, ws, we) AS (VALUES " + ", ".join(
    f"('{h}', {i}, DATE '{a}', {j}, {calendars.WINDOWS[h][0]}, {calendars.WINDOWS[h][1]})" for i, (h, days) in enumerate(calendars.ANCHORS.items()) for j, a in enumerate(days)
) + ")"
HOLIDAY_DAYS = "hdays AS (SELECT anchor + o::INT AS day, holiday, ord, anchor_ord, o::INT AS day_offset FROM anchors, unnest(range(ws, we + 1)) t(o))"
STORMS = "storms(date, typhoon_name, highest_signal) AS (VALUES " + ", ".join(f"(DATE '{d}', '{n}', {s})" for d, n, s in calendars.STORMS) + ")"
WORKDAYS = "workdays AS (SELECT d::DATE AS date, isodow(d) < 6 AS is_workday FROM (SELECT unnest(range(min(date) - 31, max(date) + 65, INTERVAL 1 DAY)) AS d FROM daily))"
STAYS = f"""stays AS (
  SELECT CAST(o_orderdate AS DATE) + {SHIFT} AS update_date, CAST(l_shipdate AS DATE) + {SHIFT} AS inhouse_date, o_custkey AS patron_id, o_orderkey * 10 + l_linenumber AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SNAPS = """snaps AS (
  SELECT update_date, inhouse_date, count(*)::DOUBLE AS rooms_otb, (inhouse_date - update_date)::INT AS lead_time FROM stays
  WHERE inhouse_date - update_date BETWEEN 1 AND 60 GROUP BY ALL)"""
HOURLY = "hourly AS (SELECT CAST(ts AS DATE) AS date, hour(ts)::INT AS hour, sum(value) AS demand FROM events GROUP BY ALL)"
SHARES = """shares AS (
  SELECT date, hour, demand / sum(demand) OVER (PARTITION BY date) AS share FROM hourly
  WHERE date IN (SELECT date FROM hourly WHERE demand IS NOT NULL GROUP BY date HAVING count(DISTINCT hour) = 24 AND sum(demand) > 0))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def lag_selects() -> str:
    return ", ".join(f"CASE WHEN {n} >= horizon + 1 THEN l{n}.demand END AS lag_{n}" for n in LAGS)


def lag_joins(lags: list[int] = LAGS) -> str:
    return "\n".join(f"LEFT JOIN daily l{n} ON l{n}.series_id = g.series_id AND l{n}.date = g.target_date - {n}" for n in lags)


def anchor_joins(lags: list[int] = ANCHOR_LAGS) -> str:
    return "\n".join(f"LEFT JOIN daily a{n} ON a{n}.series_id = g.series_id AND a{n}.date = g.target_date - greatest({n}, g.horizon + 1)" for n in lags)


def window(fn: str, w: int, back: int = 0) -> str:
    return f"(SELECT {fn} FROM daily d WHERE d.series_id = b.series_id AND d.date BETWEEN b.base_date - {w - 1 + back} AND b.base_date - {back})"
