"""Queries of stored runs, fingerprints and the refresh of a matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonspark.functions import rounded
from horizonspark.operators import history as hist
from horizonspark.operators.refresh import history_matrix, refresh_matrix
from horizonspark.plans import features, operations
from horizonspark.plans import sql as S
from horizonspark.sources import signals, tables
from horizonspark.sources.store import RunStore, fingerprint, work_folder

#: The newest days that a refreshed matrix has not seen, the place from the end of the run that is written again, and its factor.
NEW_DAYS, REWRITTEN, FACTOR = 7, 3, 1.25
SHOWN = ["lag_7", "lag_28", "lag_365", "lag_728", "lag_anchor_14", "rolling_mean_28", "rolling_std_7", "ewma_28", "same_dow_mean_8w", "yoy_ratio"]


def run_store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly runs of all orders are written to a store, the third from the end once more with other values; the newest six are read."""
    store = RunStore(spark, work_folder(spark, "runs"))
    store.write(operations.weekly_runs(spark, sf_dir))
    third = store.newest(REWRITTEN).where(F.col("rank") == REWRITTEN).select("run_date")
    again = operations.weekly_runs(spark, sf_dir).join(F.broadcast(third), "run_date")
    store.write(again.select("run_date", "date", *[(F.col(c) * FACTOR).alias(c) for c in ("p10", "p50", "p90")]))
    return store.latest(6).select("run_date", "date", *[rounded(F.col(c)).alias(c) for c in ("p10", "p50", "p90")])


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each daily series, whole numbers as such."""
    d = tables.daily_series(spark, sf_dir)
    return fingerprint(d.select("series_id", "date", F.col("demand").cast("bigint").alias("demand"), F.col("floortables").cast("bigint").alias("floortables")), ["series_id"])


def matrix_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history matrix of all orders, from the matrix without each series' newest week and that week."""
    new = tables.daily_series(spark, sf_dir)
    ends = new.groupBy("series_id").agg(F.date_sub(F.max("date"), NEW_DAYS).alias("known"))
    old = new.join(ends, "series_id").where("date <= known").drop("known")
    path = work_folder(spark, "matrix")
    history_matrix(old).write.parquet(path)
    out = refresh_matrix(spark.read.parquet(path), old, new)
    return features._round(out.select(*hist.KEY, "y", *SHOWN), hist.KEY)


def signal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of interval_parse, written as text files and read again by the data source of signal records."""
    path = work_folder(spark, "records")
    operations.record_lines(spark, sf_dir).write.text(path)
    signals.register(spark)
    return spark.read.format("signal_records").load(path).where("corrupt is null").select("start", "end", "signal", "name")


QUERIES = {f.__name__: f for f in (run_store_latest, table_fingerprint, matrix_refresh, signal_records)}

_PAST = {"lag_7": 7, "lag_28": 28, "lag_365": 365, "lag_728": 728}
_WINDOWS = {"rolling_mean_28": S.window("avg(demand)", 28), "rolling_std_7": S.window("CASE WHEN count(demand) > 1 THEN stddev_pop(demand) END", 7), "ewma_28": features._ewma(28)}
SQL = {
    "signal_records": operations.SQL["interval_parse"],
    "run_store_latest": S.with_(S.DAILY, operations.RUNS_SQL).rstrip() + f""", n AS (SELECT *, dense_rank() OVER (ORDER BY run_date DESC) AS r FROM runs)
        SELECT run_date, date, round(p50 * 0.9 * f, 6) AS p10, round(p50 * f, 6) AS p50, round(p50 * 1.1 * f, 6) AS p90 FROM (SELECT *, CASE WHEN r = {REWRITTEN} THEN {FACTOR} ELSE 1 END::DOUBLE AS f FROM n WHERE r <= 6)""",
    "table_fingerprint": S.with_(S.DAILY) + """, r AS (SELECT series_id, md5(strlen(date::VARCHAR) || ':' || date || coalesce(strlen(demand::BIGINT::VARCHAR) || ':' || demand::BIGINT, '-') || coalesce(strlen(floortables::BIGINT::VARCHAR) || ':' || floortables::BIGINT, '-')) AS h FROM daily)
        SELECT series_id, count(*) AS n_rows, md5(count(*) || ':' || """ + " || ':' || ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)" for i in range(4)) + ") AS fingerprint FROM r GROUP BY ALL",
    "matrix_refresh": S.with_(S.DAILY, S.GRID, S.BASES, "f AS (SELECT b.series_id, b.base_date, " + ", ".join(f"{e} AS {n}" for n, e in _WINDOWS.items()) + " FROM bases b)", f"""weeks AS (SELECT series_id, date AS target_date, w::INT AS first_week, k::INT AS k FROM daily, range(1, 6) a(w), range(1, 9) b(k)),
        s8 AS (SELECT w.series_id, w.target_date, first_week, avg(demand) AS m8 FROM weeks w JOIN daily d ON d.series_id = w.series_id AND d.date = w.target_date - 7 * w.k WHERE k >= first_week GROUP BY ALL),
        y AS (SELECT n.series_id, n.date AS base_date, CASE WHEN o.demand > 0 THEN n.demand / o.demand END AS ratio FROM daily n JOIN daily o ON o.series_id = n.series_id AND o.date = n.date - 365)""")
    + "SELECT g.series_id, g.target_date, g.horizon, y, " + ", ".join(f"CASE WHEN {n} >= horizon + 1 THEN l{n}.demand END AS {c}" for c, n in _PAST.items()) + ", a14.demand AS lag_anchor_14, " + ", ".join(f"round({c}, 6) AS {c}" for c in _WINDOWS)
    + ", round(m8, 6) AS same_dow_mean_8w, round(ratio, 6) AS yoy_ratio FROM grid g JOIN f ON f.series_id = g.series_id AND f.base_date = g.base_date " + S.lag_joins(list(_PAST.values())) + " " + S.anchor_joins([14])
    + " LEFT JOIN s8 ON s8.series_id = g.series_id AND s8.target_date = g.target_date AND s8.first_week = (g.horizon + 7) // 7 LEFT JOIN y ON y.series_id = g.series_id AND y.base_date = g.base_date",
}
