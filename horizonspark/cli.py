"""Command line: forecasts, backtests, storm days, hourly patterns and splits, and tracking of runs, over files."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import functions as F

from horizonspark import calendars
from horizonspark.operators import dates, hourly, ingest, metrics, runs
from horizonspark.plans import hourly as hourly_plans
from horizonspark.plans.forecast import make_forecast
from horizonspark.session import session
from horizonspark.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="horizonspark")
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("forecast", help="28 days after the run date")
    f.add_argument("--daily", required=True)
    f.add_argument("--out", required=True)
    f.add_argument("--run-date")
    f.add_argument("--full", action="store_true")
    f.add_argument("--blend", choices=["equal", "selection"], default="equal")
    f.add_argument("--initial-forecast", help="FROM:TO of a plan to freeze")
    f.add_argument("--workdays", help="date, is_workday of a real calendar (default: Monday to Friday)")
    b = sub.add_parser("backtest", help="errors over the last 28 days")
    b.add_argument("--daily", required=True)
    b.add_argument("--holdout-end")
    b.add_argument("--fast", action="store_true")
    b.add_argument("--workdays")
    s = sub.add_parser("signals", help="storm days from interval records")
    s.add_argument("--records", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--since", type=int, default=2023)
    s.add_argument("--min-signal", type=int, default=8)
    h = sub.add_parser("hourly-patterns", help="which hours holidays have: decisions and profiles")
    h.add_argument("--hourly", required=True)
    h.add_argument("--out", required=True)
    x = sub.add_parser("hourly-split", help="hours of a run's days")
    x.add_argument("--run-date", required=True)
    x.add_argument("--hourly", required=True)
    x.add_argument("--patterns", required=True, help="the folder that hourly-patterns wrote")
    x.add_argument("--out", required=True, help="the folder that forecast wrote")
    t = sub.add_parser("track", help="the newest initial plan, the newest run and the actual values; the newest six runs; sums by run")
    t.add_argument("--daily", required=True)
    t.add_argument("--out", required=True, help="the folder that forecast wrote")
    return p


def _hourly_patterns(spark, a) -> None:
    wide, profile = hourly_plans.patterns(files.read_hourly(spark, a.hourly), calendars.holiday_anchors(spark))
    files.write_csv(wide, f"{a.out}/decisions", "holiday", "day_offset")
    files.write_csv(profile, f"{a.out}/profiles", "holiday", "day_offset", "hour")


def _hourly_split(spark, a) -> None:
    run = dt.date.fromisoformat(a.run_date)
    p = files.read_runs(spark, f"{a.out}/runs").where(F.col("run_date") == F.lit(run)).select("date", "p10", "p50", "p90")
    if p.isEmpty():
        raise ValueError(f"no forecast of {run} in {a.out}")
    decided = files.read_table(spark, f"{a.patterns}/decisions", "holiday string, day_offset int, decision string")
    profile = files.read_table(spark, f"{a.patterns}/profiles", "holiday string, day_offset int, hour int, share double")
    path = f"{a.out}/hourly/run_{run:%Y%m%d}"
    files.write_csv(hourly_plans.split_run(p, run, files.read_hourly(spark, a.hourly), calendars.holiday_anchors(spark), decided, profile), path, "date", "hour")
    written = files.read_table(spark, path, "date date, hour int, p50 double, strategy string")
    hourly.strategy_counts(written).orderBy(F.col("n_days").desc(), "strategy").show(truncate=False)
    hourly.reconcile(p, written).where("is_off").show()


def _track(spark, a) -> None:
    """Writes tracking (if a run froze a plan with its range), overlay and trend."""
    p = files.read_runs(spark, f"{a.out}/runs")
    files.write_csv(runs.latest_runs(p), f"{a.out}/overlay", "run_date", "date")
    files.write_csv(runs.run_summary(p), f"{a.out}/trend", "run_date")
    meta = files.read_metadata(spark, f"{a.out}/metadata", p).withColumn("run_date", F.to_date("run_date")).withColumn("initial_forecast", F.col("initial_forecast") & F.col("initial_forecast_range").isNotNull())
    span = meta.where("initial_forecast").orderBy(F.col("run_date").desc()).select("initial_forecast_range").first()
    if span:
        rows = runs.tracking(p, runs.run_picks(meta), files.read_daily(spark, a.daily), spark.sql("SELECT to_date(:a) AS first, to_date(:b) AS last", {"a": span[0][0], "b": span[0][1]}))
        files.write_csv(rows, f"{a.out}/tracking", "date")


def main(argv: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(argv)
    spark = spark or session()
    if a.command == "signals":
        days = ingest.intervals_to_days(files.parse_signals(spark.read.text(a.records)), a.since, a.min_signal)
        files.write_csv(days.select("date", F.col("names").alias("typhoon_name"), "highest_signal"), a.out, "date")
        return
    if a.command in ("hourly-patterns", "hourly-split", "track"):
        {"hourly-patterns": _hourly_patterns, "hourly-split": _hourly_split, "track": _track}[a.command](spark, a)
        return
    daily = files.read_daily(spark, a.daily).withColumn("series_id", F.lit("all"))
    last = daily.agg(F.max("date")).first()[0]
    workdays = files.read_workdays(spark, a.workdays) if a.workdays else calendars.weekday_calendar(spark, "2020-01-01", (last + dt.timedelta(days=400)).isoformat())
    if a.command == "backtest":
        end = dt.date.fromisoformat(a.holdout_end) if a.holdout_end else last
        run = end - dt.timedelta(days=dates.HORIZON_DAYS)
        p = make_forecast(spark, daily, workdays, run, full=not a.fast)
        rows = p.join(daily.select("series_id", F.col("date").alias("target_date"), F.col("demand").alias("y")), ["series_id", "target_date"]).withColumn("pred", F.col("p50"))
        metrics.error_metrics(rows, ["series_id"]).join(metrics.coverage(rows, ["series_id"]).drop("n"), "series_id").show()
        return
    plan = dates.initial_range(a.initial_forecast) if a.initial_forecast else None
    run = dates.run_date(a.run_date, plan, last)
    p = make_forecast(spark, daily, workdays, run, a.full, a.blend).select(F.lit(run).alias("run_date"), F.col("target_date").alias("date"), "p10", "p50", "p90")
    files.write_run(p, f"{a.out}/runs")
    meta = runs.run_summary(files.read_runs(spark, f"{a.out}/runs").where(F.col("run_date") == F.lit(run)))
    last_run = meta.select(
        F.col("run_date").cast("string").alias("run_date"), F.lit(a.blend if a.full else "lgbm_l2").alias("model"), F.lit(dates.HORIZON_DAYS).alias("horizon_days"),
        F.array(*[F.col(c).cast("string") for c in ("first_date", "last_date")]).alias("forecast_range"), "p50_min", "p50_max", "p50_mean", "p50_sum",
        F.lit(plan is not None).alias("initial_forecast"), (F.array(*[F.lit(str(d)) for d in plan]) if plan else F.lit(None).cast("array<string>")).alias("initial_forecast_range"),
    )
    files.write_metadata(last_run, f"{a.out}/metadata", str(run))


if __name__ == "__main__":
    main()
