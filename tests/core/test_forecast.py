"""The forecast from end to end on a series with a weekly pattern."""

import datetime as dt
import math

import pytest

from horizonspark import calendars, cli
from horizonspark.operators import dates
from horizonspark.plans.forecast import make_forecast
from horizonspark.sources import files

FIRST, RUN = dt.date(2025, 1, 1), dt.date(2026, 1, 31)


def value(d):
    return 100 + 30 * math.sin(2 * math.pi * d.weekday() / 7) + (d - FIRST).days * 0.05


def rows(last):
    return [(d, value(d), 50.0) for k in range((last - FIRST).days + 1) for d in [FIRST + dt.timedelta(days=k)]]


@pytest.mark.parametrize("full,blend", [(False, "equal"), (True, "selection")])
def test_forecast(spark, full, blend):
    daily = spark.createDataFrame([("s", *r) for r in rows(RUN + dt.timedelta(days=5))], "series_id string, date date, demand double, floortables double")
    work = calendars.weekday_calendar(spark, "2024-12-01", "2026-06-30")
    out = make_forecast(spark, daily, work, RUN, full, blend, scale=0.015 if full else 0.06).collect()
    assert sorted(r["horizon"] for r in out) == list(range(1, 29)) and min(r["target_date"] for r in out) == RUN + dt.timedelta(days=1)
    assert all(0 <= r["p10"] <= r["p50"] <= r["p90"] for r in out)
    mape = sum(abs(r["p50"] - value(r["target_date"])) / value(r["target_date"]) for r in out) / 28
    assert mape < (0.25 if full else 0.12)
    with pytest.raises(ValueError):
        make_forecast(spark, daily, work, RUN + dt.timedelta(days=30))


def test_run_dates():
    last = dt.date(2026, 5, 28)
    plan = dates.initial_range("2026-06-01:2026-06-28")
    assert dates.run_date("2026-05-01", plan, last) == dt.date(2026, 5, 1) and dates.run_date(None, plan, last) == dt.date(2026, 5, 31) and dates.run_date(None, None, last) == last
    assert dates.is_usual_span(plan) and not dates.is_usual_span((plan[0], plan[0]))
    with pytest.raises(ValueError):
        dates.initial_range("2026-06-28:2026-06-01")


def test_command_line_signals(spark, tmp_path):
    line = "\t".join(["1", "T", "Yagi", "8", "N", "0", "5", "9", "2024", "+", "0", "6", "9", "2024", "+", "1"])
    (tmp_path / "r.txt").write_text(line + "\n\nbroken\n")
    cli.main(["signals", "--records", str(tmp_path / "r.txt"), "--out", str(tmp_path / "o")], spark)
    got = files.read_storms(spark, str(tmp_path / "o")).collect()
    assert [(r["date"].day, r["typhoon_name"], r["highest_signal"]) for r in got] == [(5, "YAGI", 8), (6, "YAGI", 8)]
