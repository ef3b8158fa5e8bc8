"""The commands for hourly patterns, hourly splits and tracking, over files, against values worked out by hand."""

import csv
import datetime as dt
import glob

import pytest

from horizonspark import cli
from horizonspark.sources import files

RUN = dt.date(2026, 1, 31)


def rows_of(path):
    return [r for f in sorted(glob.glob(f"{path}/*.csv")) for r in csv.DictReader(open(f))]


def hours(d):
    """Weekend days peak late, others early."""
    return [10.0 if (h >= 12) == (d.weekday() >= 5) else 2.0 for h in range(24)]


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    days = [dt.date(2024, 6, 1) + dt.timedelta(days=k) for k in range((RUN - dt.date(2024, 6, 1)).days + 1)]
    (root / "hourly.csv").write_text("date,hour,demand\n" + "".join(f"{d},{h},{v}\n" for d in days for h, v in enumerate(hours(d))))
    (root / "daily.csv").write_text("date,demand,floortables\n" + "".join(f"{d},{sum(hours(d))},5\n" for d in days))
    rows = [(r, RUN + dt.timedelta(days=k), 50.0 + i, 100.0 + i, 150.0 + i) for i, r in enumerate([RUN - dt.timedelta(days=7), RUN]) for k in range(1, 15)]
    files.write_run(spark.createDataFrame(rows, "run_date date, date date, p10 double, p50 double, p90 double"), f"{root}/runs")
    for r, span in ((RUN - dt.timedelta(days=7), ["2026-01-30", "2026-02-05"]), (RUN, None)):
        m = spark.createDataFrame([(str(r), "m", 28, span is not None, span)], "run_date string, model string, horizon_days int, initial_forecast boolean, initial_forecast_range array<string>")
        for _ in range(2):  # a run that is written again replaces its record
            files.write_metadata(m, f"{root}/metadata", str(r))
    return root


def test_hourly(spark, out):
    cli.main(["hourly-patterns", "--hourly", f"{out}/hourly.csv", "--out", f"{out}/patterns"], spark)
    decided, profile = rows_of(f"{out}/patterns/decisions"), rows_of(f"{out}/patterns/profiles")
    assert decided and {r["decision"] for r in decided} <= {"USE_WEEKDAY", "USE_FRIDAY", "USE_SATURDAY", "USE_SUNDAY", "USE_HOLIDAY_PROFILE"}
    for r in decided:
        assert sum(bool(r[c]) for c in r if c.endswith("_date")) == int(r["n_occurrences"]) and float(r["occ1_best_tvd"]) == 0
    cells = {(r["holiday"], r["day_offset"]) for r in decided}
    assert {(r["holiday"], r["day_offset"]) for r in profile} == cells and len(profile) == 24 * len(cells)
    cli.main(["hourly-split", "--run-date", str(RUN), "--hourly", f"{out}/hourly.csv", "--patterns", f"{out}/patterns", "--out", str(out)], spark)
    got = rows_of(f"{out}/hourly/run_20260131")
    assert len(got) == 14 * 24
    for d in {r["date"] for r in got}:
        mine = sorted((r for r in got if r["date"] == d), key=lambda r: int(r["hour"]))
        assert abs(sum(float(r["p50"]) for r in mine) - 101) < 0.01
        if mine[0]["strategy"].startswith("dow_"):
            want = hours(dt.date.fromisoformat(d))
            assert [float(r["p50"]) for r in mine] == [round(101 * v / sum(want), 4) for v in want]
    with pytest.raises(ValueError):
        cli.main(["hourly-split", "--run-date", "2020-01-01", "--hourly", f"{out}/hourly.csv", "--patterns", f"{out}/patterns", "--out", str(out)], spark)


def test_track(spark, out):
    cli.main(["track", "--daily", f"{out}/daily.csv", "--out", str(out)], spark)
    assert [(r["run_date"], float(r["p50_sum"])) for r in rows_of(f"{out}/trend")] == [(str(RUN - dt.timedelta(days=7)), 1400.0), (str(RUN), 1414.0)]
    assert len(rows_of(f"{out}/overlay")) == 28
    t = rows_of(f"{out}/tracking")
    assert [r["date"] for r in t] == [str(dt.date(2026, 1, 30) + dt.timedelta(days=k)) for k in range(7)]
    assert [(r["initial_p50"], r["latest_p50"]) for r in t][1:3] == [("", ""), ("100.0", "101.0")] and float(t[0]["actual"]) == sum(hours(RUN)) and t[2]["actual"] == ""


def test_workday_files(spark, tmp_path):
    (tmp_path / "w.csv").write_text("date,is_workday\n2026-01-01,false\n")
    assert [tuple(r) for r in files.read_workdays(spark, f"{tmp_path}/w.csv").collect()] == [(dt.date(2026, 1, 1), False)]
