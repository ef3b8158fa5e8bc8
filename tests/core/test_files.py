"""Readers, writers, the run registry and the stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from horizonspark.operators import runs
from horizonspark.operators.series import gaps, pad_future
from horizonspark.sources import files
from horizonspark.streaming import series


def write(path, text):
    path.write_text(text)
    return str(path)


def test_daily_in_any_column_order(spark, tmp_path):
    p = write(tmp_path / "d.csv", "floortables,date,demand\n5, 2024-01-01 ,10 \n6,2024-01-03,20\n")
    rows = files.read_daily(spark, p).collect()
    assert [tuple(r) for r in rows] == [(dt.date(2024, 1, 1), 10.0, 5.0), (dt.date(2024, 1, 3), 20.0, 6.0)]


def test_missing_storm_file_means_none(spark, tmp_path):
    assert files.read_storms(spark, str(tmp_path / "nothing.csv")).count() == 0
    p = write(tmp_path / "t.csv", "date,typhoon_name,highest_signal\n2024-09-05,YAGI,8\n")
    assert files.read_storms(spark, p).first()["highest_signal"] == 8


def test_reservations_of_both_formats(spark, tmp_path):
    a = write(tmp_path / "a.csv", "update_date,inhouse_date,rooms_otb\n2024-01-01,2024-01-05,3\n2024-01-01,2024-01-05,4\n2024-01-01,2024-01-06,x\n,2024-01-06,1\nbad,2024-01-06,1\n")
    assert [tuple(r)[2] for r in files.read_reservations(spark, a).collect()] == [4.0]
    b = write(tmp_path / "b.csv", "update_date,inhouse_date,patron_id\n2024-01-01,2024-01-05,p\n2024-01-01,2024-01-05,q\n,2024-01-05,r\n")
    assert [tuple(r)[2] for r in files.read_reservations(spark, b).collect()] == [2.0]
    c = write(tmp_path / "c.csv", "x,y\n1,2\n")
    assert files.read_reservations(spark, c).count() == 0 and files.read_reservations(spark, str(tmp_path / "no.csv")).count() == 0


def test_strict_reservations(spark, tmp_path):
    a = write(tmp_path / "a.csv", "update_date,inhouse_date,rooms_otb\n2024-01-01,2024-01-05,3\n2024-01-01,2024-01-05,4\n2024-01-01,2024-01-06,\n")
    assert sorted((str(r[1]), r[2] or 0) for r in files.read_reservations_strict(spark, a).collect()) == [("2024-01-05", 3.0), ("2024-01-05", 4.0), ("2024-01-06", 0)]
    b = write(tmp_path / "b.csv", "update_date,inhouse_date,patron_id,rooms_otb\n2024-01-01,2024-01-05,p,9\n2024-01-01,2024-01-05,q,9\n")
    assert [r[2] for r in files.read_reservations_strict(spark, b).collect()] == [2.0]
    for text in ("update_date,inhouse_date,rooms_otb\n2024-01-01,2024-01-05,x\n", "update_date,inhouse_date,rooms_otb\nbad,2024-01-05,1\n", "update_date,rooms_otb\n2024-01-01,1\n"):
        with pytest.raises(Exception, match="is no|inhouse_date"):
            files.read_reservations_strict(spark, write(tmp_path / "c.csv", text)).collect()
    assert files.read_reservations_strict(spark, str(tmp_path / "no.csv")).count() == 0


def test_signal_records(spark):
    ok = "﻿1\tT\tYagi\t8\tN\t0000\t5\t9\t2024\t+\t0100\t6\t9\t2024\t+\t1200"
    bad = [ok.replace("\t8\t", "\tx\t"), "\t".join(ok.split("\t")[:15]), ok[:-4], "", ok.replace("\t5\t9\t", "\t31\t2\t")]
    rows = files.parse_signals(spark.createDataFrame([(x,) for x in [ok, *bad]], "value string")).collect()
    assert [tuple(r) for r in rows] == [(dt.date(2024, 9, 5), dt.date(2024, 9, 6), 8, "Yagi")]


def test_a_line_of_signals_is_split_once(spark):
    lines = spark.range(3).select(F.concat_ws("\t", *[F.col("id").cast("string")] * 16).alias("value"))
    plan = files.parse_signals(lines)._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(f) for f in ("concat_ws(\t", "regexp_replace(", "split(", "RLIKE", "gettimestamp(")] == [1, 1, 1, 1, 2]


def test_runs_are_replaced_one_by_one(spark, tmp_path):
    root = str(tmp_path / "runs")
    rows = lambda run, v: spark.createDataFrame([(dt.date.fromisoformat(run), dt.date(2026, 6, 1), v)], "run_date date, date date, p50 double")
    files.write_run(rows("2026-05-20", 1.0), root)
    files.write_run(rows("2026-05-25", 2.0), root)
    files.write_run(rows("2026-05-25", 3.0), root)
    got = files.read_runs(spark, root)
    assert {str(r["run_date"]): r["p50"] for r in got.collect()} == {"2026-05-20": 1.0, "2026-05-25": 3.0}
    assert {str(r["run_date"]) for r in runs.latest_runs(got, 1).collect()} == {"2026-05-25"}
    meta = tmp_path / "meta"
    meta.mkdir()
    (meta / "a.json").write_text(json.dumps({"run_date": "2026-05-20", "model": "m", "horizon_days": 28}))
    (meta / "b.json").write_text("{broken")
    (meta / "c.json").write_text(json.dumps({"run_date": "2020-01-01", "initial_forecast": True}))
    m = files.read_metadata(spark, str(meta), got).collect()
    assert [(r["run_date"], r["initial_forecast"]) for r in m] == [("2026-05-20", False)]


def test_padding_and_gaps(spark):
    d = spark.createDataFrame([("s", dt.date(2024, 1, 1), 1.0, 4.0), ("s", dt.date(2024, 1, 4), 2.0, 5.0)], "series_id string, date date, demand double, floortables double")
    assert sorted(r["date"].day for r in gaps(d).collect()) == [2, 3]
    p = pad_future(d, 2).where("demand is null").orderBy("date").collect()
    assert [(r["date"].day, r["floortables"]) for r in p] == [(5, 5.0), (6, 5.0)]


def test_stream_of_events(spark, tmp_path):
    e = spark.range(400).select(F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, cast(id as int) * 5)")).alias("ts"), F.lit(1).cast("bigint").alias("user_id"), F.lit("x").alias("event_type"), F.lit(2.0).alias("value"), F.lit("{}").alias("props"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = series.keep_table(series.windowed(series.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("n <> 12 or demand <> 24").count() == 0 and got.count() >= 30
