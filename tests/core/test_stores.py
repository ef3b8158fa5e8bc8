"""Stored runs and results, fingerprints, and the refresh of a matrix."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from horizonspark.operators import refresh
from horizonspark.operators.refresh import changed_days, history_matrix, reached_targets, refresh_matrix
from horizonspark.sources.store import ResultStore, RunStore, fingerprint

D0 = dt.date(2021, 1, 1)


def runs(spark, n, factor=1.0, only=None):
    rows = [(D0 + dt.timedelta(days=7 * r), D0 + dt.timedelta(days=7 * r + k), factor * (r + k)) for r in range(n) if only is None or r == only for k in range(1, 5)]
    return spark.createDataFrame(rows, "run_date date, date date, p50 double")


def test_latest_runs_read_their_folders_only(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    store.write(runs(spark, 12))
    store.write(runs(spark, 12, factor=10.0, only=9))
    got = store.latest(6)
    assert sorted(map(tuple, got.select("run_date", "date", "p50").collect())) == sorted(
        (D0 + dt.timedelta(days=7 * r), D0 + dt.timedelta(days=7 * r + k), float((10 if r == 9 else 1) * (r + k))) for r in range(6, 12) for k in range(1, 5)
    )
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"number of partitions read[^\d]*(\d+)", got._jdf.queryExecution().toString())
    assert not scans or min(map(int, scans)) <= 6
    assert store.read().count() == 48


def test_fingerprints(spark):
    rows = [("a", 1, "x", 0.5), ("a", 2, None, None), ("b", 1, "1:x", 0.5), ("b", 1, "1:x", 0.5), ("c", 1, "", 0.1), ("d", 1, None, 0.1)]
    df = spark.createDataFrame(rows, "k string, n int, s string, v double")
    of = lambda d: {r["k"]: (r["n_rows"], r["fingerprint"]) for r in fingerprint(d, ["k"]).collect()}
    first = of(df)
    assert of(df.repartition(5).orderBy(F.rand(3))) == first and len({f for _, f in first.values()}) == 4
    changed = of(df.withColumn("s", F.when(F.col("k") == "a", F.lit("y")).otherwise(F.col("s"))))
    assert {k for k in first if first[k] != changed[k]} == {"a"}
    assert of(df.dropDuplicates())["b"] != first["b"]
    assert fingerprint(df.limit(0)).first()["n_rows"] == 0


def test_results_are_kept_until_an_input_changes(spark, tmp_path):
    store, made = ResultStore(spark, str(tmp_path / "results")), []
    daily = spark.range(50).select(F.col("id").alias("date"), (F.col("id") * 2).alias("demand"))

    def ask(df, **parameters):
        def make():
            made.append(parameters)
            return df.select((F.col("demand") * parameters["scale"]).alias("p"))

        out, found = store.reuse(make, {"daily": df}, **parameters)
        return out.agg(F.sum("p")).first()[0], found

    assert ask(daily, scale=1) == (2450, False) and ask(daily.repartition(7), scale=1) == (2450, True)
    assert ask(daily, scale=3) == (7350, False)
    touched = daily.withColumn("demand", F.when(F.col("date") == 7, 0).otherwise(F.col("demand")))
    assert ask(touched, scale=1) == (2436, False) and ask(daily, scale=1) == (2450, True)
    assert made == [{"scale": 1}, {"scale": 3}, {"scale": 1}]


def series(spark, days, seed=1):
    r = random.Random(seed)
    rows = [(s, D0 + dt.timedelta(days=k), float(r.randrange(1, 90)), 5.0) for s in ("a", "b") for k in range(days) if r.random() > 0.1]
    return spark.createDataFrame(rows, "series_id string, date date, demand double, floortables double").cache()


def rounded(df):
    return sorted(map(repr, df.select(*[F.round(c, 8).alias(c) if t == "double" else c for c, t in df.dtypes]).collect()))


@pytest.mark.parametrize("change", ["append", "edit", "remove"])
def test_refresh_is_the_full_build(spark, tmp_path, change):
    whole = series(spark, 460)
    at = F.lit(D0 + dt.timedelta(days=452 if change == "append" else 40)).cast("date")
    edited = whole.withColumn("demand", F.when((F.col("date") == at) & (F.col("series_id") == "a"), 7777.0).otherwise(F.col("demand")))
    old, new = {"append": (whole.where(F.col("date") < at), whole), "edit": (edited, whole), "remove": (whole, whole.where(F.col("date") != at))}[change]
    history_matrix(old).write.parquet(str(tmp_path / "old"))
    before = spark.read.parquet(str(tmp_path / "old"))
    assert rounded(refresh_matrix(before, old, new)) == rounded(history_matrix(new))
    # rows out of reach are taken over, not made again: a mark on them stays
    reached = reached_targets(changed_days(old, new))
    marked = before.join(reached, refresh.DAY, "left_anti").withColumn("y", F.lit(-5.0))
    kept = refresh_matrix(marked.unionByName(before.join(reached, refresh.DAY, "left_semi")), old, new)
    assert kept.where("y = -5").count() == marked.count() > 0 and kept.where("y <> -5").join(reached, refresh.DAY, "left_anti").count() == 0


def test_every_read_day_is_in_reach(spark):
    """Changing one day changes no row outside the reach that is derived from the offsets."""
    new = series(spark, 900, seed=4)
    at = D0 + dt.timedelta(days=60)
    old = new.withColumn("demand", F.when(F.col("date") == F.lit(at), F.col("demand") + 500).otherwise(F.col("demand")))
    a, b = (history_matrix(d) for d in (old, new))
    moved = a.exceptAll(b).select(*refresh.DAY).distinct()
    reached = reached_targets(changed_days(old, new))
    assert moved.join(reached, refresh.DAY, "left_anti").count() == 0
    assert moved.count() > 0.6 * reached.join(new.select("series_id", F.col("date").alias("target_date")), refresh.DAY).count()
