"""The learner queries read the whole table and run the whole job."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from horizonspark.operators import blend as B
from horizonspark.operators import learners as L
from horizonspark.plans import learned
from horizonspark.plans.matrix import feature_names
from horizonspark.sources import tables

SF = "/root/testdata/sf0.001"


def test_all_orders_are_read(spark):
    orders = tables.read(spark, SF, "orders")
    days = orders.select(F.col("o_orderpriority").alias("s"), F.to_date("o_orderdate").alias("d")).distinct()
    assert learned.matrix(spark, SF).count() == learned._wide(spark, SF).count() == 28 * days.count()
    last = {r["s"]: r["d"] for r in days.groupBy("s").agg(F.date_add(F.max("d"), tables.SHIFT).alias("d")).collect()}
    out = learned.ridge_loo_blend(spark, SF).groupBy("series_id").agg(F.max("target_date").alias("a"), F.min("target_date").alias("b")).collect()
    assert {r["series_id"]: r["a"] for r in out} == last and all((r["a"] - r["b"]).days < 28 for r in out)
    blocks = learned.matrix(spark, SF).where("mainland_is_workday is null").count()
    assert blocks == 0


def test_learners_are_the_whole_ones(monkeypatch):
    asked, rounds, trees = [], [], []
    monkeypatch.setattr(learned, "matrix", lambda *a: None)
    monkeypatch.setattr(L, "per_horizon", lambda m, features, to, learn: asked.append((features, learn)))
    monkeypatch.setattr(L, "boost", lambda x, y, w, tests, **par: rounds.append(par["rounds"]) or [np.ones(len(t)) for t in tests])
    monkeypatch.setattr(L, "forest", lambda x, y, w, xt, n, extra, depth=6, *a: trees.append((n, depth)) or np.ones(len(xt)))
    x = np.random.default_rng(1).random((60, len(feature_names())))
    args = x, x[:, 0] + 1, np.ones(60), np.arange(60) < 25, x[:5], np.ones(5, dtype=bool)
    want = {"booster_forecast": [500, 400, 400, 500, 400, 400, 400, 500, 300], "two_stage_forecast": [500, 300], "bagged_forecast": [400] * 15, "linear_zoo": []}
    for name, n in want.items():
        rounds.clear()
        getattr(learned, name)(None, None)
        features, learn = asked[-1]
        learn(*args)
        assert features == feature_names() and rounds == n
    assert trees == [(300, 12)] * 2


def test_weights_are_fitted_on_all_horizons(spark, monkeypatch):
    first = dt.date(2026, 1, 1)
    rows = []
    for h in range(1, 29):
        for k in range(40):
            good = [10.0 + k, 20.0 + 2 * k]
            rows.append(("s", first + dt.timedelta(days=k), h, 10.0 + k, *(good[i == (h % 7 == 0)] for i in (0, 1)), *[50.0] * 4))
    wide = spark.createDataFrame(rows, "series_id string, target_date date, horizon int, y double, " + ", ".join(f"{m} double" for m in B.MODELS))
    monkeypatch.setattr(learned, "_wide", lambda *a: wide)
    monkeypatch.setattr(learned, "_newest", lambda *a: spark.createDataFrame([("s", first + dt.timedelta(days=11))], "series_id string, train_to date"))
    got = learned.opt_weights_blend(spark, "").where("horizon = 1").orderBy("target_date").collect()
    assert [round(r["blend"] / (10 + k), 1) for k, r in enumerate(got)] in ([1.0] * 40, [2.0] * 40)
    best = wide.where("horizon = 1").orderBy("target_date").collect()
    right = [m for m in B.MODELS if all(r[m] == r["y"] for r in best)]
    assert [r["blend"] for r in got] == pytest.approx([r[right[0]] for r in best])


def test_nodes_that_cannot_split_keep_their_rows():
    x = np.arange(12.0)[:, None]
    b = L.Bins(x)
    levels = L.grow(b.of(x), b.n, x[:, 0], np.ones(12), np.arange(1), 6, 3, 0.0)
    at = L.leaf_of(levels, b.of(x))
    assert len(levels) == 6 and min(np.unique(at, return_counts=True)[1]) >= 3


def test_importances(spark):
    r = np.random.default_rng(3)
    rows = [("s", dt.date(2026, 1, 1) + dt.timedelta(days=k), h, float(a * 5), 1.0, float(a), float(b)) for h in (1, 2) for k, (a, b) in enumerate(r.random((80, 2)))]
    m = spark.createDataFrame(rows, "series_id string, target_date date, horizon int, y double, weight double, good double, noise double")
    got = {(x["feature"], x["horizon"]): x["importance"] for x in L.importances(m, ["good", "noise"], rounds=20, cols=1.0).collect()}
    assert set(got) == {(f, h) for f in ("good", "noise") for h in (1, 2)}
    assert all(got["good", h] > 5 * got["noise", h] >= 0 for h in (1, 2))


def test_intervals_are_merged_before_they_are_expanded(spark):
    import random

    from horizonspark.operators.ingest import intervals_to_days

    r = random.Random(2)
    rows = []
    for _ in range(300):
        a = dt.date(2024, 1, 1) + dt.timedelta(days=r.randrange(900))
        rows.append((a, a + dt.timedelta(days=r.choice([-1, 0, 1, 3, 200])), r.randrange(1, 6), r.choice([" a", "B", "", None])))
    want: dict = {}
    for a, b, s, n in rows:
        if s >= 3:
            for k in range((b - a).days + 1):
                want.setdefault(a + dt.timedelta(days=k), []).append(((n or "").strip().upper() or "UNNAMED", s))
    got = {x["date"]: (x["names"], x["highest_signal"]) for x in intervals_to_days(spark.createDataFrame(rows, "start date, end date, signal int, name string"), 2024, 3).collect()}
    assert got == {d: (",".join(sorted({n for n, _ in v})), max(s for _, s in v)) for d, v in want.items()}
