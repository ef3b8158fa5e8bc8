import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from horizonspark.operators import blend as B
from horizonspark.operators import hourly as H
from horizonspark.operators import learners as L
from horizonspark.operators import metrics as M
from horizonspark.operators.ingest import intervals_to_days


def test_metrics(spark):
    rows = [("a", 100.0, 110.0), ("a", 200.0, 180.0), ("a", None, 5.0), ("a", 7.0, None), ("b", None, 1.0)]
    got = {r["k"]: r for r in M.error_metrics(spark.createDataFrame(rows, "k string, y double, pred double"), ["k"]).collect()}
    a = got["a"]
    assert (a["wape"], a["mape"], a["bias"], a["n"]) == (pytest.approx(0.1), pytest.approx(0.1), -5, 2) and a["rmse"] == pytest.approx(15.811388)
    assert got["b"]["wape"] is None and got["b"]["n"] == 0


def test_quantiles_and_bands(spark):
    r = spark.createDataFrame([(1, 100.0 + e, 100.0) for e in (-30.0, -10.0, 0.0, 5.0, 12.0, 40.0)], "h int, y double, pred double")
    q = M.residual_quantiles(r, ["h"])
    assert tuple(q.first())[1:] == (pytest.approx(-20), pytest.approx(26))
    rows = spark.createDataFrame([(1, 15.0), (2, 15.0), (1, None)], "h int, pred double")
    got = {(x["h"], x["pred"]): (x["p10"], x["p50"], x["p90"]) for x in M.intervals(rows, q, ["h"]).collect()}
    assert got[1, 15.0] == (0, 15, pytest.approx(41)) and got[2, 15.0] == (None, 15, None) and got[1, None] == (None, None, None)
    up = spark.createDataFrame([(1, 3.0, 9.0)], "h int, q_low double, q_high double")
    assert M.intervals(rows.where("h = 1 and pred > 0"), up, ["h"]).first()["p10"] == 15
    assert M.intervals(rows.where("h = 1 and pred > 0"), up, ["h"], False).first()["p10"] == 18


def test_selection_and_nulls(spark):
    d = dt.date(2026, 1, 5)
    rows = [("s", d + dt.timedelta(7 * i), 1, 0, 10.0, m, o, p) for i in range(3) for o, (m, p) in enumerate([("a", 11.0), ("b", 11.0), ("c", 10.5)])]
    long = spark.createDataFrame(rows, "series_id string, target_date date, horizon int, dow int, y double, model string, pool_ord int, pred double")
    cell = ["series_id", "dow", "horizon"]
    table = B.selection_table(B.model_scores(long, cell), cell)
    assert table.first()["models"] == ["c", "a"]
    assert {r["blend"] for r in B.selection_blend(long, table, cell).collect()} == {10.75}
    holes = long.withColumn("pred", F.when(F.col("model") != "a", F.col("pred")))
    assert {r["blend"] for r in B.selection_blend(holes, table, cell).collect()} == {None}
    assert {r["blend"] for r in B.equal_blend(holes).collect()} == {10.75}
    other = B.selection_blend(long.withColumn("dow", F.lit(3)), table, cell)
    assert {round(r["blend"], 6) for r in other.collect()} == {10.833333}


def test_anchor(spark):
    rows = spark.createDataFrame([(100.0, 120.0), (100.0, None)], "blend double, lag_365 double")
    go = lambda a: sorted(r["blend"] for r in B.anchor_apply(rows, F.lit(True), F.lit(a), F.lit(1.1)).collect())
    assert go(0.25) == [100, pytest.approx(108)] and go(0.0) == [100, 100]


def test_scale_is_the_best_factor(spark):
    rng = np.random.default_rng(1)
    y, p = rng.uniform(5, 20, 31), rng.uniform(5, 20, 31)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(y, p, strict=True)], "k string, y double, blend double")
    k = B.dow_scale_median(df, ["k"]).first()["scale"]
    cost = lambda s: np.mean(np.abs(1 - s * p / y))
    assert cost(k) <= min(cost(s) for s in np.linspace(0.2, 3, 2000)) + 1e-6


def test_hourly_decisions(spark):
    rows = [("A", 0, "2024-01-01", "weekday", 0.02), ("A", 0, "2025-01-01", "weekday", 0.05), ("B", 0, "2024-01-01", "friday", 0.05), ("B", 0, "2025-01-01", "friday", 0.11), ("C", 0, "2024-01-01", "friday", 0.12), ("C", 0, "2025-01-01", "sunday", 0.12)]
    rows += [("D", 0, "2024-01-01", "sunday", 0.04), ("D", 0, "2025-01-01", "friday", 0.04), ("E", 0, "2024-01-01", "sunday", 0.04)]
    df = spark.createDataFrame([(h, o, dt.date.fromisoformat(d), b, t) for h, o, d, b, t in rows], "holiday string, day_offset int, date date, best_bucket string, best_tvd double")
    got = {r["holiday"]: (r["decision"], r["reason"], r["modal_bucket"]) for r in H.decisions(df).collect()}
    assert got == {
        "A": ("USE_WEEKDAY", "consistent_close_match", "weekday"),
        "B": ("USE_FRIDAY", "borderline_flag_review", "friday"),
        "C": ("USE_HOLIDAY_PROFILE", "strong_difference", "friday"),
        "D": ("USE_HOLIDAY_PROFILE", "inconsistent_match", "sunday"),
    }


def test_profiles_weights(spark):
    days = [dt.date(2024 + i, 1, 1) for i in range(3)]
    occ = spark.createDataFrame([("A", 0, d) for d in days], "holiday string, day_offset int, date date")
    shares = spark.createDataFrame([(d, h, (1.0 if h == i else 0.0)) for i, d in enumerate(days) for h in range(24)], "date date, hour int, share double")
    got = {r["hour"]: r["share"] for r in H.profiles(occ, shares).collect()}
    assert [got[i] for i in range(3)] == pytest.approx([0.266667, 0.333333, 0.4], abs=1e-6)


def test_intervals(spark):
    rows = [(8, "yagi ", "2024-09-05", "2024-09-06"), (9, "YAGI", "2024-09-06", "2024-09-06"), (8, "", "2024-09-06", "2024-09-07"), (3, "LOW", "2024-09-06", "2024-09-07")]
    df = spark.createDataFrame([(s, n, dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for s, n, a, b in rows], "signal int, name string, start date, end date")
    got = {r["date"].day: (r["names"], r["highest_signal"]) for r in intervals_to_days(df, 2024, 8).collect()}
    assert got == {5: ("YAGI", 8), 6: ("UNNAMED,YAGI", 9), 7: ("UNNAMED", 8)}


def test_learners():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    x[rng.random(x.shape) < 0.1] = np.nan
    y = 10 + 3 * np.nan_to_num(x[:, 0]) + 2 * (np.nan_to_num(x[:, 1]) > 0) + rng.normal(size=400) * 0.2
    w = np.ones(400)
    for name in ("lgbm_l2", "cat"):
        par = L.PARAMS[name] | {"rounds": 60, "rate": 0.15}
        p = L.boost(x[:300], y[:300], w[:300], [x[300:]], **par)[0]
        assert np.mean((p - y[300:]) ** 2) < 0.35 * np.var(y[300:])
    z, zt = L._filled(x[:300], x[300:])
    assert np.mean((L.ridge(z, y[:300], w[:300], zt) - y[300:]) ** 2) < 0.3 * np.var(y[300:])
    assert np.mean((L.forest(z, y[:300], w[:300], zt, 20, False) - y[300:]) ** 2) < 0.5 * np.var(y[300:])
    a = rng.uniform(1, 9, (200, 4))
    b = a @ np.array([0.7, 0.0, 0.3, 0.0])
    assert L.simplex_weights(a, b) == pytest.approx([0.7, 0, 0.3, 0], abs=0.01)
    assert L.nonnegative_least_squares(a, b) == pytest.approx([0.7, 0, 0.3, 0], abs=1e-6)


def test_the_best_strategy_does_not_look_at_the_target(spark):
    board = spark.createDataFrame([("oracle_top3", 0.01), ("b", 0.02), ("a", 0.02), ("c", None)], "strategy string, mape double")
    assert {r["strategy"]: r["is_best"] for r in B.marked_best(board).collect()} == {"oracle_top3": False, "a": True, "b": False, "c": False}
    assert B.marked_best(board.limit(0)).count() == 0
