"""History features against hand-computed values and naive formulas."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from horizonspark.operators import history as H

D0 = dt.date(2024, 1, 1)


def day(k):
    return D0 + dt.timedelta(days=k - 1)


def series(spark, values):
    return spark.createDataFrame([("s", day(k), float(v), 2.0) for k, v in values.items()], "series_id string, date date, demand double, floortables double")


def features(spark, values, target, horizons):
    d = series(spark, values)
    m = spark.createDataFrame([("s", target, h, H.HORIZONS * 0.0, 0.0) for h in horizons], "series_id string, target_date date, horizon int, floortables double, y double").withColumn("base_date", F.date_sub("target_date", F.col("horizon") + 1))
    m = H.with_base(H.with_past(m, H.offset_map(d)), H.base_features(d, H.rolling_columns() | H.ewma_columns()))
    more = H.lag_columns() | H.lag_anchor_columns() | H.same_dow_columns()
    return {r["horizon"]: r.asDict() for r in m.select("*", *[c.alias(n) for n, c in more.items()]).drop("past").collect()}


def test_golden_values(spark):
    values = {k: 10 * k for k in range(1, 41) if k != 5}
    f = features(spark, values, day(20), [1, 3, 13])
    one = f[1]
    assert (one["lag_2"], one["lag_4"], one["lag_7"], one["lag_14"], one["lag_anchor_7"], one["lag_anchor_14"]) == (180, 160, 130, 60, 130, 60)
    assert (one["rolling_mean_3"], one["rolling_max_3"], one["rolling_min_3"]) == (170, 180, 160) and one["rolling_std_3"] == pytest.approx(8.164966)
    assert (one["rolling_mean_7"], one["rolling_std_7"]) == (150, 20) and one["ewma_3"] == pytest.approx(170.176125) and one["same_dow_mean_4w"] == 95
    assert f[3]["lag_2"] is None and f[3]["lag_4"] == 160 and f[3]["ewma_3"] == pytest.approx(150.176125)
    t = f[13]
    assert (t["lag_7"], t["lag_14"], t["lag_anchor_7"]) == (None, 60, 60)
    assert (t["rolling_mean_3"], t["rolling_std_3"]) == (50, 10) and (t["rolling_mean_7"], t["rolling_max_7"], t["rolling_min_7"]) == (32, 60, 10)
    assert t["rolling_std_7"] == pytest.approx(17.204651) and t["ewma_3"] == pytest.approx(51.276596)


def test_nothing_newer_than_the_base_date_is_read(spark):
    r = random.Random(4)
    values = {k: r.randrange(1, 100) for k in range(1, 80) if r.random() > 0.15}
    target = 75
    before = features(spark, values, day(target), [1, 6, 20])
    for h, row in before.items():
        changed = {k: (v if k <= target - (h + 1) else v + 1000) for k, v in values.items()}
        after = features(spark, changed, day(target), [h])[h]
        assert {k: v for k, v in after.items()} == {k: v for k, v in row.items()}


def test_gap_is_the_same_as_null(spark):
    values = {k: k * k % 37 for k in range(1, 60)}
    gap = {k: v for k, v in values.items() if k % 7}
    rows = [("s", day(k), float(v) if k % 7 else None, 2.0) for k, v in values.items()]
    d = spark.createDataFrame(rows, "series_id string, date date, demand double, floortables double")
    a = H.base_features(d, H.rolling_columns() | H.ewma_columns())
    b = H.base_features(series(spark, gap), H.rolling_columns() | H.ewma_columns())
    both = a.join(b, ["series_id", "base_date"], "left_semi")
    assert sorted(map(str, both.collect())) == sorted(map(str, b.join(a, ["series_id", "base_date"], "left_semi").collect()))


def test_naive_ewma_and_slope(spark):
    r = random.Random(9)
    values = {k: r.random() * 50 for k in range(1, 120) if r.random() > 0.2}
    rows = H.base_features(series(spark, values), H.ewma_columns() | H.trend_columns()).collect()
    for row in rows:
        k = (row["base_date"] - D0).days + 1
        seen = [(values[k - j], (1 - 2 / 8) ** j) for j in range(21) if k - j in values]
        want = sum(v * w for v, w in seen) / sum(w for _, w in seen) if seen else None
        assert (row["ewma_7"] is None and want is None) or row["ewma_7"] == pytest.approx(want)
        pts = [(k - j, values[k - j]) for j in range(90) if k - j in values]
        if len(pts) >= 30:
            mx, my = sum(x for x, _ in pts) / len(pts), sum(y for _, y in pts) / len(pts)
            slope = sum((x - mx) * (y - my) for x, y in pts) / sum((x - mx) ** 2 for x, _ in pts)
            assert row["trend_slope_90d"] == pytest.approx(slope)
        else:
            assert row["trend_slope_90d"] is None


def test_weights(spark):
    m = spark.createDataFrame([("s", day(481), 1, 0), ("s", day(241), 1, 0), ("s", day(241), 1, 1), ("s", day(1), 1, 0)], "series_id string, target_date date, horizon int, is_X int")
    got = sorted(r["weight"] for r in H.sample_weights(m, ["is_X"]).collect())
    assert got == pytest.approx([0.25, 0.5, 1.0, 1.5]) and not any(math.isnan(x) for x in got)
