"""As-of joins, overlaps and islands against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from horizonspark.operators.asof import asof_join
from horizonspark.operators.intervals import first_match, interval_join
from horizonspark.operators.islands import islands


def asof_rows(seed, n=120, keys=4):
    r = random.Random(seed)
    k = lambda: r.choice([*range(keys), None])
    left = [(k(), r.choice([None, *range(40)]), i) for i in range(n)]
    right = [(k(), r.choice([None, *range(40)]), r.randrange(3), f"r{i}") for i in range(n // 2)]
    return [*left, left[0], left[0]], [*right, right[1]]


@pytest.mark.parametrize("limit", [10**6, 20, 0])
@pytest.mark.parametrize("keyed", [True, False])
def test_asof_join(spark, limit, keyed):
    left, right = asof_rows(limit + keyed)
    a = spark.createDataFrame(left, "k int, t int, own int")
    b = spark.createDataFrame(right, "key int, at int, o int, v string").repartition(3)
    got = asof_join(a, b, {"k": "key"} if keyed else {}, ("t", "at"), ["at", "v"], ["o", "v"], "last", "next", rows_per_key=limit)
    assert got.columns == ["k", "t", "own", "last", "next"]
    want = []
    for k, t, own in left:
        near = [x for x in right if t is not None and x[1] is not None and (not keyed or k is not None and x[0] == k)]
        back = max((x for x in near if x[1] <= t), key=lambda x: x[1:], default=None)
        ahead = min((x for x in near if x[1] >= t), key=lambda x: x[1:], default=None)
        want.append((k, t, own, back and (back[1], back[3]), ahead and (ahead[1], ahead[3])))
    assert sorted(((r["k"], r["t"], r["own"], r["last"] and tuple(r["last"]), r["next"] and tuple(r["next"])) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_asof_edges(spark):
    a = spark.createDataFrame([(1, 5)], "k int, t int")
    nothing = spark.createDataFrame([], "k int, t int, v int")
    assert [tuple(r) for r in asof_join(a, nothing, {"k": "k"}, ("t", "t"), ["v"]).collect()] == [(1, 5, None)]
    assert asof_join(a.limit(0), nothing, {"k": "k"}, ("t", "t"), ["v"], forward="next").count() == 0


def spans(seed, n, points):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randrange(-300, 3000)
        b = a if points else a + r.choice([0, 1, 3, r.randrange(60), r.randrange(2000), 10**7, -4])
        out.append((r.choice([0, 1, 2, None]), None if i == 3 else a, b, i))
    return out


@pytest.mark.parametrize("points", [True, False])
@pytest.mark.parametrize("keyed", [True, False])
def test_interval_join(spark, points, keyed):
    left, right = spans(1, 80, points), spans(2, 90, False)
    a = spark.createDataFrame(left, "k int, a bigint, b bigint, i int")
    b = spark.createDataFrame(right, "k int, a bigint, b bigint, i int")
    got = interval_join(a, b, {"k": "k"} if keyed else {}, ("a", "b"), ("a", "b"))
    ok = lambda x: None not in x[1:3] and x[1] <= x[2] and (not keyed or x[0] is not None)
    want = sorted((x[3], y[3]) for x in left for y in right if ok(x) and ok(y) and (not keyed or x[0] == y[0]) and x[1] <= y[2] and y[1] <= x[2])
    assert sorted((r["l"]["i"], r["r"]["i"]) for r in got.select("l", "r").collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    best = first_match(got, ["i"], ["b", "i"], {"i": "first"})
    assert {(r["i"], r["n_matches"], r["first"]) for r in best.collect()} == {(i, sum(x == i for x, _ in want), min((right[y][2], y) for x, y in want if x == i)[1]) for i in {x for x, _ in want}}


def test_no_spans(spark):
    a = spark.createDataFrame([], "a bigint, b bigint")
    b = spark.range(3).select(F.col("id").alias("a"), F.col("id").alias("b"))
    assert interval_join(a, b, {}, ("a", "b"), ("a", "b")).count() == 0 and interval_join(b, a, {}, ("a", "b"), ("a", "b")).count() == 0


def test_interval_join_looks_where_the_other_side_is(spark):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    points = spark.range(1000, 1100).select(F.col("id").alias("a"), F.col("id").alias("b"))
    rows = [(1050 - 2**k, 1050 + 2**k) for k in range(60)] + [(-(2**k), 999) for k in range(60)]
    wide = spark.createDataFrame(rows, "a bigint, b bigint").withColumn("b", F.udf(count, "bigint").asNondeterministic()("b"))
    want = sum(a <= t <= b for a, b in rows for t in range(1000, 1100))
    got = interval_join(points, wide, {}, ("a", "b"), ("a", "b"))
    assert got.count() == want
    assert made.value == len(rows), "the right side is made once"
    levels = re.search(r"filter\(\[([\d,]+)\]", got._jdf.queryExecution().executedPlan().toString())[1].split(",")
    assert len(levels) <= 2, "a point looks at levels of the lengths that lie among the points"
    assert interval_join(wide, points, {}, ("a", "b"), ("a", "b")).count() == want


@pytest.mark.parametrize("limit", [10**6, 30, 0])
@pytest.mark.parametrize("keyed", [True, False])
def test_islands(spark, limit, keyed):
    r = random.Random(limit)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(0, 150)])) for _ in range(130)]
    rows += [("a", k) for k in range(200, 290)] + [("b", 250)] * 40
    keys = ["k"] if keyed else []
    got = islands(spark.createDataFrame(rows, "k string, at bigint").repartition(3), keys, "at", 2, rows_per_key=limit).collect()
    want = []
    for key in {x[0] for x in rows} if keyed else {"all"}:
        places = sorted(at for k, at in rows if at is not None and (not keyed or k == key))
        start = 0
        for i in range(1, len(places) + 1):
            if i == len(places) or places[i] - places[i - 1] > 2:
                want.append((*([key] if keyed else []), places[start], places[i - 1], i - start))
                start = i
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert islands(spark.createDataFrame([], "k string, at bigint"), keys, "at").count() == 0


@pytest.mark.parametrize("few", [5, 10**6])
@pytest.mark.parametrize("keyed", [True, False])
def test_exact_quantiles(spark, tmp_path, monkeypatch, few, keyed):
    import numpy as np

    from horizonspark.operators import quantiles

    monkeypatch.setattr(quantiles, "BINS", 8)
    r = random.Random(few)
    rows = [(k, r.choice([None, float("nan"), 1.5, r.gauss(0, 1), r.gauss(0, 1) * 10**9, -(10**300) * r.random()])) for k in ("a", None, "b") for _ in range(150)] + [("c", None), ("d", 2.0)] + [("e", 7.0)] * 60
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"] if keyed else [], "v", ps, str(tmp_path), few)
    want = {}
    for key in {x[0] for x in rows} if keyed else {"all"}:
        vs = [v for k, v in rows if v is not None and v == v and (not keyed or k == key)]
        for p in ps if vs else []:
            want[(key, p)] = (float(np.quantile(vs, p)), len(vs))
    assert len(want) == got.count()
    for x in got.collect():
        q, n = want[(x["k"] if keyed else "all", x["probability"])]
        assert x["n"] == n and x["quantile"] == pytest.approx(q, rel=1e-9, abs=1e-9)


def test_rounding_is_pythons(spark):
    from horizonspark.functions import round_exact

    r = random.Random(3)
    ties = [0.5 / 10**4 * k for k in range(1, 60, 2)] + [k + 0.00005 for k in range(40)] + [k / 2**5 for k in range(100)] + [2.675, 1.00015, 0.00025, -0.00005, -1.00005, 1e9 + 0.00005, 0.0]
    values = ties + [r.uniform(0, 5000) for _ in range(2000)] + [round(r.uniform(0, 9), 4) + 0.00005 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for digits in (2, 4):
        for x in df.select("x", round_exact(F.col("x"), digits).alias("y")).collect():
            assert x["y"] == (None if x["x"] is None else round(x["x"], digits))


def test_sql_functions_are_inlined(spark):
    from horizonspark.functions.sql import FUNCTIONS, register

    register(spark)
    df = spark.createDataFrame([(4.0, 5.0), (0.0, 1.0), (None, 2.0), (-2.0, None)], "y double, p double")
    out = spark.sql("SELECT ape(y, p) a, ape_guarded(y, p) g, ape_floor(y, p) f, clip(p, 0, 1.5) c, at_least(y, 1) l, share_of(p, y) s, total_variation(array(y, p), array(p, y)) t FROM {df}", df=df)
    assert [tuple(r) for r in out.collect()] == [(0.25, 0.25, 0.25, 1.5, 4.0, 1.25, 1.0), (None, None, 1.0, 1.0, 1.0, None, 1.0), (None, None, None, 1.5, None, None, None), (None, None, None, None, 1.0, None, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and not any(f.split("(")[0] in plan for f in FUNCTIONS)
