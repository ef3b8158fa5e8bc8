"""The registered queries run, and agree with their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
CORE = [q for q in entry.queries() if not q.startswith(("op", "pipeline")) or q.startswith("opt_")]
QUICK = ["daily_series", "lag_features", "rolling_features", "holiday_flags", "workday_blocks", "selection_blend", "forecast_intervals", "anchor_calibration", "interval_to_daily", "tracking_join"]


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["series_id", "target_date", "horizon", "p10", "p50", "p90"] and rows.count() > 0
    assert rows.where("p10 > p50 or p50 > p90 or p10 < 0").count() == 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(CORE) > 80


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(repr(tuple(r[i] for i in sorted(range(len(names)), key=names.__getitem__))) for r in result.fetchall())
    df = entry.queries()[name](spark, SF)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    assert sorted(names) == sorted(df.columns) and got == want
