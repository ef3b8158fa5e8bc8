"""Error metrics, residual quantiles and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def error_metrics(rows: DataFrame, keys: list[str], y: str = "y", p: str = "pred") -> DataFrame:
    """wape, mape, rmse, bias and n over the rows where both values are known; null where there are none. A target of 0 has no mape term."""
    e, seen = F.col(p) - F.col(y), F.col(p).isNotNull() & F.col(y).isNotNull()
    known = rows.select(*keys, F.when(seen, e).alias("_e"), F.when(seen, F.col(y)).alias("_y"))
    aggs = [
        _ratio(F.sum(F.abs("_e")), F.sum(F.abs("_y"))).alias("wape"),
        F.avg(_ratio(F.abs("_e"), F.col("_y"))).alias("mape"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg("_e").alias("bias"),
        F.count("_e").alias("n"),
    ]
    return known.groupBy(*keys).agg(*aggs)


def guarded_mape(y: Column, p: Column) -> Column:
    """Mean of |y - p| / y over positive targets with a prediction."""
    return F.avg(F.when((y > 0) & p.isNotNull(), F.abs(y - p) / F.nullif(y, F.lit(0.0))))


def floor_mape(y: Column, p: Column) -> Column:
    """Mean of |y - p| / max(y, 1)."""
    return F.avg(F.when(y.isNotNull() & p.isNotNull(), F.abs(y - p) / F.greatest(y, F.lit(1.0))))


def coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    inside = F.when(F.col("y").isNotNull() & F.col("p10").isNotNull() & F.col("p90").isNotNull(), F.col("y").between(F.col("p10"), F.col("p90")).cast("int"))
    return rows.groupBy(*keys).agg(F.avg(inside).alias("coverage"), F.count(inside).alias("n"))


def residual_quantiles(rows: DataFrame, keys: list[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Exact interpolated quantiles of y - pred for each key."""
    r = F.col("y") - F.col("pred")
    return rows.groupBy(*keys).agg(F.percentile(r, low).alias("q_low"), F.percentile(r, high).alias("q_high"))


def intervals(rows: DataFrame, quantiles: DataFrame, keys: list[str], both_sides: bool = True) -> DataFrame:
    """p10, p50, p90 around pred, none below 0 and p10 <= p50 <= p90; with both_sides off only p90 is kept above p50.

    A key without quantiles, or a row without prediction, has null bounds.
    """
    p50 = F.when(F.col("pred").isNotNull(), F.greatest(F.lit(0.0), F.col("pred")))
    lo = F.greatest(F.lit(0.0), F.col("pred") + F.col("q_low"))
    hi = F.greatest(F.lit(0.0), F.col("pred") + F.col("q_high"))
    seen = F.col("pred").isNotNull() & F.col("q_low").isNotNull()
    joined = rows.join(quantiles, keys, "left")
    return joined.select(*rows.columns, F.when(seen, F.least(lo, p50) if both_sides else lo).alias("p10"), p50.alias("p50"), F.when(seen, F.greatest(hi, p50)).alias("p90"))
