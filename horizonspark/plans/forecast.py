"""The forecast from end to end: guard, pad, matrix, learners, blend, anchor, intervals."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonspark import calendars
from horizonspark.operators import blend as B
from horizonspark.operators import calendar as cal
from horizonspark.operators import history as hist
from horizonspark.operators import learners as L
from horizonspark.operators import metrics as M
from horizonspark.operators.runs import natural_schedule
from horizonspark.operators.series import pad_future
from horizonspark.plans.matrix import feature_matrix, feature_names, holiday_mask_columns

VALIDATION_DAYS = 180


def prepared(spark: SparkSession, daily: DataFrame, workdays: DataFrame, run_date: dt.date) -> DataFrame:
    """The weighted matrix of all days to run_date and the 28 after it; later rows are left out, a series that ends earlier is refused."""
    ends = daily.agg(F.max("date").alias("d")).first()["d"]
    if ends is None or ends < run_date:
        raise ValueError(f"the data end at {ends}, before the run date {run_date}")
    known = daily.where(F.col("date") <= F.lit(run_date))
    m = feature_matrix(spark, pad_future(known), workdays)
    mask = holiday_mask_columns(m.columns)
    return hist.sample_weights(m, mask).withColumn("is_hol", cal.flag(sum((F.col(c) for c in mask), F.lit(0)) > 0))


def _fit(matrix: DataFrame, train_to: dt.date, scale: float, models: list[str]) -> DataFrame:
    def learn(x, y, w, hol, xt, hol_t):
        if models == ["lgbm_l2"]:
            par = L.PARAMS["lgbm_l2"] | {"rounds": max(1, int(L.PARAMS["lgbm_l2"]["rounds"] * scale)), "rate": min(0.3, L.PARAMS["lgbm_l2"]["rate"] / scale)}
            p, own = L.boost(x, y, w, [xt, x], **par)
            return {"lgbm_l2": np.maximum(0.0, p)}
        return {k: v for k, v in L.fit_pool(x, y, w, hol, xt, hol_t, scale).items() if k in models}

    return L.per_horizon(matrix, feature_names(), train_to.isoformat(), learn)


def _residuals(matrix: DataFrame, train_to: dt.date, scale: float) -> DataFrame:
    """In-sample quantiles of the first model's errors, for each series and horizon."""

    def learn(x, y, w, hol, xt, hol_t):
        par = L.PARAMS["lgbm_l2"] | {"rounds": max(1, int(L.PARAMS["lgbm_l2"]["rounds"] * scale)), "rate": min(0.3, L.PARAMS["lgbm_l2"]["rate"] / scale)}
        r = y - L.boost(x, y, w, [x], **par)[0]
        return {"q_low": np.full(len(xt), np.quantile(r, 0.1)), "q_high": np.full(len(xt), np.quantile(r, 0.9))}

    rows = L.per_horizon(matrix, feature_names(), train_to.isoformat(), learn)
    return rows.groupBy("series_id", "horizon").pivot("model", ["q_low", "q_high"]).agg(F.first("pred"))


def make_forecast(spark: SparkSession, daily: DataFrame, workdays: DataFrame, run_date: dt.date, full: bool = False, blend: str = "equal", scale: float = 1.0) -> DataFrame:
    """series_id, target_date, horizon, p10, p50, p90 of the 28 days after run_date.

    Default: one model. full: six models, blended equally, or (blend="selection") by the two best of each weekday and
    horizon in the last 180 days, forecast by models trained before them, with last year's values mixed in on fixed-date
    holidays as calibrated on the same days. scale shortens the models.
    """
    matrix = prepared(spark, daily, workdays, run_date)
    schedule = natural_schedule(matrix.where(F.col("target_date") > F.lit(run_date)).select("series_id", "target_date"))
    models = B.MODELS if full else ["lgbm_l2"]
    facts = matrix.select(*hist.KEY, F.col("y"), F.col("lag_365"), F.weekday("target_date").alias("dow"))
    ords = F.create_map(*[x for i, m in enumerate(B.MODELS) for x in (F.lit(m), F.lit(i))])
    long = _fit(matrix, run_date, scale, models).join(schedule, hist.KEY).join(facts, hist.KEY).withColumn("pool_ord", ords[F.col("model")])
    ids = [*hist.KEY, "lag_365"]
    if full and blend == "selection":
        cut = run_date - dt.timedelta(days=VALIDATION_DAYS)
        past = _fit(matrix.where(F.col("target_date") <= F.lit(run_date)), cut, scale, models).join(facts, hist.KEY).withColumn("pool_ord", ords[F.col("model")])
        cell = ["series_id", "dow", "horizon"]
        table = B.selection_table(B.model_scores(past, cell), cell)
        rows = B.selection_blend(long, table, cell, ids)
        tried = B.selection_blend(past, table, cell, [*hist.KEY, "y", "lag_365"])
        anchors = calendars.holiday_anchors(spark)
        days = matrix.select("target_date").distinct()
        masks = [cal.influence_mask(days, anchors, p).where("in_influence").select("target_date", F.lit(p).alias("post")) for p in B.POSTS]
        influence = masks[0].unionByName(masks[1]).unionByName(masks[2]).unionByName(masks[3])
        best = B.anchor_calibration(tried, B.yoy_growth(daily, cut.isoformat()), influence).select("series_id", "window", "post", "alpha")
        growth = B.yoy_growth(daily, (run_date + dt.timedelta(days=1)).isoformat()).join(best, ["series_id", "window"])
        marked = rows.join(F.broadcast(growth), "series_id", "left").join(F.broadcast(influence.withColumn("hit", F.lit(True))), ["target_date", "post"], "left")
        out = B.anchor_apply(marked, F.coalesce("hit", F.lit(False)), F.coalesce("alpha", F.lit(0.0)), F.col("growth")).select(*hist.KEY, F.col("blend").alias("pred"))
    else:
        out = B.equal_blend(long, ids).select(*hist.KEY, F.col("blend").alias("pred"))
    bands = M.intervals(out, _residuals(matrix, run_date, scale), ["series_id", "horizon"])
    return bands.select(*hist.KEY, "p10", "p50", "p90")
