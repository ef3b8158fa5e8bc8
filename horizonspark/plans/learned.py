"""Queries of the learners; SQL cannot express them. They read all of orders; the newest 28 days are predicted.

A model is fitted for each series (order priority) and horizon; the default run and the importances take all orders as one series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from horizonspark import calendars
from horizonspark.operators import blend as B
from horizonspark.operators import calendar as cal
from horizonspark.operators import history as hist
from horizonspark.operators import learners as L
from horizonspark.operators.runs import importance_summary, natural_schedule
from horizonspark.plans import forecasts as P
from horizonspark.plans.matrix import feature_matrix, feature_names, holiday_mask_columns
from horizonspark.sources import tables

FEATURES = feature_names()
N_BAGS, N_TREES, TREE_DEPTH = 15, 300, 12


def _daily(spark, sf_dir):
    return tables.daily_series(spark, sf_dir)


def _newest(spark, sf_dir):
    """The last date before each series' newest 28 days: series_id, train_to."""
    return _daily(spark, sf_dir).groupBy("series_id").agg(F.date_sub(F.max("date"), L.HOLDOUT_DAYS).alias("train_to"))


def matrix(spark, sf_dir, by="o_orderpriority"):
    d = tables.daily_series(spark, sf_dir, by=by)
    m = feature_matrix(spark, d, calendars.weekdays_around(d))
    mask = holiday_mask_columns(m.columns)
    m = hist.sample_weights(m, mask).withColumn("is_hol", cal.flag(sum((F.col(c) for c in mask), F.lit(0)) > 0))
    return m


def _run(spark, sf_dir, learn):
    return L.per_horizon(matrix(spark, sf_dir), FEATURES, None, learn)


def booster_forecast(spark, sf_dir):
    """The full run: the six models of the pool."""
    return _run(spark, sf_dir, lambda *a: L.fit_pool(*a, 1.0))


def default_forecast(spark, sf_dir):
    """The default run: one booster of squared error a horizon, for all orders as one series."""
    return L.per_horizon(matrix(spark, sf_dir, None), FEATURES, None, lambda x, y, w, hol, xt, hol_t: {"lgbm_l2": np.maximum(0.0, L.boost(x, y, w, [xt], **L.PARAMS["lgbm_l2"])[0])})


def feature_importance(spark, sf_dir):
    """The features' summed gains in the default run's boosters: mean, deviation and largest over the horizons, best first."""
    gains = L.importances(matrix(spark, sf_dir, None), FEATURES)
    return importance_summary(gains)


def two_stage_forecast(spark, sf_dir):
    return _run(spark, sf_dir, lambda x, y, w, hol, xt, hol_t: {"v3_2stage": np.maximum(0.0, L.two_stage(x, y, w, hol, xt, hol_t))})


def bagged_forecast(spark, sf_dir):
    def learn(x, y, w, hol, xt, hol_t):
        mean, std = L.bagged(x, y, w, xt, N_BAGS, 43)
        return {"bag_mean": mean, "bag_std": std}

    return _run(spark, sf_dir, learn)


def linear_zoo(spark, sf_dir):
    base = FEATURES.index("same_dow_mean_4w")

    def learn(x, y, w, hol, xt, hol_t):
        z, zt = L._filled(x, xt)
        mid = np.nanmedian(y)
        b, bt = (np.where(np.isnan(v[:, base]) | (v[:, base] <= 0), mid, v[:, base]) for v in (x, xt))
        out = {
            "ridge": L.ridge(z, y, w, zt),
            "enet": L.elastic_net(z, y, zt, sweeps=5000),
            "xtrees": L.forest(z, y, w, zt, N_TREES, True, TREE_DEPTH),
            "rf": L.forest(z, y, w, zt, N_TREES, False, TREE_DEPTH),
            "ridge_log": np.expm1(np.minimum(50.0, L.ridge(z, np.log1p(y), w, zt))),
            "ridge_ratio": bt * np.clip(L.ridge(z, np.clip(y / b, 0.3, 3.0), w, zt), 0.3, 3.0),
        }
        return {k: np.maximum(0.0, v) for k, v in out.items()}

    return _run(spark, sf_dir, learn)


def _wide(spark, sf_dir):
    return P.wide(spark, sf_dir).select(*B.KEY, "y", *B.MODELS)


def _past(spark, sf_dir):
    """The rows that weights are fitted on."""
    return _wide(spark, sf_dir).join(F.broadcast(_newest(spark, sf_dir)), "series_id").where("target_date <= train_to").drop("train_to")


def _fit(name):
    """Weights of the models for a group's validation rows."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["target_date", "horizon"])
        a, y = g[B.MODELS].to_numpy(float), g["y"].to_numpy(float)
        ok = ~np.isnan(a).any(axis=1) & (y > 0)
        w = np.full(len(B.MODELS), 1 / len(B.MODELS))
        if ok.sum() >= 8:
            w = L.simplex_weights(a[ok], y[ok]) if name == "opt" else L.nonnegative_least_squares(a[ok], y[ok])
            w = w / w.sum() if w.sum() > 0 else np.full(len(B.MODELS), 1 / len(B.MODELS))
        return pd.DataFrame([[key[0], int(key[1]) if len(key) > 1 else 0, *w]], columns=["series_id", "horizon", *[f"w_{m}" for m in B.MODELS]])

    return run, "series_id string, horizon int, " + ", ".join(f"w_{m} double" for m in B.MODELS)


def _blend(rows, weights, keys):
    return rows.join(F.broadcast(weights), keys).select(*B.KEY, sum((F.col(m) * F.col(f"w_{m}") for m in B.MODELS), F.lit(0.0)).alias("blend"))


def opt_weights_blend(spark, sf_dir):
    w = _past(spark, sf_dir).groupBy("series_id").applyInPandas(*_fit("opt"))
    return _blend(_wide(spark, sf_dir), w.drop("horizon"), ["series_id"])


def nnls_blend(spark, sf_dir):
    w = _past(spark, sf_dir).groupBy("series_id", "horizon").applyInPandas(*_fit("nnls"))
    return _blend(_wide(spark, sf_dir), w, ["series_id", "horizon"])


def ridge_loo_blend(spark, sf_dir):
    """Each row of the schedule is predicted by non-negative ridge weights of the others."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("horizon")
        a, y = g[B.MODELS].to_numpy(float), g["y"].to_numpy(float)
        mean = np.array([np.nanmean(c) if (~np.isnan(c)).any() else 0.0 for c in a.T])
        a, p = np.where(np.isnan(a), mean, a), np.zeros(len(y))
        for i in range(len(y)):
            o = np.arange(len(y)) != i
            ma, my = (a[o].mean(axis=0), y[o].mean()) if o.any() else (a[i], y[i])
            w = L.nonnegative_least_squares(a[o] - ma, y[o] - my, 1.0) if o.any() else np.zeros(a.shape[1])
            p[i] = (a[i] - ma) @ w + my
        return pd.DataFrame({"series_id": key[0], "target_date": g["target_date"].values, "horizon": g["horizon"].values, "blend": p})

    ahead = _daily(spark, sf_dir).join(F.broadcast(_newest(spark, sf_dir)), "series_id").where("date > train_to")
    rows = _wide(spark, sf_dir).join(natural_schedule(ahead.select("series_id", F.col("date").alias("target_date"))), B.KEY).where("y is not null")
    return rows.groupBy("series_id").applyInPandas(run, "series_id string, target_date date, horizon int, blend double")


# booster_forecast, two_stage_forecast, bagged_forecast and linear_zoo are not registered: they take longer than a query may
QUERIES = {f.__name__: f for f in (default_forecast, feature_importance, opt_weights_blend, nnls_blend, ridge_loo_blend)}
