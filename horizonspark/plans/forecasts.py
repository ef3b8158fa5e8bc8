"""Queries of metrics, intervals and blends, on six simple forecasts that stand for the pool's models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonspark import calendars
from horizonspark.functions import rounded
from horizonspark.operators import blend as B
from horizonspark.operators import calendar as cal
from horizonspark.operators import history as hist
from horizonspark.operators import metrics as M
from horizonspark.plans import sql as S
from horizonspark.plans.features import _ewma
from horizonspark.sources import tables

KEY = B.KEY
CELL = ["series_id", "dow", "horizon"]


def _with_last(rows: DataFrame, spark, sf_dir) -> DataFrame:
    """rows with each series' newest date."""
    return rows.join(tables.series_ends(spark, sf_dir), "series_id")


def ahead(rows: DataFrame, spark, sf_dir, date: str = "target_date") -> DataFrame:
    """Rows of each series' newest days, which are forecast."""
    return _with_last(rows, spark, sf_dir).where(F.col(date) > F.date_sub("last", S.AHEAD)).drop("last")


def before(rows: DataFrame, spark, sf_dir, date: str = "target_date") -> DataFrame:
    """Rows before each series' newest days."""
    return _with_last(rows, spark, sf_dir).where(F.col(date) <= F.date_sub("last", S.AHEAD)).drop("last")


def wide(spark, sf_dir) -> DataFrame:
    """Simple forecasts under the pool's names: series_id, target_date, horizon, dow, y, lag_365, is_hol and a column for each model."""
    d = tables.daily_series(spark, sf_dir)
    m = hist.horizon_matrix(d)
    columns = {k: v for k, v in (hist.rolling_columns([7, 28]) | hist.ewma_columns([7])).items() if k in ("rolling_mean_7", "rolling_mean_28", "ewma_7")}
    m = hist.with_base(hist.with_past(m, hist.offset_map(d)), hist.base_features(d, columns))
    m = cal.holiday_membership(m, calendars.holiday_anchors(spark))
    a7, s4 = hist.lag_anchor_columns()["lag_anchor_7"], hist.same_dow_columns()["same_dow_mean_4w"]
    models = [a7, F.col("rolling_mean_28"), s4, F.col("ewma_7"), F.col("rolling_mean_7"), (a7 + F.col("rolling_mean_28")) / 2]
    return m.select(
        *KEY, F.weekday("target_date").alias("dow"), "y", hist.lag_columns()["lag_365"].alias("lag_365"), cal.flag(F.col("holiday").isNotNull()).alias("is_hol"),
        *[c.alias(n) for n, c in zip(B.MODELS, models, strict=True)],
    )


def long(spark, sf_dir) -> DataFrame:
    return B.to_long(wide(spark, sf_dir))


def validation(spark, sf_dir) -> DataFrame:
    """The days before the schedule that models are chosen by."""
    return before(long(spark, sf_dir), spark, sf_dir)


def wide_predictions(spark, sf_dir):
    return B.to_wide(long(spark, sf_dir), KEY).select(*KEY, *[rounded(F.col(m)).alias(m) for m in B.MODELS])


def natural_schedule(spark, sf_dir):
    from horizonspark.operators.runs import natural_schedule as schedule

    d = tables.daily_series(spark, sf_dir)
    return schedule(ahead(d, spark, sf_dir, "date").select("series_id", F.col("date").alias("target_date")))


def predict_targets(spark, sf_dir):
    return wide(spark, sf_dir).select(*KEY, "y", *[rounded(F.col(m)).alias(m) for m in B.MODELS]).join(natural_schedule(spark, sf_dir), KEY)


def impute_mean(spark, sf_dir):
    return B.impute_mean(long(spark, sf_dir)).select(*KEY, "model", rounded(F.col("pred")).alias("pred"))


def equal_blend(spark, sf_dir):
    return B.equal_blend(long(spark, sf_dir)).select(*KEY, rounded(F.col("blend")).alias("blend"))


def median_blend(spark, sf_dir):
    return B.median_blend(long(spark, sf_dir)).select(*KEY, rounded(F.col("blend")).alias("blend"))


def inv_mape_blend(spark, sf_dir):
    scores = B.model_scores(validation(spark, sf_dir), ["series_id"])
    return B.inverse_mape_blend(long(spark, sf_dir), scores).select(*KEY, rounded(F.col("blend")).alias("blend"))


def selection_scores(spark, sf_dir):
    return B.model_scores(validation(spark, sf_dir), CELL).select(*CELL, "model", rounded(F.col("mape")).alias("mape"), "n")


def selection_scores_floor(spark, sf_dir):
    return B.model_scores(validation(spark, sf_dir), CELL, M.floor_mape(F.col("y"), F.col("pred"))).select(*CELL, "model", rounded(F.col("mape")).alias("mape"), "n")


def _table(spark, sf_dir):
    return B.selection_table(B.model_scores(validation(spark, sf_dir), CELL), CELL)


def selection_table(spark, sf_dir):
    return _table(spark, sf_dir).select(*CELL, F.col("models")[0].alias("best1"), F.col("models")[1].alias("best2"))


def _selected(spark, sf_dir, rows):
    return B.selection_blend(rows, _table(spark, sf_dir), CELL, [*KEY, "dow", "y", "lag_365", "is_hol"])


def selection_blend(spark, sf_dir):
    return _selected(spark, sf_dir, long(spark, sf_dir)).select(*KEY, rounded(F.col("blend")).alias("blend"))


def winner_frequency(spark, sf_dir):
    return _table(spark, sf_dir).groupBy(F.col("models")[0].alias("model")).agg(F.count("*").alias("n_cells"))


def yoy_growth(spark, sf_dir):
    return B.yoy_growth(before(tables.daily_series(spark, sf_dir), spark, sf_dir, date="date")).select("series_id", "window", rounded(F.col("growth")).alias("growth"))


def _influence(spark, dates):
    anchors = calendars.holiday_anchors(spark)
    posts = [cal.influence_mask(dates, anchors, p).where("in_influence").select("target_date", F.lit(p).alias("post")) for p in B.POSTS]
    out = posts[0]
    for p in posts[1:]:
        out = out.unionByName(p)
    return out


def influence_mask(spark, sf_dir):
    return cal.influence_mask(tables.daily_series(spark, sf_dir).select(F.col("date").alias("target_date")).distinct(), calendars.holiday_anchors(spark), 2)


def _calibrated(spark, sf_dir):
    d = tables.daily_series(spark, sf_dir)
    rows = B.equal_blend(validation(spark, sf_dir), [*KEY, "dow", "y", "lag_365", "is_hol"])
    return B.anchor_calibration(rows, B.yoy_growth(before(d, spark, sf_dir, "date")), _influence(spark, d.select(F.col("date").alias("target_date")).distinct()))


def anchor_calibration(spark, sf_dir):
    return _calibrated(spark, sf_dir).select("series_id", "window", "post", rounded(F.col("alpha")).alias("alpha"), rounded(F.col("mape")).alias("mape"))


def anchor_apply(spark, sf_dir):
    d = tables.daily_series(spark, sf_dir)
    rows = B.equal_blend(long(spark, sf_dir), [*KEY, "dow", "y", "lag_365", "is_hol"])
    growth = B.yoy_growth(before(d, spark, sf_dir, date="date")).where("window = 28").select("series_id", "growth")
    marked = cal.influence_mask(rows, calendars.holiday_anchors(spark), 1).join(growth, "series_id")
    return B.anchor_apply(marked, F.col("in_influence"), F.lit(0.25), F.col("growth")).select(*KEY, rounded(F.col("blend")).alias("blend"))


def anchor_apply_hol(spark, sf_dir):
    d = tables.daily_series(spark, sf_dir)
    rows = B.equal_blend(long(spark, sf_dir), [*KEY, "dow", "y", "lag_365", "is_hol"])
    growth = B.yoy_growth(before(d, spark, sf_dir, date="date")).where("window = 28").select("series_id", "growth")
    return B.anchor_apply(rows.join(growth, "series_id"), F.col("is_hol") == 1, F.lit(0.25), F.col("growth")).select(*KEY, rounded(F.col("blend")).alias("blend"))


def _equal(spark, sf_dir):
    return B.equal_blend(long(spark, sf_dir), [*KEY, "dow", "y"]).withColumn("blend", rounded(F.col("blend")))


def dow_scale(spark, sf_dir):
    return B.dow_scale(_equal(spark, sf_dir), ["series_id", "dow"]).select("series_id", "dow", rounded(F.col("scale")).alias("scale"))


def dow_scale_median(spark, sf_dir):
    return B.dow_scale_median(_equal(spark, sf_dir), ["series_id", "dow"]).select("series_id", "dow", rounded(F.col("scale")).alias("scale"))


def dow_best(spark, sf_dir):
    rows = validation(spark, sf_dir).withColumn("weekday", F.date_format("target_date", "EEEE"))
    return B.best_by(B.model_scores(rows, ["series_id", "weekday"]), ["series_id", "weekday"]).select("series_id", "weekday", "model", rounded(F.col("mape")).alias("mape"))


def oracle_topk(spark, sf_dir):
    return B.oracle_topk(long(spark, sf_dir)).select(*KEY, "rank", "model", rounded(F.col("abs_err")).alias("abs_err"))


def _metrics(df):
    return df.select(*[rounded(F.col(c)).alias(c) if t == "double" else c for c, t in df.dtypes])


def forecast_metrics(spark, sf_dir):
    return _metrics(M.error_metrics(long(spark, sf_dir), ["series_id", "model"]))


def backtest_metrics(spark, sf_dir):
    rows = long(spark, sf_dir).join(natural_schedule(spark, sf_dir), KEY)
    return _metrics(M.error_metrics(rows, ["model"]))


def strategy_leaderboard(spark, sf_dir):
    rows = long(spark, sf_dir)
    one = rows.select("y", "pred", F.col("model").alias("strategy"))
    equal = B.equal_blend(rows, [*KEY, "y"]).select("y", F.col("blend").alias("pred"), F.lit("equal").alias("strategy"))
    median = B.median_blend(rows, [*KEY, "y"]).select("y", F.col("blend").alias("pred"), F.lit("median").alias("strategy"))
    return _metrics(B.leaderboard(M.error_metrics(one.unionByName(equal).unionByName(median), ["strategy"])))


def final_scale(spark, sf_dir):
    """One factor for each series that makes the equal blend's mape least."""
    return B.dow_scale_median(_equal(spark, sf_dir), ["series_id"]).select("series_id", rounded(F.col("scale")).alias("scale"))


def strategy_comparison(spark, sf_dir):
    """All ways to blend, over the days before the schedule: models, means, weights, selections, scales, and the best three in hindsight (an upper bound that cannot win)."""
    rows = validation(spark, sf_dir)
    keys = [*KEY, "dow", "y"]
    scores = B.model_scores(rows, CELL)
    equal = B.equal_blend(rows, keys).withColumn("blend", rounded(F.col("blend")))

    def scaled(scales, on):
        return equal.join(scales, on).withColumn("blend", F.col("blend") * F.col("scale"))

    best = B.best_by(B.model_scores(rows, ["series_id", "dow"]), ["series_id", "dow"]).select("series_id", "dow", "model")
    errors = B.oracle_topk(rows, 3, keys).select(*KEY, "model").join(rows, [*KEY, "model"])
    ways = {
        "equal": equal,
        "median": B.median_blend(rows, keys),
        "inverse_mape": B.inverse_mape_blend(rows, B.model_scores(rows, ["series_id"]), keys=keys),
        "selection_top1": B.selection_blend(rows, B.selection_table(scores, CELL, top=1), CELL, keys),
        "selection_top2": B.selection_blend(rows, B.selection_table(scores, CELL), CELL, keys),
        "dow_best": rows.join(best, ["series_id", "dow", "model"]).withColumn("blend", F.col("pred")),
        "dow_scaled": scaled(B.dow_scale(equal, ["series_id", "dow"]), ["series_id", "dow"]),
        "dow_scaled_median": scaled(B.dow_scale_median(equal, ["series_id", "dow"]), ["series_id", "dow"]),
        "final_scaled": scaled(B.dow_scale_median(equal, ["series_id"]), ["series_id"]),
        "oracle_top3": B.equal_blend(errors, keys),
    }
    out = rows.select("y", "pred", F.col("model").alias("strategy"))
    for name, df in ways.items():
        out = out.unionByName(df.select("y", F.col("blend").alias("pred"), F.lit(name).alias("strategy")))
    return B.marked_best(_metrics(B.leaderboard(M.error_metrics(out, ["strategy"]))))


def _model(spark, sf_dir):
    """The flagship's one model: same-weekday mean, else the mean of 28 or 7 days."""
    w = wide(spark, sf_dir)
    return w.select(*KEY, "y", F.coalesce("xgb", "lgbm_q", "lgbm_bag").alias("pred"))


def residual_quantiles(spark, sf_dir):
    rows = before(_model(spark, sf_dir), spark, sf_dir)
    return _metrics(M.residual_quantiles(rows, ["series_id", "horizon"]))


def _intervals(spark, sf_dir, both_sides=True):
    rows = _model(spark, sf_dir)
    q = M.residual_quantiles(before(rows, spark, sf_dir), ["series_id", "horizon"])
    return M.intervals(rows.join(natural_schedule(spark, sf_dir), KEY), q, ["series_id", "horizon"], both_sides)


def forecast_intervals(spark, sf_dir):
    return _metrics(_intervals(spark, sf_dir).select(*KEY, "p10", "p50", "p90"))


def interval_variants(spark, sf_dir):
    return _metrics(_intervals(spark, sf_dir, False).select(*KEY, "p10", "p50", "p90"))


def interval_coverage(spark, sf_dir):
    return _metrics(M.coverage(_intervals(spark, sf_dir), ["series_id"]))


QUERIES = {
    f.__name__: f
    for f in (
        wide_predictions, natural_schedule, predict_targets, impute_mean, equal_blend, median_blend, inv_mape_blend, selection_scores, selection_scores_floor, selection_table, selection_blend,
        winner_frequency, yoy_growth, influence_mask, anchor_calibration, anchor_apply, anchor_apply_hol, dow_scale, dow_scale_median, dow_best, oracle_topk, forecast_metrics, backtest_metrics,
        strategy_leaderboard, final_scale, strategy_comparison, residual_quantiles, forecast_intervals, interval_variants, interval_coverage,
    )
}

_M = ", ".join(f"round({m}, 6) AS {m}" for m in B.MODELS)
_WIDE = f"""{S.ENDS},
f AS (SELECT b.series_id, b.base_date, {S.window("avg(demand)", 28)} AS r28, {S.window("avg(demand)", 7)} AS r7, {_ewma(7)} AS e7
  FROM (SELECT DISTINCT series_id, base_date FROM grid) b),
s4 AS (SELECT g.series_id, g.target_date, g.horizon, avg(d.demand) AS s4 FROM grid g, range(1, 5) t(k), daily d
  WHERE d.series_id = g.series_id AND d.date = g.target_date - 7 * k::INT AND 7 * k >= g.horizon + 1 GROUP BY ALL),
wide AS (SELECT g.series_id, g.target_date, g.horizon, (isodow(g.target_date) - 1)::INT AS dow, g.y, l.demand AS lag_365,
    (EXISTS (SELECT 1 FROM anchors WHERE g.target_date BETWEEN anchor + ws AND anchor + we))::INT AS is_hol,
    a.demand AS lgbm_l2, r28 AS lgbm_q, s4 AS xgb, e7 AS cat, r7 AS lgbm_bag, (a.demand + r28) / 2 AS v3_2stage
  FROM grid g JOIN f ON f.series_id = g.series_id AND f.base_date = g.base_date LEFT JOIN s4 ON s4.series_id = g.series_id AND s4.target_date = g.target_date AND s4.horizon = g.horizon
  LEFT JOIN daily a ON a.series_id = g.series_id AND a.date = g.target_date - greatest(7, g.horizon + 1) LEFT JOIN daily l ON l.series_id = g.series_id AND l.date = g.target_date - 365),
long AS (SELECT series_id, target_date, horizon, dow, y, lag_365, is_hol, m.model, m.pred, m.pool_ord FROM wide, LATERAL (VALUES {", ".join(f"('{m}', {m}, {i})" for i, m in enumerate(B.MODELS))}) m(model, pred, pool_ord)),
val AS (SELECT long.* FROM long JOIN ends USING (series_id) WHERE target_date <= last - {S.AHEAD}),
sched AS (SELECT series_id, date AS target_date, row_number() OVER (PARTITION BY series_id ORDER BY date)::INT AS horizon FROM daily JOIN ends USING (series_id) WHERE date > last - {S.AHEAD}),
equal AS (SELECT series_id, target_date, horizon, dow, y, lag_365, is_hol, avg(pred) AS blend FROM long GROUP BY ALL)"""
_MAPE = "avg(CASE WHEN y > 0 AND pred IS NOT NULL THEN abs(y - pred) / y END)"
_SCORES = f"scores AS (SELECT series_id, dow, horizon, model, pool_ord, round({_MAPE}, 9) AS mape, count(*) AS n FROM val GROUP BY ALL)"
_TABLE = "ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, dow, horizon ORDER BY mape ASC NULLS LAST, pool_ord) AS rk FROM scores WHERE n >= 3), tab AS (SELECT * FROM ranked WHERE rk <= 2)"
_W = S.with_(S.DAILY, S.GRID, S.ANCHORS, _WIDE)


def _growth(windows=B.GROWTH_WINDOWS) -> str:
    one = lambda w: f"""SELECT series_id, {w} AS "window", coalesce(CASE WHEN avg(CASE WHEN date > e - {365 + w} AND date <= e - 365 THEN demand END) > 0
        THEN avg(CASE WHEN date > e - {w} THEN demand END) / avg(CASE WHEN date > e - {365 + w} AND date <= e - 365 THEN demand END) END, 1.0) AS growth FROM p GROUP BY ALL"""  # noqa: E731
    return f"p AS (SELECT daily.*, max(date) OVER (PARTITION BY series_id) AS e FROM daily JOIN ends USING (series_id) WHERE date <= last - {S.AHEAD}), growth AS ({' UNION ALL '.join(map(one, windows))})"


def _mask(post: str, d: str = "target_date") -> str:
    return f"EXISTS (SELECT 1 FROM anchors WHERE holiday IN {calendars.FIXED_DATE!r} AND {d} BETWEEN anchor + ws AND anchor + we + {post})"


_ERR = "round(sum(abs(pred - y)) / sum(abs(y)), 6) AS wape, round(avg(abs(pred - y) / y), 6) AS mape, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, round(avg(pred - y), 6) AS bias, count(*) AS n"
_OK = "pred IS NOT NULL AND y IS NOT NULL"
_MODEL = f"""model AS (SELECT series_id, target_date, horizon, y, coalesce(xgb, lgbm_q, lgbm_bag) AS pred FROM wide),
q AS (SELECT series_id, horizon, quantile_cont(y - pred, 0.1) AS ql, quantile_cont(y - pred, 0.9) AS qh FROM model JOIN ends USING (series_id) WHERE target_date <= last - {S.AHEAD} GROUP BY ALL)"""
_BANDS = """iv AS (SELECT m.series_id, m.target_date, m.horizon, y, greatest(0, pred + ql) AS lo, CASE WHEN pred IS NOT NULL THEN greatest(0, pred) END AS p50, greatest(0, pred + qh) AS hi, pred IS NOT NULL AND ql IS NOT NULL AS ok
  FROM model m JOIN sched s ON s.series_id = m.series_id AND s.target_date = m.target_date AND s.horizon = m.horizon LEFT JOIN q ON q.series_id = m.series_id AND q.horizon = m.horizon)"""

SQL = {
    "wide_predictions": _W + f"SELECT series_id, target_date, horizon, {_M} FROM wide",
    "natural_schedule": _W + "SELECT * FROM sched",
    "predict_targets": _W + f"SELECT w.series_id, w.target_date, w.horizon, y, {_M} FROM wide w JOIN sched s ON s.series_id = w.series_id AND s.target_date = w.target_date AND s.horizon = w.horizon",
    "impute_mean": _W + "SELECT series_id, target_date, horizon, model, round(coalesce(pred, avg(pred) OVER (PARTITION BY series_id, model)), 6) AS pred FROM long",
    "equal_blend": _W + "SELECT series_id, target_date, horizon, round(blend, 6) AS blend FROM equal",
    "median_blend": _W + "SELECT series_id, target_date, horizon, round(median(pred), 6) AS blend FROM long GROUP BY ALL",
    "inv_mape_blend": _W + f", w AS (SELECT series_id, model, pow(1 / nullif(round({_MAPE}, 9), 0), 4) AS w FROM val GROUP BY ALL) SELECT series_id, target_date, horizon, round(sum(pred * w) / sum(w), 6) AS blend FROM long JOIN w USING (series_id, model) WHERE pred IS NOT NULL AND w IS NOT NULL GROUP BY ALL",
    "selection_scores": _W + f", {_SCORES} SELECT series_id, dow, horizon, model, round(mape, 6) AS mape, n FROM scores",
    "selection_scores_floor": _W + "SELECT series_id, dow, horizon, model, round(round(avg(CASE WHEN y IS NOT NULL AND pred IS NOT NULL THEN abs(y - pred) / greatest(y, 1) END), 9), 6) AS mape, count(*) AS n FROM val GROUP BY ALL",
    "selection_table": _W + f", {_SCORES}, {_TABLE} SELECT series_id, dow, horizon, max(CASE WHEN rk = 1 THEN model END) AS best1, max(CASE WHEN rk = 2 THEN model END) AS best2 FROM tab GROUP BY ALL",
    "selection_blend": _W + f""", {_SCORES}, {_TABLE}, cells AS (SELECT DISTINCT series_id, dow, horizon FROM tab)
        SELECT l.series_id, l.target_date, l.horizon, round(CASE WHEN count(pred) = count(*) THEN avg(pred) END, 6) AS blend FROM long l LEFT JOIN cells c ON c.series_id = l.series_id AND c.dow = l.dow AND c.horizon = l.horizon
        LEFT JOIN tab t ON t.series_id = l.series_id AND t.dow = l.dow AND t.horizon = l.horizon AND t.model = l.model WHERE c.dow IS NULL OR t.model IS NOT NULL GROUP BY ALL""",
    "winner_frequency": _W + f", {_SCORES}, {_TABLE} SELECT model, count(*) AS n_cells FROM tab WHERE rk = 1 GROUP BY ALL",
    "yoy_growth": S.with_(S.DAILY, S.ENDS, _growth()) + 'SELECT series_id, "window", round(growth, 6) AS growth FROM growth',
    "influence_mask": S.with_(S.DAILY, S.DATES, S.ANCHORS) + f"SELECT target_date, {_mask('2')} AS in_influence FROM dates",
    "anchor_calibration": _W + f""", {_growth()}, posts AS (SELECT p.post::INT AS post FROM range(0, 4) p(post)), m AS (SELECT e.*, post FROM (SELECT equal.* FROM equal JOIN ends USING (series_id) WHERE target_date <= last - {S.AHEAD}) e, posts WHERE {_mask('post')}),
        c AS (SELECT m.series_id, "window", post, step::INT AS step, round(avg(CASE WHEN y > 0 AND blend IS NOT NULL THEN abs(y - CASE WHEN lag_365 IS NOT NULL THEN (1 - step / 20) * blend + step / 20 * lag_365 * growth ELSE blend END) / y END), 9) AS mape, count(*) AS n
              FROM m JOIN growth USING (series_id), range(0, 21) t(step) GROUP BY ALL),
        b AS (SELECT * FROM c WHERE n >= 10 AND mape IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mape, "window", post, step) = 1)
        SELECT series_id, "window", post, round(step / 20, 6) AS alpha, round(mape, 6) AS mape FROM b""",
    "anchor_apply": _W + f""", {_growth((28,))} SELECT series_id, target_date, horizon, round(CASE WHEN lag_365 IS NOT NULL AND {_mask('1')} THEN 0.75 * blend + 0.25 * lag_365 * growth ELSE blend END, 6) AS blend
        FROM equal JOIN growth USING (series_id)""",
    "anchor_apply_hol": _W + f""", {_growth((28,))} SELECT series_id, target_date, horizon, round(CASE WHEN lag_365 IS NOT NULL AND is_hol = 1 THEN 0.75 * blend + 0.25 * lag_365 * growth ELSE blend END, 6) AS blend
        FROM equal JOIN growth USING (series_id)""",
    "dow_scale": _W + "SELECT series_id, dow, round(coalesce(least(greatest(sum(CASE WHEN blend IS NOT NULL THEN y END) / nullif(sum(round(blend, 6)), 0), 0.9), 1.1), 1.0), 6) AS scale FROM equal GROUP BY ALL",
    "dow_scale_median": _W + """, r AS (SELECT series_id, dow, round(y / b, 9) AS k, sum(b / y) AS w FROM (SELECT *, round(blend, 6) AS b FROM equal) WHERE y > 0 AND b > 0 GROUP BY ALL),
        c AS (SELECT *, sum(w) OVER (PARTITION BY series_id, dow ORDER BY k) AS cum, sum(w) OVER (PARTITION BY series_id, dow) AS total FROM r)
        SELECT series_id, dow, round(min(k), 6) AS scale FROM c WHERE cum >= total * (0.5 - 1e-12) GROUP BY ALL""",
    "dow_best": _W + f", s AS (SELECT series_id, dayname(target_date) AS weekday, model, pool_ord, round({_MAPE}, 9) AS mape FROM val GROUP BY ALL) SELECT series_id, weekday, model, round(mape, 6) AS mape FROM s WHERE mape IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, weekday ORDER BY mape, pool_ord) = 1",
    "oracle_topk": _W + f"SELECT series_id, target_date, horizon, row_number() OVER w AS rank, model, round(round(abs(pred - y), 9), 6) AS abs_err FROM long WHERE {_OK} WINDOW w AS (PARTITION BY series_id, target_date, horizon ORDER BY round(abs(pred - y), 9), pool_ord) QUALIFY row_number() OVER w <= 3",
    "forecast_metrics": _W + f"SELECT series_id, model, {_ERR} FROM long WHERE {_OK} GROUP BY ALL",
    "backtest_metrics": _W + f"SELECT model, {_ERR} FROM long l JOIN sched s ON s.series_id = l.series_id AND s.target_date = l.target_date AND s.horizon = l.horizon WHERE {_OK} GROUP BY ALL",
    "strategy_leaderboard": _W + f""", a AS (SELECT model AS strategy, y, pred FROM long UNION ALL SELECT 'equal', y, blend FROM equal UNION ALL SELECT 'median', y, median(pred) FROM long GROUP BY series_id, target_date, horizon, y),
        m AS (SELECT strategy, {_ERR} FROM a WHERE {_OK} GROUP BY ALL) SELECT *, CASE WHEN mape < 0.02 THEN 'A' WHEN mape < 0.03 THEN 'B' ELSE 'C' END AS grade FROM m""",
    "final_scale": _W + """, r AS (SELECT series_id, round(y / b, 9) AS k, sum(b / y) AS w FROM (SELECT *, round(blend, 6) AS b FROM equal) WHERE y > 0 AND b > 0 GROUP BY ALL),
        c AS (SELECT *, sum(w) OVER (PARTITION BY series_id ORDER BY k) AS cum, sum(w) OVER (PARTITION BY series_id) AS total FROM r)
        SELECT series_id, round(min(k), 6) AS scale FROM c WHERE cum >= total * (0.5 - 1e-12) GROUP BY ALL""",
    "strategy_comparison": _W.replace("val AS (", "val AS MATERIALIZED (") + f""", {_SCORES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, dow, horizon ORDER BY mape ASC NULLS LAST, pool_ord) AS rk FROM scores WHERE n >= 3),
        cells AS (SELECT DISTINCT series_id, dow, horizon FROM ranked),
        eq AS (SELECT series_id, target_date, horizon, dow, y, round(avg(pred), 6) AS blend FROM val GROUP BY ALL),
        iw AS (SELECT series_id, model, pow(1 / nullif(round({_MAPE}, 9), 0), 4) AS w FROM val GROUP BY ALL),
        db AS (SELECT series_id, dow, model FROM (SELECT series_id, dow, model, pool_ord, round({_MAPE}, 9) AS mape FROM val GROUP BY ALL) WHERE mape IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, dow ORDER BY mape, pool_ord) = 1),
        sc AS (SELECT series_id, dow, coalesce(least(greatest(sum(CASE WHEN blend IS NOT NULL THEN y END) / nullif(sum(CASE WHEN y IS NOT NULL THEN blend END), 0), 0.9), 1.1), 1.0) AS scale FROM eq GROUP BY ALL),
        r AS (SELECT series_id, dow, round(y / blend, 9) AS k, sum(blend / y) AS w FROM eq WHERE y > 0 AND blend > 0 GROUP BY ALL),
        md AS (SELECT series_id, dow, min(k) AS scale FROM (SELECT *, sum(w) OVER (PARTITION BY series_id, dow ORDER BY k) AS cum, sum(w) OVER (PARTITION BY series_id, dow) AS total FROM r) WHERE cum >= total * (0.5 - 1e-12) GROUP BY ALL),
        rs AS (SELECT series_id, k, sum(w) AS w FROM r GROUP BY ALL),
        fs AS (SELECT series_id, min(k) AS scale FROM (SELECT *, sum(w) OVER (PARTITION BY series_id ORDER BY k) AS cum, sum(w) OVER (PARTITION BY series_id) AS total FROM rs) WHERE cum >= total * (0.5 - 1e-12) GROUP BY ALL),
        top AS (SELECT series_id, target_date, horizon, y, pred FROM val WHERE {_OK} QUALIFY row_number() OVER (PARTITION BY series_id, target_date, horizon ORDER BY round(abs(pred - y), 9), pool_ord) <= 3),
        chosen AS (SELECT v.*, c.dow IS NULL AS free, t.rk FROM val v LEFT JOIN cells c ON c.series_id = v.series_id AND c.dow = v.dow AND c.horizon = v.horizon LEFT JOIN ranked t ON t.series_id = v.series_id AND t.dow = v.dow AND t.horizon = v.horizon AND t.model = v.model),
        a AS (SELECT model AS strategy, y, pred FROM val UNION ALL SELECT 'equal', y, blend FROM eq
          UNION ALL SELECT 'median', y, median(pred) FROM val GROUP BY series_id, target_date, horizon, y
          UNION ALL SELECT 'inverse_mape', y, sum(pred * w) / sum(w) FROM val JOIN iw USING (series_id, model) WHERE pred IS NOT NULL AND w IS NOT NULL GROUP BY series_id, target_date, horizon, y
          UNION ALL SELECT 'selection_top1', y, CASE WHEN count(pred) = count(*) THEN avg(pred) END FROM chosen WHERE free OR rk <= 1 GROUP BY series_id, target_date, horizon, y
          UNION ALL SELECT 'selection_top2', y, CASE WHEN count(pred) = count(*) THEN avg(pred) END FROM chosen WHERE free OR rk <= 2 GROUP BY series_id, target_date, horizon, y
          UNION ALL SELECT 'dow_best', y, pred FROM val JOIN db USING (series_id, dow, model)
          UNION ALL SELECT 'dow_scaled', y, blend * scale FROM eq JOIN sc USING (series_id, dow)
          UNION ALL SELECT 'dow_scaled_median', y, blend * scale FROM eq JOIN md USING (series_id, dow)
          UNION ALL SELECT 'final_scaled', y, blend * scale FROM eq JOIN fs USING (series_id)
          UNION ALL SELECT 'oracle_top3', y, avg(pred) FROM top GROUP BY series_id, target_date, horizon, y),
        m AS (SELECT strategy, {_ERR} FROM a WHERE {_OK} GROUP BY ALL)
        SELECT *, CASE WHEN mape < 0.02 THEN 'A' WHEN mape < 0.03 THEN 'B' ELSE 'C' END AS grade, strategy = (SELECT strategy FROM m WHERE NOT contains(strategy, 'oracle') AND mape IS NOT NULL ORDER BY mape, strategy LIMIT 1) AS is_best FROM m""",
    "residual_quantiles": _W + f", {_MODEL} SELECT series_id, horizon, round(ql, 6) AS q_low, round(qh, 6) AS q_high FROM q",
    "forecast_intervals": _W + f", {_MODEL}, {_BANDS} SELECT series_id, target_date, horizon, round(CASE WHEN ok THEN least(lo, p50) END, 6) AS p10, round(p50, 6) AS p50, round(CASE WHEN ok THEN greatest(hi, p50) END, 6) AS p90 FROM iv",
    "interval_variants": _W + f", {_MODEL}, {_BANDS} SELECT series_id, target_date, horizon, round(CASE WHEN ok THEN lo END, 6) AS p10, round(p50, 6) AS p50, round(CASE WHEN ok THEN greatest(hi, p50) END, 6) AS p90 FROM iv",
    "interval_coverage": _W + f", {_MODEL}, {_BANDS} SELECT series_id, round(avg(CASE WHEN ok THEN (y BETWEEN least(lo, p50) AND greatest(hi, p50))::INT END), 6) AS coverage, count(CASE WHEN ok THEN 1 END) AS n FROM iv GROUP BY ALL",
}
