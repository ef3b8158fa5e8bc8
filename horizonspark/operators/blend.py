"""Blends of several models' predictions, in long rows: series_id, target_date, horizon, dow, y, lag_365, model, pool_ord, pred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horizonspark.functions import clip
from horizonspark.operators.metrics import guarded_mape

# The pool of models, in order; the grid of the anchor's calibration.
MODELS = ["lgbm_l2", "lgbm_q", "xgb", "cat", "lgbm_bag", "v3_2stage"]
GROWTH_WINDOWS, POSTS, ALPHAS = (28, 42, 56), (0, 1, 2, 3), 21

KEY = ["series_id", "target_date", "horizon"]
#: Scores are compared after rounding, so that the order of additions cannot decide a tie.
DIGITS = 9


def to_long(wide: DataFrame, models: list[str] = MODELS) -> DataFrame:
    ids = [c for c in wide.columns if c not in models]
    long = wide.unpivot(ids, models, "model", "pred")
    ords = F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(i))])
    return long.withColumn("pool_ord", ords[F.col("model")])


def to_wide(long: DataFrame, keys: list[str], models: list[str] = MODELS) -> DataFrame:
    """One column a model; a full outer join of the models' rows in one shuffle."""
    return long.groupBy(*keys).pivot("model", models).agg(F.first("pred"))


def equal_blend(long: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The mean of the models that have a prediction."""
    return long.groupBy(*keys).agg(F.avg("pred").alias("blend"))


def median_blend(long: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return long.groupBy(*keys).agg(F.percentile("pred", 0.5).alias("blend"))


def impute_mean(long: DataFrame) -> DataFrame:
    means = long.groupBy("series_id", "model").agg(F.avg("pred").alias("_m"))
    return long.join(means, ["series_id", "model"]).withColumn("pred", F.coalesce("pred", "_m")).drop("_m")


def model_scores(long: DataFrame, keys: list[str], score: Column | None = None) -> DataFrame:
    """mape of each model (guarded by default) and n, for each key."""
    m = guarded_mape(F.col("y"), F.col("pred")) if score is None else score
    return long.groupBy(*keys, "model", "pool_ord").agg(F.round(m, DIGITS).alias("mape"), F.count("*").alias("n"))


def selection_table(scores: DataFrame, cell: list[str], top: int = 2, least: int = 3) -> DataFrame:
    """The `top` models of each cell of `least` rows or more, best first; ties by the pool's order, unknown scores last."""
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.col("mape").asc_nulls_last(), "pool_ord"))
    best = scores.where(F.col("n") >= least).withColumn("rank", rank).where(F.col("rank") <= top)
    return best.groupBy(*cell).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "model"))), lambda x: x["model"]).alias("models"))


def selection_blend(long: DataFrame, table: DataFrame, cell: list[str], keys: list[str] = KEY) -> DataFrame:
    """The mean of the cell's models, null if any of them is; cells without a choice take the whole pool."""
    joined = long.join(table, cell, "left").where(F.col("models").isNull() | F.array_contains("models", F.col("model")))
    return joined.groupBy(*keys).agg(F.when(F.count("pred") == F.count("*"), F.avg("pred")).alias("blend"))


def inverse_mape_blend(long: DataFrame, scores: DataFrame, power: int = 4, keys: list[str] = KEY) -> DataFrame:
    """Weights mape ^ -power of each series' models, among the models that have a prediction."""
    w = scores.select("series_id", "model", F.pow(1 / F.nullif(F.col("mape"), F.lit(0.0)), F.lit(power)).alias("w"))
    joined = long.join(w, ["series_id", "model"]).where("pred is not null and w is not null")
    return joined.groupBy(*keys).agg((F.sum(F.col("pred") * F.col("w")) / F.sum("w")).alias("blend"))


def yoy_growth(daily: DataFrame, before: str | None = None, windows: tuple[int, ...] = GROWTH_WINDOWS) -> DataFrame:
    """(series_id, window, growth): mean of the last `window` days (before a date) over that of the same days a year earlier; 1 where unknown.

    Both windows leave out their oldest end and hold their newest.
    """
    past = daily.where(F.col("date") < F.lit(before).cast("date")) if before else daily
    ends = past.groupBy("series_id").agg(F.max("date").alias("end"))
    j = past.join(ends, "series_id")
    aggs = []
    for w in windows:
        new = (F.col("date") > F.date_sub("end", w)) & (F.col("date") <= F.col("end"))
        old = (F.col("date") > F.date_sub("end", 365 + w)) & (F.col("date") <= F.date_sub("end", 365))
        n, o = F.avg(F.when(new, F.col("demand"))), F.avg(F.when(old, F.col("demand")))
        aggs.append(F.struct(F.lit(w).alias("window"), F.coalesce(F.when(o > 0, n / F.nullif(o, F.lit(0.0))), F.lit(1.0)).alias("growth")))
    return j.groupBy("series_id").agg(F.array(*aggs).alias("g")).select("series_id", F.explode("g").alias("g")).select("series_id", "g.*")


def anchor_calibration(rows: DataFrame, growth: DataFrame, influence: DataFrame, least: int = 10) -> DataFrame:
    """(series_id, window, post, alpha): the first cell of the grid with the least mape of (1 - alpha) * blend + alpha * lag_365 * growth.

    rows: series_id, target_date, y, blend, lag_365; influence: (target_date, post) pairs that are masked. A mask of
    fewer than `least` rows is left out; a series without any cell is not in the result (its alpha is 0). The 252 cells are
    an expansion of the masked rows, aggregated at once.
    """
    masked = rows.join(F.broadcast(influence), "target_date").join(growth, "series_id")
    cells = masked.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(ALPHAS - 1)))).withColumn("alpha", F.col("step") / (ALPHAS - 1))
    anchor = F.col("lag_365") * F.col("growth")
    p = F.when(anchor.isNotNull(), (1 - F.col("alpha")) * F.col("blend") + F.col("alpha") * anchor).otherwise(F.col("blend"))
    scores = cells.groupBy("series_id", "window", "post", "step").agg(F.round(guarded_mape(F.col("y"), p), DIGITS).alias("mape"), F.count("*").alias("n")).where(F.col("n") >= least)
    best = scores.where("mape is not null").groupBy("series_id").agg(F.min(F.struct("mape", "window", "post", "step")).alias("b"))
    return best.select("series_id", "b.window", "b.post", (F.col("b.step") / (ALPHAS - 1)).alias("alpha"), "b.mape")


def anchor_apply(rows: DataFrame, mask: Column, alpha: Column, growth: Column) -> DataFrame:
    """blend moved to last year's value times growth where the mask holds and that value is known."""
    anchor = F.col("lag_365") * growth
    out = F.when(mask & (alpha > 0) & anchor.isNotNull(), (1 - alpha) * F.col("blend") + alpha * anchor).otherwise(F.col("blend"))
    return rows.withColumn("blend", out)


def dow_scale(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of targets over sum of blends for each key, between 0.9 and 1.1; 1 where the blends add up to nothing."""
    s = F.sum(F.when(F.col("blend").isNotNull(), F.col("y"))) / F.nullif(F.sum(F.when(F.col("y").isNotNull(), F.col("blend"))), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.coalesce(clip(s, 0.9, 1.1), F.lit(1.0)).alias("scale"))


def dow_scale_median(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The factor k with the least mape of k * blend: the median of y / blend weighted by blend / y (the smallest, if several)."""
    r = rows.where((F.col("y") > 0) & (F.col("blend") > 0)).select(*keys, F.round(F.col("y") / F.col("blend"), DIGITS).alias("_factor"), (F.col("blend") / F.col("y")).alias("_weight"))
    r = r.groupBy(*keys, "_factor").agg(F.sum("_weight").alias("_weight"))
    order = Window.partitionBy(*keys)
    cum = F.sum("_weight").over(order.orderBy("_factor").rowsBetween(Window.unboundedPreceding, 0))
    half = r.select(*keys, "_factor", cum.alias("_cum"), F.sum("_weight").over(order).alias("_total")).where(F.col("_cum") >= F.col("_total") * (0.5 - 1e-12))
    return half.groupBy(*keys).agg(F.min("_factor").alias("scale"))


def best_by(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The model of least mape for each key, ties by the pool's order."""
    best = scores.where("mape is not null").groupBy(*keys).agg(F.min(F.struct("mape", "pool_ord", "model")).alias("b"))
    return best.select(*keys, F.col("b.model").alias("model"), F.col("b.mape").alias("mape"))


def oracle_topk(long: DataFrame, k: int = 3, keys: list[str] = KEY) -> DataFrame:
    """The k models nearest to the truth for each row (an upper bound: it looks at the target)."""
    err = F.round(F.abs(F.col("pred") - F.col("y")), DIGITS)
    ranked = long.where("pred is not null and y is not null").withColumn("abs_err", err)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("abs_err", "pool_ord"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "rank", "model", "abs_err")


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Metrics of strategies with a grade: mape under 2 %, under 3 %, or other."""
    grade = F.when(F.col("mape") < 0.02, "A").when(F.col("mape") < 0.03, "B").otherwise("C")
    return metrics.withColumn("grade", grade)


def marked_best(board: DataFrame) -> DataFrame:
    """The board with is_best: the least mape (ties by name) of the strategies that do not look at the target. A board has a row for each strategy, a dozen or two."""
    able = F.when(~F.contains("strategy", F.lit("oracle")) & F.col("mape").isNotNull(), F.struct("mape", "strategy"))
    held = board.agg(F.collect_list(F.struct(*board.columns)).alias("rows"), F.min(able).alias("best"))
    return held.select(F.explode("rows").alias("row"), "best").select("row.*", F.coalesce(F.col("row.strategy") == F.col("best.strategy"), F.lit(False)).alias("is_best"))
