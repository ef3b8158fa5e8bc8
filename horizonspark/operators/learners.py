"""One learner for each series and horizon, fitted inside Spark tasks.

Each group is one series' rows of one horizon (a row a day, so a few thousand), and a task
returns its predictions as rows. The booster is a small histogram
gradient booster: equal-frequency bins, null as a bin of its own, level-wise trees.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rounds, learning rate, depth, least rows of a leaf, L2 penalty, share of rows
# and columns a round, loss, seed of each model of the pool.
PARAMS = {
    "lgbm_l2": dict(rounds=500, rate=0.02, depth=5, leaf=5, l2=1.0, rows=0.8, cols=0.8, loss="squared", seed=123),
    "lgbm_q": dict(rounds=400, rate=0.03, depth=7, leaf=3, l2=0.5, rows=0.9, cols=0.9, loss="absolute", seed=42),
    "xgb": dict(rounds=400, rate=0.03, depth=6, leaf=1, l2=0.5, rows=0.9, cols=0.9, loss="absolute", seed=42),
    "cat": dict(rounds=500, rate=0.03, depth=6, leaf=1, l2=3.0, rows=1.0, cols=1.0, loss="absolute", seed=42),
    "bag": dict(rounds=400, rate=0.02, depth=5, leaf=5, l2=1.0, rows=0.85, cols=0.85, loss="squared", seed=42),
    "residual": dict(rounds=300, rate=0.03, depth=4, leaf=3, l2=2.0, rows=0.85, cols=0.85, loss="squared", seed=321),
}
BAG_SEEDS = (42, 123, 777)
#: Days at a series' end that are predicted if no date is given.
HOLDOUT_DAYS = 28
LEAST_ROWS, LEAST_HOLIDAYS = 30, 20
PREDICTIONS = "series_id string, target_date date, horizon int, model string, pred double"


class Bins:
    """Features as small integers: 0 for null, else the place among the feature's quantiles."""

    def __init__(self, x: np.ndarray, most: int = 32):
        q = np.linspace(0, 1, most)[1:-1]
        self.cuts = [np.unique(np.quantile(c[~np.isnan(c)], q)) if (~np.isnan(c)).any() else np.zeros(0) for c in x.T]
        self.n = most + 1

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.int64)
        for j, cut in enumerate(self.cuts):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(cut, x[:, j], "right") + 1)
        return out


def grow(bins: np.ndarray, n_bins: int, g: np.ndarray, h: np.ndarray, cols: np.ndarray, depth: int, leaf: int, l2: float, gains: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Splits by level: (feature, last bin that goes left) for each node of the level. The splits' gains are added to gains, by feature."""
    node = np.zeros(len(bins), dtype=np.int64)
    levels = []
    offset = np.arange(len(cols)) * n_bins
    for d in range(depth):
        live = np.flatnonzero(np.bincount(node, minlength=1 << d) >= 2 * leaf)  # smaller nodes cannot split, and most of a deep level are
        if not len(live):
            levels.append((np.zeros(1 << d, dtype=np.int64), np.full(1 << d, n_bins)))
            node = 2 * node
            continue
        place = np.full(1 << d, -1)
        place[live] = np.arange(len(live))
        some = np.flatnonzero(place[node] >= 0)
        at = (place[node[some]][:, None] * (len(cols) * n_bins) + bins[np.ix_(some, cols)] + offset).ravel()
        size = len(live) * len(cols) * n_bins
        cell = [np.bincount(at, np.repeat(v[some], len(cols)) if v is not None else None, size).reshape(len(live), len(cols), n_bins).cumsum(axis=2) for v in (g, h, None)]
        gl, hl, nl = (c[:, :, :-1] for c in cell)
        gt, ht, nt = (c[:, :, -1:] for c in cell)
        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
        gain = np.where((nl >= leaf) & (nt - nl >= leaf), gain, 0.0).reshape(len(live), -1)
        best = gain.argmax(axis=1)
        split = gain[np.arange(len(live)), best] > 1e-12
        feature, cut = np.zeros(1 << d, dtype=np.int64), np.full(1 << d, n_bins)
        feature[live], cut[live] = cols[best // (n_bins - 1)], np.where(split, best % (n_bins - 1), n_bins)
        if gains is not None:
            np.add.at(gains, feature[live][split], gain[np.arange(len(live)), best][split])
        levels.append((feature, cut))
        node = 2 * node + (bins[np.arange(len(bins)), feature[node]] > cut[node])
    return levels


def leaf_of(levels: list, bins: np.ndarray) -> np.ndarray:
    node = np.zeros(len(bins), dtype=np.int64)
    for feature, cut in levels:
        node = 2 * node + (bins[np.arange(len(bins)), feature[node]] > cut[node])
    return node


def _medians(group: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The median of x in each of n groups, 0 in empty ones."""
    order = np.lexsort((x, group))
    g, x = group[order], x[order]
    first, size = np.searchsorted(g, np.arange(n)), np.bincount(g, minlength=n)
    lo, hi = np.minimum(first + (size - 1) // 2, len(x) - 1), np.minimum(first + size // 2, len(x) - 1)
    return np.where(size > 0, (x[lo] + x[hi]) / 2, 0.0)


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, tests: list[np.ndarray], rounds: int, rate: float, depth: int, leaf: int, l2: float, rows: float, cols: float, loss: str, seed: int, gains: np.ndarray | None = None) -> list[np.ndarray]:
    """Predictions for each of the test matrices; gains collects the features' importances."""
    rng = np.random.default_rng(seed)
    scale = Bins(x)
    b, t = scale.of(x), [scale.of(z) for z in tests]
    start = float(np.average(y, weights=w)) if loss == "squared" else float(np.median(y))
    p, out = np.full(len(y), start), [np.full(len(z), start) for z in t]
    for _ in range(rounds):
        some = np.sort(rng.permutation(len(y))[: max(1, int(rows * len(y)))]) if rows < 1 else np.arange(len(y))
        kept = np.sort(rng.permutation(x.shape[1])[: max(1, int(cols * x.shape[1]))]) if cols < 1 else np.arange(x.shape[1])
        r = y - p
        g = (r if loss == "squared" else np.sign(r)) * w
        levels = grow(b[some], scale.n, g[some], w[some], kept, depth, leaf, l2, gains)
        at = leaf_of(levels, b)
        if loss == "squared":
            value = np.bincount(at[some], g[some], 1 << depth) / (np.bincount(at[some], w[some], 1 << depth) + l2)
        else:
            value = _medians(at[some], r[some], 1 << depth)
        p = p + rate * value[at]
        out = [o + rate * value[leaf_of(levels, z)] for o, z in zip(out, t, strict=True)]
    return out


def fit_pool(x, y, w, hol, xt, hol_t, scale: float) -> dict[str, np.ndarray]:
    """Predictions of the six models; scale shortens all of them (1 for the full number of rounds)."""
    par = {k: v | {"rounds": max(1, int(v["rounds"] * scale)), "rate": min(0.3, v["rate"] / scale)} for k, v in PARAMS.items()}
    one = np.ones(len(y))
    out = {"lgbm_l2": boost(x, y, w, [xt], **par["lgbm_l2"])[0], "lgbm_q": boost(x, y, w, [xt], **par["lgbm_q"])[0], "xgb": boost(x, y, one, [xt], **par["xgb"])[0], "cat": boost(x, y, w, [xt], **par["cat"])[0]}
    out["lgbm_bag"] = np.mean([boost(x, y, w, [xt], **par["bag"] | {"seed": s})[0] for s in BAG_SEEDS], axis=0)
    out["v3_2stage"] = two_stage(x, y, w, hol, xt, hol_t, par)
    return {k: np.maximum(0.0, v) for k, v in out.items()}


def two_stage(x, y, w, hol, xt, hol_t, par=PARAMS) -> np.ndarray:
    """A model of all days, and one of its errors on holidays that is used on holidays only."""
    base, fitted = boost(x, y, w, [xt, x], **par["lgbm_l2"])
    if hol.sum() < LEAST_HOLIDAYS:
        return base
    more = boost(x[hol], (y - fitted)[hol], w[hol], [xt], **par["residual"])[0]
    return base + np.where(hol_t, more, 0.0)


def bagged(x, y, w, xt, n: int, seed: int, par=PARAMS, cols: float = 0.85) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of n boosters, each on its own 85 % of the columns."""
    rng = np.random.default_rng(seed)
    p = []
    for s in range(n):
        c = rng.choice(x.shape[1], max(1, int(cols * x.shape[1])), replace=False)
        p.append(boost(x[:, c], y, w, [xt[:, c]], **par["bag"] | {"seed": s, "cols": 1.0})[0])
    return np.mean(p, axis=0), np.std(p, axis=0)


def _filled(x: np.ndarray, xt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians for nulls, then zero mean and unit deviation."""
    mid = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
    x, xt = np.where(np.isnan(x), mid, x), np.where(np.isnan(xt), mid, xt)
    m, s = x.mean(axis=0), x.std(axis=0)
    s[s == 0] = 1.0
    return (x - m) / s, (xt - m) / s


def ridge(x, y, w, xt, alpha: float = 10.0) -> np.ndarray:
    m = np.average(y, weights=w)
    mx = np.average(x, axis=0, weights=w)
    c = x - mx
    coef = np.linalg.solve((c * w[:, None]).T @ c + alpha * np.eye(x.shape[1]), (c * w[:, None]).T @ (y - m))
    return (xt - mx) @ coef + m


def elastic_net(x, y, xt, alpha: float = 1.0, l1: float = 0.3, sweeps: int = 200) -> np.ndarray:
    """Coordinate descent on 1 / 2n squared error plus the mixed penalty."""
    n, m = len(y), y.mean()
    r, coef, sq = y - m, np.zeros(x.shape[1]), (x**2).sum(axis=0) / len(y)
    for _ in range(sweeps):
        last = coef.copy()
        for j in range(x.shape[1]):
            rho = x[:, j] @ r / n + sq[j] * coef[j]
            new = np.sign(rho) * max(0.0, abs(rho) - alpha * l1) / (sq[j] + alpha * (1 - l1))
            r += x[:, j] * (coef[j] - new)
            coef[j] = new
        if np.abs(coef - last).max() < 1e-7:
            break
    return xt @ coef + m


def forest(x, y, w, xt, n: int, extra: bool, depth: int = 6, leaf: int = 3, seed: int = 42) -> np.ndarray:
    """Mean of n trees: on bootstrap rows, or (extra) on all rows with coarse random bins."""
    rng = np.random.default_rng(seed)
    out = np.zeros(len(xt))
    for _ in range(n):
        b = Bins(x, int(rng.integers(3, 8)) if extra else 32)
        weight = w if extra else w * rng.multinomial(len(y), np.full(len(y), 1 / len(y)))
        bx = b.of(x)
        cols = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False)) if extra else np.arange(x.shape[1])
        mean = np.average(y, weights=np.maximum(weight, 1e-12))
        levels = grow(bx, b.n, (y - mean) * weight, weight, cols, depth, leaf, 1e-9)
        at = leaf_of(levels, bx)
        value = np.bincount(at, (y - mean) * weight, 1 << depth) / np.maximum(np.bincount(at, weight, 1 << depth), 1e-9)
        out += mean + value[leaf_of(levels, b.of(xt))]
    return out / n


def per_horizon(matrix: DataFrame, features: list[str], train_to: str | None, learn: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """Runs learn(x, y, w, hol, xt, hol_t) for each (series_id, horizon) with 30 training rows or more.

    matrix has the features, y, weight and is_hol; rows with a known target up to train_to are trained on, later ones predicted.
    The date is compared as an ISO string; without one, the group's newest 28 days are predicted.
    """

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("target_date")
        to = train_to or str(pd.Timestamp(g["target_date"].max()).date() - dt.timedelta(days=HOLDOUT_DAYS))
        past = g["target_date"].astype(str) <= to
        train, test = g[past & g["y"].notna()], g[~past]
        if len(train) < LEAST_ROWS or not len(test):
            return pd.DataFrame({"series_id": pd.Series(dtype=str), "target_date": pd.Series(dtype=object), "horizon": pd.Series(dtype="int32"), "model": pd.Series(dtype=str), "pred": pd.Series(dtype=float)})
        x, xt = train[features].to_numpy(float), test[features].to_numpy(float)
        preds = learn(x, train["y"].to_numpy(float), train["weight"].to_numpy(float), train["is_hol"].to_numpy(int) > 0, xt, test["is_hol"].to_numpy(int) > 0)
        return pd.concat([pd.DataFrame({"series_id": key[0], "target_date": test["target_date"].values, "horizon": np.int32(key[1]), "model": m, "pred": p}) for m, p in preds.items()])

    rows = matrix.select("series_id", "target_date", "horizon", "y", "weight", "is_hol", *[F.col(f).cast("double").alias(f) for f in features])
    return rows.groupBy("series_id", "horizon").applyInPandas(run, PREDICTIONS)


def importances(matrix: DataFrame, features: list[str], model: str = "lgbm_l2", **changes) -> DataFrame:
    """(feature, horizon, importance): summed gains of the model's splits, in each series' and horizon's model of all known targets."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g[g["y"].notna()].sort_values("target_date")
        gains = np.zeros(len(features))
        if len(g) >= LEAST_ROWS:
            boost(g[features].to_numpy(float), g["y"].to_numpy(float), g["weight"].to_numpy(float), [], **PARAMS[model] | changes, gains=gains)
        return pd.DataFrame({"feature": features, "horizon": np.int32(key[1]), "importance": gains})

    rows = matrix.select("series_id", "target_date", "horizon", "y", "weight", *[F.col(f).cast("double").alias(f) for f in features])
    return rows.groupBy("series_id", "horizon").applyInPandas(run, "feature string, horizon int, importance double")


def simplex_weights(p: np.ndarray, y: np.ndarray, starts: int | None = None) -> np.ndarray:
    """Weights (non-negative, adding up to 1) of the columns of p with the least mape: moves of weight between pairs from several starts."""
    n = p.shape[1]
    cost = lambda w: float(np.mean(np.abs(y - p @ w) / y))
    best, best_w = np.inf, np.full(n, 1 / n)
    for w in [np.full(n, 1 / n), *np.eye(n)][:starts]:
        w, c, step = w.copy(), cost(w), 0.25
        while step > 1e-4:
            moved = False
            for i in range(n):
                for j in range(n):
                    d = min(step, w[i])
                    if i != j and d > 0:
                        v = w.copy()
                        v[i] -= d
                        v[j] += d
                        if (cv := cost(v)) < c - 1e-12:
                            w, c, moved = v, cv, True
            if not moved:
                step /= 2
        if c < best:
            best, best_w = c, w
    return best_w


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, ridge_: float = 0.0, sweeps: int = 2000) -> np.ndarray:
    """The w >= 0 of least |a w - b|^2 + ridge_ |w|^2, by coordinate descent on the normal equations."""
    q, c = a.T @ a + ridge_ * np.eye(a.shape[1]), a.T @ b
    w = np.zeros(a.shape[1])
    for _ in range(sweeps):
        last = w.copy()
        for j in range(len(w)):
            if q[j, j] > 0:
                w[j] = max(0.0, w[j] + (c[j] - q[j] @ w) / q[j, j])
        if np.abs(w - last).max() < 1e-10:
            break
    return w
