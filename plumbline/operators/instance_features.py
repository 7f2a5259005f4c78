"""Descriptive features of test instances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ppd
from ..functions.neighbours import nearest
from ..functions.scalar import finite, ratio


def ppd_statistics(rows: DataFrame, levels: Sequence[float], alpha: float = 0.1) -> DataFrame:
    """Centre, spread and shape of each row's distribution, and its central interval."""
    p = F.col("ppd")
    q = lambda v: ppd.quantile_at(p, levels, v)
    mean = ppd.mean(p, levels)
    central = lambda k: ppd.grid_integral(F.transform(p, lambda v: F.pow(v - mean, k)), levels)
    sd = F.sqrt(F.greatest(central(2), F.lit(0.0)))
    low, high = ppd.interval(p, levels, alpha)
    skew = ratio(central(3), F.pow(sd, 3))
    kurt = ratio(central(4), F.pow(sd, 4)) - 3.0
    iqr = q(0.75) - q(0.25)
    gaps = F.zip_with(F.slice(p, 2, len(levels) - 1), F.slice(p, 1, len(levels) - 1), lambda b, a: b - a)
    steps = ppd.literal([b - a for a, b in zip(levels, levels[1:], strict=False)])
    entropy = F.aggregate(F.zip_with(gaps, steps, lambda g, s: s * F.log(F.greatest(g, F.lit(1e-12)) / s)), F.lit(0.0), lambda acc, v: acc + v)
    moors = ratio((q(0.875) - q(0.625)) + (q(0.375) - q(0.125)), q(0.75) - q(0.25))
    return rows.withColumns({
        "ppd_mean": mean, "ppd_sd": sd, "ppd_median": q(0.5), "ppd_iqr": iqr,
        "ppd_bowley": ratio(q(0.75) + q(0.25) - 2.0 * q(0.5), iqr), "ppd_pearson_skew": ratio(3.0 * (mean - q(0.5)), sd),
        "ppd_skew": skew, "ppd_kurtosis": kurt, "ppd_moors": moors, "ppd_bimodality": ratio(skew * skew + 1.0, kurt + 3.0),
        "ppd_entropy": entropy, "ppd_tail_ratio": ratio(q(0.95) - q(0.5), q(0.5) - q(0.05)), "ppd_cv": ratio(sd, F.abs(mean)),
        "interval_lower": low, "interval_upper": high, "interval_width": high - low, "interval_asymmetry": ratio((high - q(0.5)) - (q(0.5) - low), high - low),
    })


def context_statistics(rows: DataFrame, context: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """Size and target shape of the context, and the prediction in its units."""
    v = finite(F.col(y))
    sd = F.stddev_pop(v)
    stats = context.groupBy(*keys).agg(F.count(F.lit(1)).alias("ctx_n"), F.avg(v).alias("ctx_y_mean"), sd.alias("ctx_y_sd"), F.when(sd > 0, F.skewness(v)).alias("ctx_y_skew"), F.when(sd > 0, F.kurtosis(v)).alias("ctx_y_kurtosis"))
    return rows.join(stats, list(keys), "left").withColumns({"ctx_log_n": F.log1p("ctx_n"), "pred_standardised": ratio(F.col("point_pred") - F.col("ctx_y_mean"), F.col("ctx_y_sd"))})


def input_quality(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    n = sum((finite(F.col(c)).isNull().cast("int") if kind not in ("string", "boolean") else F.col(c).isNull().cast("int") for c, kind in rows.select(*columns).dtypes), F.lit(0))
    return rows.withColumns({"n_missing": n, "missing_frac": n / float(len(columns))})


def standardised(rows: DataFrame, context: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns filled with the context's mean and in its units; columns that the context lacks
    everywhere become 0."""
    stats = context.groupBy(*keys).agg(*(f(finite(F.col(c))).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = rows.join(stats, list(keys))
    made = {c: F.coalesce(ratio(F.coalesce(finite(F.col(c)), F.col(f"m_{c}")) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)) for c in columns}
    return out.withColumns(made).drop(*(f"{n}_{c}" for c in columns for n in ("m", "s")))


def _isolation(x_fit: np.ndarray, x: np.ndarray, rng: np.random.Generator, trees: int = 50, sample: int = 128) -> np.ndarray:
    """Isolation scores: 2 to the negative mean path length over its expectation."""

    def expected(n: int) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    total = np.zeros(len(x))
    m = min(sample, len(x_fit))
    limit = int(np.ceil(np.log2(max(m, 2))))
    for _ in range(trees):
        stack = [(x_fit[rng.choice(len(x_fit), m, replace=False)], np.arange(len(x)), 0)]
        while stack:
            own, idx, depth = stack.pop()
            wide = np.flatnonzero(np.ptp(own, 0) > 0) if len(own) > 1 else []
            if depth >= limit or len(own) < 2 or not len(wide):
                total[idx] += depth + expected(len(own))
                continue
            j = int(rng.choice(wide))
            at = rng.uniform(own[:, j].min(), own[:, j].max())
            stack += [(own[own[:, j] <= at], idx[x[idx, j] <= at], depth + 1), (own[own[:, j] > at], idx[x[idx, j] > at], depth + 1)]
    return 2.0 ** (-(total / trees) / max(expected(m), 1e-12))


def _robust_mahalanobis(x_fit: np.ndarray, x: np.ndarray, steps: int = 10) -> np.ndarray:
    """Distances under concentration steps on three quarters of the context."""
    mean = np.median(x_fit, 0)
    cov = np.diag(np.maximum(x_fit.var(0), 1e-6))
    h = max(2, int(np.ceil(0.75 * len(x_fit))))
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", x_fit - mean, np.linalg.pinv(cov), x_fit - mean)
        near = x_fit[np.argsort(d, kind="stable")[:h]]
        mean, cov = near.mean(0), np.cov(near.T, bias=True).reshape(x_fit.shape[1], -1) + 1e-6 * np.eye(x_fit.shape[1])
    return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean), 0))


_DISTANCES = ("knn_1", "knn_5", "knn_10", "knn_5_norm", "local_y_sd", "local_y_range", "density", "mahalanobis", "isolation", "lof")


def distance_features(test: DataFrame, context: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str = "y", seed: int = 0) -> DataFrame:
    """How far each test row lies from its dataset's context; one numpy task a cell of
    the keys, with the distances in blocks."""
    names = list(keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in test.select(*keys, "row_pos").schema)
    # Aliases give both sides columns of their own, as they may come from one table.
    side = lambda df: df.select(*(F.col(k).alias(k) for k in (*keys, "row_pos")), *(F.coalesce(finite(F.col(c)), F.lit(0.0)).alias(c) for c in columns), F.col(y).cast("double").alias("__y"))

    def run(own: pd.DataFrame, ctx: pd.DataFrame) -> pd.DataFrame:
        own, ctx = (x.sort_values("row_pos", kind="stable") for x in (own, ctx))
        out = own[[*names, "row_pos"]].copy()
        if len(ctx) < 3 or not len(own):
            for c in _DISTANCES:
                out[c] = np.nan
            return out
        fit = ctx[list(columns)].to_numpy(float)
        sd = fit.std(0)
        scale = np.where(sd > 1e-12, sd, np.inf)
        mean = fit.mean(0)
        a, b = (own[list(columns)].to_numpy(float) - mean) / scale, (fit - mean) / scale
        k = min(5, len(ctx) - 1)
        order, ranked = nearest(b, a, 10)
        dist = lambda k: ranked[:, :k].mean(1)
        near, inner = nearest(b, b, k, own=True)
        reach_of = inner[:, -1]
        lrd = 1 / np.maximum(np.maximum(inner, reach_of[near]).mean(1), 1e-12)
        mine = order[:, :k]
        own_lrd = 1 / np.maximum(np.maximum(ranked[:, :k], reach_of[mine]).mean(1), 1e-12)
        local = ctx["__y"].to_numpy()[mine]
        typical = max(float(inner.mean()), 1e-12)
        values = (dist(1), dist(5), dist(10), dist(5) / typical, local.std(1), np.ptp(local, 1), 1 / np.maximum(dist(5), 1e-12), _robust_mahalanobis(b, a), _isolation(b, a, np.random.default_rng(seed)), lrd[mine].mean(1) / own_lrd)
        for c, v in zip(_DISTANCES, values, strict=True):
            out[c] = v
        return out

    return side(test).groupBy(*keys).cogroup(side(context).groupBy(*keys)).applyInPandas(run, fields + "".join(f", {c} double" for c in _DISTANCES))


#: Context rows of a dataset that one task holds.
CONTEXT_BLOCK = 1 << 16


def neighbour_join(query: DataFrame, context: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int, own: bool = False) -> DataFrame:
    """The k nearest context rows of each query row within the same dataset, the lower
    ``row_pos`` first where distances are equal; with ``own`` a row is no neighbour of itself.

    The context of a dataset is dealt into blocks of about CONTEXT_BLOCK rows and moves once;
    the queries meet every block, keep k rows of each, and then the best k of those."""
    names = list(keys)
    sizes = context.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CONTEXT_BLOCK).cast("int").alias("__blocks"))
    side = lambda df, p: df.select(*(F.col(c).alias(c) for c in names), F.col("row_pos").cast("long").alias(p), *(F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)))
    asked = side(query, "q_pos").join(sizes, names).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
    known = side(context, "c_pos").join(sizes, names).withColumn("__block", F.pmod(F.xxhash64("c_pos"), F.col("__blocks")).cast("int")).drop("__blocks")
    x = [f"__x{i}" for i in range(len(columns))]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("c_pos", kind="stable")
        many = min(k + own, len(b))
        if not len(a) or not many:
            return pd.DataFrame({c: [] for c in (*names, "q_pos", "c_pos", "distance")})
        row, far = nearest(b[x].to_numpy(float), a[x].to_numpy(float), many)
        out = a[[*names, "q_pos"]].loc[a.index.repeat(many)].reset_index(drop=True)
        out["c_pos"], out["distance"] = b["c_pos"].to_numpy()[row.ravel()], far.ravel()
        return out[out["c_pos"] != out["q_pos"]] if own else out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in query.select(*names).schema)
    found = asked.groupBy(*names, "__block").cogroup(known.groupBy(*names, "__block")).applyInPandas(run, fields + ", q_pos long, c_pos long, distance double")
    best = Window.partitionBy(*names, "q_pos").orderBy("distance", "c_pos")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select(*names, "q_pos", "place", "c_pos", "distance")
