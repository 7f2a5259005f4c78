"""Predictors behind one small interface, and importances from them.

Large pretrained models stay outside: their predictions enter through tables.  What is
fitted here are library learners on DataFrames, or small numpy models in grouped tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import trees


class Predictor(Protocol):
    """Rows with ``ppd`` (or ``proba``) and ``point_pred`` for test rows, from train rows."""

    def fit_predict(self, train: DataFrame, test: DataFrame, features: Sequence[str], y: str) -> DataFrame: ...


@dataclass
class ResidualQuantiles:
    """A library regressor whose distribution is its prediction plus train residual quantiles."""

    levels: Sequence[float]
    kind: str = "forest"
    params: dict = field(default_factory=dict)

    def fit_predict(self, train: DataFrame, test: DataFrame, features: Sequence[str], y: str) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

        learner = {"forest": RandomForestRegressor, "boosted": GBTRegressor, "linear": LinearRegression}[self.kind]
        to_vector = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep")
        seed = {} if self.kind == "linear" else {"seed": 0}
        model = learner(featuresCol="__x", labelCol=y, predictionCol="point_pred", **seed, **self.params).fit(to_vector.transform(train))
        fitted = model.transform(to_vector.transform(train))
        q = fitted.agg(F.percentile(F.col(y) - F.col("point_pred"), F.array(*(F.lit(float(v)) for v in self.levels))).alias("q")).first()["q"]
        out = model.transform(to_vector.transform(test)).drop("__x")
        return out.withColumn("ppd", F.array(*(F.col("point_pred") + float(v) for v in q)))


@dataclass
class QuantileForest:
    """Extremely randomised trees for each cell of ``keys``, one task a cell; the distribution of a
    row has the quantiles of its trees' predictions, the point prediction is their mean."""

    levels: Sequence[float]
    keys: Sequence[str] = ()
    trees: int = 30
    least: int = 5
    seed: int = 0

    def fit_predict(self, train: DataFrame, test: DataFrame, features: Sequence[str], y: str) -> DataFrame:
        names, x, levels = list(test.columns), list(features), list(self.levels)
        keys = list(self.keys) or ["__one"]
        if not self.keys:
            train, test = train.withColumn("__one", F.lit(1)), test.withColumn("__one", F.lit(1))
        schema = T.StructType([*(f for f in test.schema.fields if f.name in names), T.StructField("ppd", T.ArrayType(T.DoubleType())), T.StructField("point_pred", T.DoubleType())])

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = b[names].copy()
            xa, ya, xb = a[x].to_numpy(float), a["__y"].to_numpy(float), b[x].to_numpy(float)
            ok = np.isfinite(ya)
            if not ok.any():
                return out.assign(ppd=None, point_pred=np.nan)
            middle = np.array([np.median(c[np.isfinite(c)]) if np.isfinite(c).any() else 0.0 for c in xa[ok].T])
            xa, xb = (np.where(np.isfinite(v), v, middle) for v in (xa[ok], xb))
            each = trees.each_tree(trees.forest(xa, ya[ok], self.trees, self.least, self.seed), xb)
            out["ppd"], out["point_pred"] = list(np.quantile(each, levels, axis=1).T), each.mean(1)
            return out

        # Rows in an order of their own, so that draws fall alike.
        own = train.select(*(F.col(c).alias(c) for c in (*keys, *x)), F.col(y).cast("double").alias("__y"))
        other = test.select(*(F.col(c).alias(c) for c in test.columns))
        return own.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(lambda a, b: run(a.sort_values([*x, "__y"], kind="stable"), b), schema)


#: Names to builders; add to it to plug in a predictor.
PREDICTORS: dict[str, Callable[..., Predictor]] = {"trees": lambda levels, **p: QuantileForest(levels, **p), "forest": lambda levels, **p: ResidualQuantiles(levels, "forest", p), "boosted": lambda levels, **p: ResidualQuantiles(levels, "boosted", p), "linear": lambda levels, **p: ResidualQuantiles(levels, "linear", p)}


def draws_to_quantiles(draws: DataFrame, keys: Sequence[str], levels: Sequence[float], value: str = "draw") -> DataFrame:
    """Posterior draws, one a row, to ``ppd`` and ``point_pred``."""
    return draws.groupBy(*keys).agg(F.percentile(value, F.array(*(F.lit(float(q)) for q in levels))).alias("ppd"), F.avg(value).alias("point_pred"))


# --------------------------------------------------------------------------- small models
def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    mean, centre = x.mean(0), y.mean()
    z = x - mean
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - centre))
    return beta, float(centre - mean @ beta)


def boosted_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.1, bins: int = 16) -> list[tuple]:
    """Depth-two trees on binned features, least squares."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    out, left = [("base", float(y.mean()))], y - y.mean()

    def split(idx: np.ndarray):
        best = (1e-12, None, 0.0)
        t = left[idx]
        for j, e in enumerate(edges):
            for v in e:
                side = x[idx, j] <= v
                n = side.sum()
                if 0 < n < len(idx):
                    s = t[side].sum()
                    gain = s * s / n + (t.sum() - s) ** 2 / (len(idx) - n) - t.sum() ** 2 / len(idx)
                    if gain > best[0]:
                        best = (gain, j, v)
        return best

    for _ in range(rounds):
        gain, j, v = split(np.arange(len(y)))
        if j is None:
            break
        parts, used = [], [(j, gain)]
        for low in (True, False):
            idx = np.flatnonzero((x[:, j] <= v) == low)
            g2, j2, v2 = split(idx)
            if j2 is None:
                parts.append((None, 0.0, float(left[idx].mean()), 0.0))
            else:
                side = x[idx, j2] <= v2
                parts.append((j2, float(v2), float(left[idx][side].mean()), float(left[idx][~side].mean())))
                used.append((j2, g2))
        tree = ("tree", j, float(v), parts, used)
        out.append(tree)
        left = left - rate * _tree(tree, x)
    return out


def _tree(tree: tuple, x: np.ndarray) -> np.ndarray:
    _, j, v, parts, _ = tree
    low = x[:, j] <= v
    leaf = [np.full(len(x), p[2]) if p[0] is None else np.where(x[:, p[0]] <= p[1], p[2], p[3]) for p in parts]
    return np.where(low, leaf[0], leaf[1])


def predict_trees(model: list[tuple], x: np.ndarray, rate: float = 0.1) -> np.ndarray:
    return model[0][1] + rate * sum((_tree(t, x) for t in model[1:]), np.zeros(len(x)))


def gains(model: list[tuple], d: int) -> np.ndarray:
    out = np.zeros(d)
    for t in model[1:]:
        for j, g in t[4]:
            out[j] += g
    return out / out.sum() if out.sum() > 0 else out


def contributions(model: list[tuple], x: np.ndarray, background: np.ndarray, rate: float = 0.1) -> np.ndarray:
    """Shapley values of trees of two features at most: for each tree the value function over
    subsets of its features is averaged over the background, and weighed exactly."""
    out = np.zeros(x.shape)

    def mean_with(tree: tuple, fixed: tuple[int, ...]) -> np.ndarray:
        total = np.zeros(len(x))
        for row in background:
            mixed = np.tile(row, (len(x), 1))
            mixed[:, list(fixed)] = x[:, list(fixed)]
            total += _tree(tree, mixed)
        return total / len(background)

    from itertools import combinations
    from math import factorial

    for tree in model[1:]:
        own = sorted({tree[1], *(p[0] for p in tree[3] if p[0] is not None)})
        n = len(own)
        value = {s: mean_with(tree, s) for k in range(n + 1) for s in combinations(own, k)}
        for j in own:
            rest = [i for i in own if i != j]
            for k in range(n):
                for s in combinations(rest, k):
                    w = factorial(k) * factorial(n - k - 1) / factorial(n)
                    out[:, j] += rate * w * (value[tuple(sorted((*s, j)))] - value[s])
    return out


def _filled(x: np.ndarray) -> np.ndarray:
    """Missing values as their column's median, 0 where there is none."""
    out = x.copy()
    for j in range(x.shape[1]):
        there = np.isfinite(x[:, j])
        out[~there, j] = np.median(x[there, j]) if there.any() else 0.0
    return out


def _fold_of(groups: np.ndarray, k: int) -> np.ndarray:
    names = np.unique(groups)
    return (np.searchsorted(names, groups) % min(k, len(names))).astype(int)


def r2(y: np.ndarray, p: np.ndarray) -> float:
    total = float(((y - y.mean()) ** 2).sum())
    return 1 - float(((y - p) ** 2).sum()) / total if total > 0 else float("nan")


_IMPORTANCE = "feature string, gain double, permutation double, shap double, shap_direction double, cv_r2 double, n long"


def tree_importance(table: DataFrame, keys: Sequence[str], response: str, features: Sequence[str], group: str = "dataset_id", folds: int = 5, least: int = 30, background: int = 16, seed: int = 0) -> DataFrame:
    """Boosted trees with folds by dataset: gain, permutation loss and Shapley size of each
    feature on held-out rows, with the direction of its effect."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*keys).schema)
    columns = [c.split()[0] for c in _IMPORTANCE.split(", ")]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own[np.isfinite(own["__y"].to_numpy(float))].sort_values([group, *features], kind="stable")
        key = {k: own[k].iloc[0] if len(own) else None for k in keys}
        x, y = own[list(features)].to_numpy(float), own["__y"].to_numpy(float)
        x = _filled(x)
        d, n = len(features), len(y)
        if n < least or own[group].nunique() < 2 or y.std() < 1e-12:
            rows = [{"feature": f, "n": n} for f in features]
        else:
            fold, rng = _fold_of(own[group].to_numpy(), folds), np.random.default_rng(seed)
            gain, lost, shap, held = np.zeros(d), np.zeros(d), np.zeros((n, d)), np.zeros(n)
            for f in range(fold.max() + 1):
                a, b = fold != f, fold == f
                model = boosted_trees(x[a], y[a])
                held[b] = predict_trees(model, x[b])
                gain += gains(model, d) * b.mean()
                base = ((y[b] - held[b]) ** 2).mean()
                for j in range(d):
                    mixed = x[b].copy()
                    mixed[:, j] = rng.permutation(mixed[:, j])
                    lost[j] += (((y[b] - predict_trees(model, mixed)) ** 2).mean() - base) * b.mean()
                shap[b] = contributions(model, x[b], x[a][rng.choice(a.sum(), min(background, a.sum()), replace=False)])
            rank = lambda v: np.argsort(np.argsort(v, kind="stable"), kind="stable").astype(float)
            sign = [float(np.corrcoef(rank(x[:, j]), rank(shap[:, j]))[0, 1]) if x[:, j].std() > 0 and shap[:, j].std() > 0 else None for j in range(d)]
            score = r2(y, held)
            rows = [{"feature": f, "gain": gain[j], "permutation": lost[j], "shap": float(np.abs(shap[:, j]).mean()), "shap_direction": sign[j], "cv_r2": score, "n": n} for j, f in enumerate(features)]
        return pd.DataFrame([key | r for r in rows], columns=[*keys, *columns]).astype({c: "float64" for c in columns if c not in ("feature", "n")})

    own = table.select(*keys, *([group] if group not in keys else []), F.col(response).cast("double").alias("__y"), *(F.col(f).cast("double").alias(f) for f in features))
    return own.groupBy(*keys).applyInPandas(run, f"{fields}, {_IMPORTANCE}")


def univariate_forest(table: DataFrame, keys: Sequence[str], response: str, features: Sequence[str], group: str = "dataset_id", folds: int = 5, least: int = 30) -> DataFrame:
    """Cross-validated R2 of a forest of extremely randomised trees on each feature alone, with
    whole groups held out."""
    ids = list(dict.fromkeys([*keys, group]))
    long = table.select(*ids, F.col(response).cast("double").alias("__y"), *(F.col(f).cast("double").alias(f) for f in features)).unpivot([*ids, "__y"], list(features), "feature", "__x")
    names = [*keys, "feature"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.select(*names).schema)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        key = {k: own[k].iloc[0] for k in names}
        own = own[np.isfinite(own["__y"]) & np.isfinite(own["__x"])].sort_values([group, "__x", "__y"], kind="stable")
        score = None
        if len(own) >= least and own[group].nunique() > 1 and own["__x"].std() > 1e-12:
            x, y, fold = own[["__x"]].to_numpy(float), own["__y"].to_numpy(float), _fold_of(own[group].to_numpy(), folds)
            held = np.zeros(len(y))
            for f in range(fold.max() + 1):
                held[fold == f] = trees.mean_of(trees.forest(x[fold != f], y[fold != f]), x[fold == f])[:, 0]
            score = r2(y, held)
        return pd.DataFrame([key | {"cv_r2": score, "n": len(own)}]).astype({"cv_r2": "float64"})

    return long.groupBy(*names).applyInPandas(run, fields + ", cv_r2 double, n long")


def group_comparison(table: DataFrame, keys: Sequence[str], response: str, groups: dict[str, Sequence[str]], group: str = "dataset_id") -> DataFrame:
    """Cross-validated R2 of each feature group side by side, one row a key."""
    out = None
    for name, features in groups.items():
        each = tree_importance(table, keys, response, features, group).groupBy(*keys).agg(F.first("cv_r2").alias(f"r2_{name}"))
        out = each if out is None else out.join(each, list(keys))
    return out


def fold_transform(train: np.ndarray, test: np.ndarray, most: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Medians for what is missing, an indicator column for each column that misses a value in
    ``train``, ranks among at most ``most`` quantiles, unit variance; all learned from ``train``."""
    gone = ~np.isfinite(train)
    middle = np.array([np.median(c[~g]) if not g.all() else 0.0 for c, g in zip(train.T, gone.T, strict=True)])
    marked = gone.any(0)

    def filled(x: np.ndarray) -> np.ndarray:
        bad = ~np.isfinite(x)
        return np.column_stack((np.where(bad, middle, x), bad[:, marked].astype(float)))

    a, b = filled(train), filled(test)
    share = np.linspace(0, 1, min(most, len(train)))
    edges = np.quantile(a, share, axis=0)

    def ranked(x: np.ndarray) -> np.ndarray:
        # The middle of the places a tied value could have.
        up = np.column_stack([np.interp(c, e, share) for c, e in zip(x.T, edges.T, strict=True)])
        down = np.column_stack([-np.interp(-c, -e[::-1], -share[::-1]) for c, e in zip(x.T, edges.T, strict=True)])
        return (up + down) / 2

    a, b = ranked(a), ranked(b)
    sd = a.std(0)
    scale = np.where(sd > 1e-12, sd, 1.0)
    return (a - a.mean(0)) / scale, (b - a.mean(0)) / scale


def ridge_path(x: np.ndarray, y: np.ndarray, test: np.ndarray, alphas: Sequence[float]) -> np.ndarray:
    """Predictions of ridge regressions by alpha, from one decomposition."""
    mean, centre = x.mean(0), y.mean(0)
    u, s, v = np.linalg.svd(x - mean, full_matrices=False)
    ty, tx = u.T @ (y - centre), (test - mean) @ v.T
    return np.stack([tx @ ((s / (s * s + a))[:, None] * ty) + centre for a in alphas])


ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)


def _nested_alphas(x: np.ndarray, v: np.ndarray, seed: int, alphas: Sequence[float]) -> tuple[float, float]:
    """The ridge penalties of the shift and of the differences with least error on three inner folds."""
    fold = np.random.default_rng(seed).permutation(np.arange(len(v)) % 3)
    loss = np.zeros((2, len(alphas)))
    for f in range(3):
        a, b = fold != f, fold == f
        za, zb = fold_transform(x[a], x[b])
        centred, held = v[a] - v[a].mean(0), v[b] - v[a].mean(0)
        for k, (t, h) in enumerate(zip(_parts_of(centred), _parts_of(held), strict=True)):
            guess = ridge_path(za, t, zb, alphas)
            loss[k] += ((guess - h) ** 2).sum((1, 2))
    return tuple(alphas[k] for k in loss.argmin(1))


def _parts_of(centred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shift that models share and their differences, which sum to zero."""
    shift = centred.mean(1, keepdims=True)
    return shift, centred - shift


_HELD = "learner string, repeat int, fold int, dataset_id long, observed_shared double, predicted_shared double, shared_loss double, shared_zero_loss double, differential_loss double, differential_zero_loss double"


def component_prediction(panel: DataFrame, features: DataFrame, names: Sequence[str], learners: Sequence[str] = ("ridge", "extra_trees"), repeats: int = 5, folds: int = 5, n_trees: int = 100, alphas: Sequence[float] = ALPHAS, seed: int = 4100) -> DataFrame:
    """Held-out predictions of each dataset's shared shift and its models' differences from its
    features: a row for each learner, repeat and dataset.  Means over datasets, penalties and
    transforms come from the training folds alone.

    Each repeat of a learner is a task of one row a dataset, as wide as there are models;
    datasets that lack a model are left out."""
    wide = features.groupBy(F.col("dataset_id").cast("long").alias("dataset_id")).agg(*(F.avg(n).alias(n) for n in names))
    rows = panel.select(F.col("dataset_id").cast("long").alias("dataset_id"), "model", "value").join(wide, "dataset_id")
    runs = rows.withColumn("learner", F.explode(F.array(*map(F.lit, learners)))).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        learner, repeat = own["learner"].iloc[0], int(own["repeat"].iloc[0])
        table = own.pivot_table(index="dataset_id", columns="model", values="value").dropna().sort_index()
        if len(table) < 2 * folds:
            return pd.DataFrame(columns=[c.split()[0] for c in _HELD.split(", ")])
        x = own.drop_duplicates("dataset_id").set_index("dataset_id").loc[table.index, list(names)].to_numpy(float)
        v = table.to_numpy(float)
        fold = np.random.default_rng(seed + repeat).permutation(np.arange(len(v)) % folds)
        out = []
        for f in range(folds):
            a, b = fold != f, fold == f
            za, zb = fold_transform(x[a], x[b])
            base = v[a].mean(0)
            (qa, ha), (qb, hb) = _parts_of(v[a] - base), _parts_of(v[b] - base)
            if learner == "ridge":
                own_alphas = _nested_alphas(x[a], v[a], seed + repeat, alphas)
                q, h = (ridge_path(za, t, zb, [alpha])[0] for t, alpha in zip((qa, ha), own_alphas, strict=True))
            else:
                q, h = (trees.mean_of(trees.forest(za, t, n_trees, 4, 2 * seed + repeat, 0.7), zb) for t in (qa, ha))
            h = h - h.mean(1, keepdims=True)
            out.append(pd.DataFrame({"learner": learner, "repeat": repeat, "fold": f, "dataset_id": table.index[b], "observed_shared": qb[:, 0], "predicted_shared": q[:, 0], "shared_loss": (qb - q)[:, 0] ** 2, "shared_zero_loss": qb[:, 0] ** 2, "differential_loss": ((hb - h) ** 2).mean(1), "differential_zero_loss": (hb**2).mean(1)}))
        return pd.concat(out)

    return runs.groupBy("learner", "repeat").applyInPandas(run, _HELD)


def component_gains(held: DataFrame, keys: Sequence[str] = ("learner",)) -> DataFrame:
    """keys, repeat, component, gain, n_datasets: what is gained over predicting nothing."""
    parts = [F.struct(F.lit(c).alias("component"), (1.0 - F.sum(f"{c}_loss") / F.nullif(F.sum(f"{c}_zero_loss"), F.lit(0.0))).alias("gain")) for c in ("shared", "differential")]
    made = held.groupBy(*keys, "repeat").agg(F.array(*parts).alias("parts"), F.count(F.lit(1)).alias("n_datasets"))
    return made.select(*keys, "repeat", "n_datasets", F.explode("parts").alias("p")).select(*keys, "repeat", "p.component", "p.gain", "n_datasets")


def component_summary(gains: DataFrame, keys: Sequence[str] = ("learner",)) -> DataFrame:
    """Mean and standard deviation of gains over repeats, and the number of datasets."""
    return gains.groupBy(*keys, "component").agg(F.avg("gain").alias("mean_gain"), F.stddev_samp("gain").alias("sd_gain"), F.min_by("n_datasets", "repeat").alias("n_datasets"))


def grid_search(train: DataFrame, features: Sequence[str], y: str, grid: Sequence[dict], folds: int = 3, seed: int = 0) -> tuple[dict, list[float]]:
    """The best parameters of a boosted regressor by cross-validation, and all errors."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import CrossValidator

    data = VectorAssembler(inputCols=list(features), outputCol="__x").transform(train)
    learner = GBTRegressor(featuresCol="__x", labelCol=y, seed=seed)
    maps = [{learner.getParam(k): v for k, v in own.items()} for own in grid]
    found = CrossValidator(estimator=learner, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol=y), numFolds=folds, seed=seed).fit(data)
    return dict(grid[int(np.argmin(found.avgMetrics))]), list(found.avgMetrics)
