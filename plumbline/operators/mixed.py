"""Linear mixed models with a random intercept a dataset, by restricted likelihood.

For one variance ratio theta the fixed effects have a closed form from sums within
datasets, so a fit is a search over theta alone.  Each (response, ...) group is one task;
its rows are one a dataset and seed or model.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import normal_ppf, normal_sf


@dataclass
class Fit:
    beta: np.ndarray
    cov: np.ndarray
    residual: float
    between: float
    loglik: float
    n: int
    groups: int


def pivoted_columns(x: np.ndarray, tol: float = 1e-8) -> list[int]:
    """Columns that are kept: by pivoted orthogonalisation until what is left vanishes."""
    left, kept = x.astype(float).copy(), []
    start = np.linalg.norm(left, axis=0).max(initial=0.0)
    for _ in range(x.shape[1]):
        norm = np.linalg.norm(left, axis=0)
        norm[kept] = -1.0
        j = int(norm.argmax())
        if norm[j] <= tol * max(start, 1e-300):
            break
        kept.append(j)
        q = left[:, j] / norm[j]
        left = left - np.outer(q, q @ left)
    return sorted(kept)


def design(frame: pd.DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, list[str]]:
    """Features filled by their median with an indicator where values lack, without constants,
    in units of their spread, without collinear ones; an intercept first."""
    made: dict[str, np.ndarray] = {}
    for c in columns:
        v = frame[c].to_numpy(float)
        v = np.where(np.isfinite(v), v, np.nan)
        lacks = np.isnan(v)
        if lacks.all():
            continue
        if lacks.any():
            made[f"{c}__missing"] = lacks.astype(float)
            v = np.where(lacks, np.nanmedian(v), v)
        made[c] = v
    names = [c for c, v in made.items() if v.std() > 1e-12]
    if not names:
        return np.ones((len(frame), 1)), ["intercept"]
    z = np.column_stack([(made[c] - made[c].mean()) / made[c].std() for c in names])
    kept = pivoted_columns(z)
    return np.column_stack((np.ones(len(frame)), z[:, kept])), ["intercept", *(names[k] for k in kept)]


def random_intercept(y: np.ndarray, x: np.ndarray, group: np.ndarray) -> Fit:
    """Restricted maximum likelihood with one random intercept."""
    _, g = np.unique(group, return_inverse=True)
    size = np.bincount(g).astype(float)
    n, p = x.shape
    sx = np.zeros((len(size), p))
    np.add.at(sx, g, x)
    sy = np.bincount(g, y)
    xx, xy, yy = x.T @ x, x.T @ y, float(y @ y)

    def solve(theta: float):
        w = theta / (1 + theta * size)
        a = xx - (sx * w[:, None]).T @ sx
        b = xy - sx.T @ (w * sy)
        c = yy - float((w * sy * sy).sum())
        beta = np.linalg.solve(a, b)
        rss = max(c - float(b @ beta), 1e-300)
        s2 = rss / (n - p)
        ll = -0.5 * ((n - p) * (np.log(2 * np.pi * s2) + 1) + np.log1p(theta * size).sum() + np.linalg.slogdet(a)[1])
        return ll, beta, a, s2

    grid = np.concatenate(([0.0], np.exp(np.linspace(-8, 8, 65))))
    k = int(np.argmax([solve(t)[0] for t in grid]))
    low, high = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    gold = (np.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = high - gold * (high - low), low + gold * (high - low)
        low, high = (low, b) if solve(a)[0] > solve(b)[0] else (a, high)
    theta = (low + high) / 2
    if solve(0.0)[0] >= solve(theta)[0]:
        theta = 0.0
    ll, beta, a, s2 = solve(theta)
    return Fit(beta, s2 * np.linalg.inv(a), s2, theta * s2, ll, n, len(size))


def enough(n: int, groups: int, features: int) -> bool:
    return groups >= max(30, 2 * features) and n >= 2 * groups


_FIT = "feature string, coef double, se double, z double, p double, ci_low double, ci_high double, aic double, bic double, r2_marginal double, r2_conditional double, sigma2 double, tau2 double, n long, n_groups long, status string"


def _rows(fit: Fit, names: list[str], x: np.ndarray) -> list[dict]:
    se = np.sqrt(np.diag(fit.cov))
    z = fit.beta / se
    crit = normal_ppf(0.975)
    k = len(names) + 2
    fixed = float((x @ fit.beta).var())
    total = fixed + fit.between + fit.residual
    shared = {"aic": 2 * k - 2 * fit.loglik, "bic": k * np.log(fit.n) - 2 * fit.loglik, "r2_marginal": fixed / total, "r2_conditional": (fixed + fit.between) / total, "sigma2": fit.residual, "tau2": fit.between, "n": fit.n, "n_groups": fit.groups, "status": "ok"}
    return [{"feature": f, "coef": b, "se": s, "z": t, "p": float(2 * normal_sf(abs(t))), "ci_low": b - crit * s, "ci_high": b + crit * s} | shared for f, b, s, t in zip(names, fit.beta, se, z, strict=True)]


def mixed_model(table: DataFrame, keys: Sequence[str], response: str, features: Sequence[str], group: str = "dataset_id") -> DataFrame:
    """Coefficients of ``response ~ z(features) + (1 | group)`` for each key; groups that are
    too small give one row whose status says so."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*keys).schema)
    columns = [x.split()[0] for x in _FIT.split(", ")]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        y = own["__y"].to_numpy(float)
        own = own[np.isfinite(y)].sort_values([group, *features], kind="stable")
        key = {k: own[k].iloc[0] if len(own) else None for k in keys}
        x, names = design(own, features) if len(own) else (np.ones((0, 1)), ["intercept"])
        groups = own[group].nunique()
        if not enough(len(own), groups, len(names) - 1) or float(own["__y"].std()) < 1e-12:
            out = [{"n": len(own), "n_groups": groups, "status": "insufficient_support"}]
        else:
            out = _rows(random_intercept(own["__y"].to_numpy(float), x, own[group].to_numpy()), names, x)
        made = pd.DataFrame([{"feature": None} | key | r for r in out], columns=[*keys, *columns])
        return made.astype({c: "float64" for c in columns if c not in ("feature", "n", "n_groups", "status")} | {"feature": "object"})

    own = table.select(*keys, F.col(response).cast("double").alias("__y"), *features, *([group] if group not in (*keys, *features) else []))
    return own.groupBy(*keys).applyInPandas(run, f"{fields}, {_FIT}" if fields else _FIT)


def cross_model(table: DataFrame, keys: Sequence[str], response: str, feature: str, group: str = "dataset_id") -> DataFrame:
    """One model over all predictors: dummies and interactions of ``model`` with one feature;
    each model's effect and its slope beta + gamma with the variance of the sum."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*keys).schema)
    columns = ["model", "effect", "slope", "slope_se", "p", "n", "status"]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own[np.isfinite(own["__y"]) & np.isfinite(own["__x"])].sort_values(["model", group, "__x"], kind="stable")
        key = {k: own[k].iloc[0] if len(own) else None for k in keys}
        models = sorted(own["model"].unique())
        if not enough(len(own), own[group].nunique(), 2 * len(models)) or own["__x"].std() < 1e-12:
            out = [{"n": len(own), "status": "insufficient_support"}]
        else:
            z = ((own["__x"] - own["__x"].mean()) / own["__x"].std(ddof=0)).to_numpy()
            dummy = np.column_stack([(own["model"] == m).to_numpy(float) for m in models[1:]]) if len(models) > 1 else np.zeros((len(own), 0))
            x = np.column_stack((np.ones(len(own)), z, dummy, dummy * z[:, None]))
            fit = random_intercept(own["__y"].to_numpy(float), x, own[group].to_numpy())
            out, m = [], len(models) - 1
            for k, name in enumerate(models):
                pick = np.zeros(x.shape[1])
                pick[1] = 1.0
                if k:
                    pick[1 + m + k] = 1.0
                slope, se = float(pick @ fit.beta), float(np.sqrt(pick @ fit.cov @ pick))
                out.append({"model": name, "effect": float(fit.beta[0] + (fit.beta[1 + k] if k else 0.0)), "slope": slope, "slope_se": se, "p": float(2 * normal_sf(abs(slope / se))), "n": fit.n, "status": "ok"})
        return pd.DataFrame([{"model": None} | key | r for r in out], columns=[*keys, *columns]).astype({c: "float64" for c in ("effect", "slope", "slope_se", "p")} | {"model": "object"})

    own = table.select(*keys, "model", F.col(response).cast("double").alias("__y"), F.col(feature).cast("double").alias("__x"), group)
    schema = "model string, effect double, slope double, slope_se double, p double, n long, status string"
    return own.groupBy(*keys).applyInPandas(run, f"{fields}, {schema}" if fields else schema)
