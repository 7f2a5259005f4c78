"""Whether features of instances tell, for datasets never seen, what is covered and how wide
intervals are.

Rows are capped for each dataset and seed, so that large datasets do not outweigh others;
folds hold whole datasets.  One numpy task holds a key's capped rows: 1,000 for each dataset
and seed at most.

Rules: rows with a missing feature, response or dataset are left out, and so are features that do
not vary.  Under two datasets, or without variation of the response, scores are null.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trees
from . import sampling
from .complexity import r2

MOST_ROWS, FOLDS, PERMUTATIONS = 1000, 5, 5
_OUT = "feature string, n_rows long, n_groups long, cv_score double, linear_score double, importance double, importance_sd double, xi double, direction double"


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """The chance that a positive row scores over a negative one, ties half."""
    _, place, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    n = int((y == 1).sum())
    return float((rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))) if 0 < n < len(y) else float("nan")


def chatterjee(x: np.ndarray, y: np.ndarray) -> float:
    """xi of y on x; ties of x keep the order of rows, ties of y are allowed for."""
    n = len(x)
    own = y[np.argsort(x, kind="stable")]
    upto, over = np.searchsorted(np.sort(own), own, "right"), n - np.searchsorted(np.sort(own), own, "left")
    total = 2.0 * float((over * (n - over)).sum())
    return 1 - n * float(np.abs(np.diff(upto)).sum()) / total if total > 0 else float("nan")


def group_folds(groups: np.ndarray, folds: int) -> np.ndarray:
    """Whole groups dealt out, largest first, to the fold with fewest rows."""
    names, own, size = np.unique(groups, return_inverse=True, return_counts=True)
    held, fold = np.zeros(min(folds, len(names)), np.int64), np.zeros(len(names), np.int64)
    for k in np.lexsort((np.arange(len(names)), -size)):
        fold[k] = int(held.argmin())
        held[fold[k]] += size[k]
    return fold[own]


def _linear(x: np.ndarray, y: np.ndarray, test: np.ndarray) -> np.ndarray:
    mean, sd = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    z = (x - mean) / sd
    return (test - mean) / sd @ np.linalg.solve(z.T @ z + np.eye(x.shape[1]), z.T @ (y - y.mean())) + y.mean()


def predictability(rows: DataFrame, keys: Sequence[str], features: Sequence[str], response: str, classes: bool, row_id: str = "row_pos", group: str = "dataset_id", within: Sequence[str] = ("dataset_id", "seed"), most: int | None = MOST_ROWS, seed: int = 0) -> DataFrame:
    """For each key and feature: held-out score of boosted trees (AUC of ``classes``, else R2)
    and of a linear model on all features, what permuting the feature in held-out rows costs,
    xi of the response on it, and the sign of its rank correlation."""
    keys, features = list(keys), list(features)
    own = rows.select(*keys, *(c for c in within if c not in keys), *(c for c in (group, row_id) if c not in (*keys, *within)), *(F.col(f).cast("double").alias(f"__f{k}") for k, f in enumerate(features)), F.col(response).cast("double").alias("__y"))
    if most is not None:
        own = sampling.capped(own, list(dict.fromkeys([*keys, *within])), row_id, most, seed)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        key = {k: part[k].iloc[0] for k in keys}
        part = part.sort_values([group, *[c for c in within if c != group], row_id], kind="stable")
        x, y, g = part[[f"__f{k}" for k in range(len(features))]].to_numpy(float), part["__y"].to_numpy(float), part[group].to_numpy()
        ok = np.isfinite(x).all(1) & np.isfinite(y) & pd.notna(part[group]).to_numpy()
        x, y, g = x[ok], y[ok], g[ok]
        keep = np.flatnonzero(x.std(0) > 1e-10) if len(x) else np.zeros(0, int)
        out = pd.DataFrame({"feature": features, "n_rows": len(y), "n_groups": len(np.unique(g))} | {c: np.nan for c in names[3:]})
        if len(keep) and len(np.unique(g)) > 1 and len(np.unique(y)) > 1:
            x, score = x[:, keep], auc if classes else r2
            fold = group_folds(g, FOLDS)
            guess, plain, draws = np.zeros(len(y)), np.zeros(len(y)), np.zeros((PERMUTATIONS, len(keep), len(y)))
            rng = np.random.default_rng(seed)
            for f in range(fold.max() + 1):
                a, b = fold != f, fold == f
                moved = [x[b]]
                for _ in range(PERMUTATIONS):
                    for j in range(len(keep)):
                        other = x[b].copy()
                        other[:, j] = rng.permutation(other[:, j])
                        moved.append(other)
                made = trees.boosted(x[a], y[a], np.concatenate(moved))[:, 0].reshape(len(moved), -1)
                guess[b], plain[b] = made[0], _linear(x[a], y[a], x[b])
                draws[:, :, b] = made[1:].reshape(PERMUTATIONS, len(keep), -1)
            whole = score(y, guess)
            cost = whole - np.array([[score(y, d) for d in row] for row in draws])
            out["cv_score"], out["linear_score"] = whole, score(y, plain)
            out.loc[keep, "importance"], out.loc[keep, "importance_sd"] = cost.mean(0), cost.std(0)
            out.loc[keep, "xi"] = [chatterjee(c, y) for c in x.T]
            rank = lambda v: pd.Series(v).rank().to_numpy()
            out.loc[keep, "direction"] = [float(np.sign(np.corrcoef(rank(c), rank(y))[0, 1])) for c in x.T]
        return out.assign(**key)[[*keys, *names]]

    return own.groupBy(*keys).applyInPandas(run, f"{fields}, {_OUT}")
