"""How hard a dataset is: cross-validated linear and boosted scores, the least tree that reaches
a target, shrunken trees, and mutual information.  One numpy task a dataset; the caller caps
rows (10,000 in the definition, see ``most_rows``).

Rules: rows with a missing feature or target are left out.  What cannot be computed for
lack of rows (20 for scores, 10 for trees, 4 for mutual information) or for a constant target is
null.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mutual, trees

TARGET, MOST_DEPTH = 0.8, 30
REGRESSION = ("linear_r2", "nonlinear_r2", "complexity_ratio", "snr", "tree_target_met", "tree_min_depth", "tree_terminal_nodes", "tree_achieved_r2")
CLASSIFICATION = ("linear_acc", "nonlinear_acc", "complexity_ratio", "linear_acc_norm", "nonlinear_acc_norm", "complexity_ratio_norm", "tree_target_met", "tree_min_depth", "tree_terminal_nodes", "tree_achieved_acc", "tree_achieved_acc_norm")
SHRUNKEN = ("hs_dof", "hs_dof_frac", "hs_shrinkage", "hs_leaves", "hs_cv_score", "hs_log_loss", "hs_vs_prior")
INFORMATION = ("mi_mean", "mi_max", "mi_entropy", "mi_entropy_norm", "gini_mi", "ns_ratio", "mi_norm")
#: Columns under this part of the largest information count as noise.
NOISE = 0.05


def per_dataset(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str, names: Sequence[str], compute: Callable[[np.ndarray, np.ndarray], dict], most_rows: int | None = None) -> DataFrame:
    """One row a dataset of what ``compute`` makes of its complete rows."""
    keys = list(keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["__h", *columns, "__y"], kind="stable")
        x, t = own[list(columns)].to_numpy(float), own["__y"].to_numpy(float)
        ok = np.isfinite(x).all(1) & np.isfinite(t)
        made = dict.fromkeys(names) | compute(x[ok], t[ok])
        return pd.DataFrame([{k: own[k].iloc[0] for k in keys} | made]).astype({k: "float64" for k in names})

    own = rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns), F.col(y).cast("double").alias("__y"), F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in (*columns, y)))).alias("__h"))
    if most_rows is not None:
        order = Window.partitionBy(*keys).orderBy("__h", *columns, "__y")
        own = own.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most_rows).drop("__k")
    return own.groupBy(*keys).applyInPandas(run, fields + "".join(f", {k} double" for k in names))


def _standard(x: np.ndarray) -> np.ndarray:
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd > 1e-12, sd, 1.0)


def r2(y: np.ndarray, guess: np.ndarray) -> float:
    total = float(((y - y.mean()) ** 2).sum())
    return 1 - float(((y - guess) ** 2).sum()) / total if total > 0 else float("nan")


def balanced_accuracy(y: np.ndarray, guess: np.ndarray) -> float:
    return float(np.mean([(guess[y == c] == c).mean() for c in np.unique(y)]))


def shuffled_folds(n: int, k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(np.arange(n) % k)


def _plain_folds(n: int) -> np.ndarray:
    """Consecutive parts: five, or a tenth of the rows, and three of few rows."""
    k = min(5, n // 10) if n >= 50 else 3
    return np.arange(n) * k // n


def _ridge(x: np.ndarray, y: np.ndarray, test: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    mean, centre = x.mean(0), y.mean(0)
    z = x - mean
    return (test - mean) @ np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - centre)) + centre


def _logistic(x: np.ndarray, hot: np.ndarray, test: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Margins of a softmax regression with a unit ridge, by accelerated gradient steps."""
    a, b = np.column_stack((x, np.ones(len(x)))), np.column_stack((test, np.ones(len(test))))
    step = 1.0 / (0.5 * np.linalg.norm(a, 2) ** 2 + 1.0)
    w = ahead = np.zeros((a.shape[1], hot.shape[1]))
    t = 1.0
    for _ in range(rounds):
        z = a @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        slope = a.T @ (p / p.sum(1, keepdims=True) - hot)
        slope[:-1] += ahead[:-1]
        new, t2 = ahead - step * slope, (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return b @ w


def least_tree(x: np.ndarray, y: np.ndarray, score: Callable[[np.ndarray, np.ndarray], float], seed: int = 0) -> tuple[float, float, float, float]:
    """(met, depth, leaves, score): the least depth at which trees reach TARGET on held-out
    folds.  One tree a fold is grown to full depth, and its first levels are the shorter ones."""
    fold = shuffled_folds(len(y), min(5, len(y) // 2), seed)
    target = y.reshape(len(y), -1)
    scores = np.zeros((fold.max() + 1, MOST_DEPTH))
    for f in range(fold.max() + 1):
        tree = trees.cart(x[fold != f], target[fold != f], MOST_DEPTH)
        last = 0.0
        for d, guess in enumerate(trees.by_depth(tree, x[fold == f])):
            last = score(target[fold == f], guess)
            if d:
                scores[f, d - 1] = last
        scores[f, max(int(tree.depth.max()) - 1, 0) :] = last
    mean = scores.mean(0)
    reached = np.flatnonzero(mean >= TARGET)
    depth = int(reached[0]) + 1 if len(reached) else MOST_DEPTH
    whole = trees.cart(x, target, depth)
    return float(len(reached) > 0), float(depth), float(trees.leaves(whole, depth)), float(mean[depth - 1])


def _tree_r2(y: np.ndarray, guess: np.ndarray) -> float:
    return r2(y[:, 0], guess[:, 0])


def _tree_accuracy(hot: np.ndarray, guess: np.ndarray) -> float:
    return balanced_accuracy(hot.argmax(1), guess.argmax(1))


def regression_complexity(x: np.ndarray, y: np.ndarray, seed: int = 0) -> dict:
    out: dict = {}
    if len(y) < 10 or y.std() <= 1e-10:
        return out
    x = _standard(x)
    if len(y) >= 20:
        fold = _plain_folds(len(y))
        parts = [(fold != f, fold == f) for f in range(fold.max() + 1)]
        linear = float(np.mean([r2(y[b], _ridge(x[a], y[a], x[b])) for a, b in parts]))
        boosted = float(np.mean([r2(y[b], trees.boosted(x[a], y[a], x[b])[:, 0]) for a, b in parts]))
        best = max(boosted, 0.0)
        out |= {"linear_r2": linear, "nonlinear_r2": boosted, "complexity_ratio": boosted / max(linear, 0.01), "snr": best / max(1 - best, 0.01)}
    return out | dict(zip(REGRESSION[4:], least_tree(x, y, _tree_r2, seed), strict=True))


def classification_complexity(x: np.ndarray, y: np.ndarray, seed: int = 0) -> dict:
    names, code = np.unique(y, return_inverse=True)
    out: dict = {}
    if len(y) < 10 or len(names) < 2:
        return out
    x, hot, chance = _standard(x), np.eye(len(names))[code], 1 / len(names)
    above = lambda a: (a - chance) / (1 - chance)
    if len(y) >= 20:
        # Stratified: consecutive parts of each class.
        fold = np.empty(len(y), np.int64)
        k = int(_plain_folds(len(y)).max()) + 1
        for c in range(len(names)):
            own = np.flatnonzero(code == c)
            fold[own] = np.arange(len(own)) * k // len(own)
        parts = [(fold != f, fold == f) for f in range(k)]
        linear = float(np.mean([balanced_accuracy(code[b], _logistic(x[a], hot[a], x[b]).argmax(1)) for a, b in parts]))
        boosted = float(np.mean([balanced_accuracy(code[b], trees.boosted(x[a], hot[a], x[b], classes=True).argmax(1)) for a, b in parts]))
        out |= {"linear_acc": linear, "nonlinear_acc": boosted, "complexity_ratio": boosted / max(linear, 0.01), "linear_acc_norm": above(linear), "nonlinear_acc_norm": above(boosted), "complexity_ratio_norm": above(boosted) / max(above(linear), 0.01)}
    met, depth, leaves, score = least_tree(x, hot, _tree_accuracy, seed)
    return out | {"tree_target_met": met, "tree_min_depth": depth, "tree_terminal_nodes": leaves, "tree_achieved_acc": score, "tree_achieved_acc_norm": above(score)}


def _shrunken(tree: trees.Cart, size: np.ndarray, shrink: float) -> np.ndarray:
    """Node values shrunk towards their ancestors': each step down counts N / (N + shrink)."""
    value = tree.value.copy()
    for k in np.flatnonzero(tree.feature >= 0):
        for child in (tree.left[k], tree.left[k] + 1):
            value[child] = value[k] + (tree.value[child] - tree.value[k]) / (1 + shrink / size[k])
    return value


def shrunken_tree(x: np.ndarray, y: np.ndarray, classes: bool, seed: int = 0, shrinks: Sequence[float] = (0.1, 1.0, 10.0, 50.0, 100.0, 500.0)) -> dict:
    """A hierarchically shrunken tree: the shrinkage with the best held-out score, degrees of
    freedom of its leaves, and for classes the log loss beside that of the class shares."""
    n = len(y)
    if n < 20 or len(np.unique(y)) < 2:
        return {}
    x = _standard(x)
    target = np.eye(len(np.unique(y)))[np.unique(y, return_inverse=True)[1]] if classes else y.reshape(-1, 1)
    fold, depth = shuffled_folds(n, 3, seed), max(2, int(np.log2(max(5, int(n**0.5)))) + 1)

    def grown(a: np.ndarray):
        tree = trees.cart(x[a], target[a], depth, least=max(1, n // 200))
        node = np.zeros(int(a.sum()), np.int64)
        size = np.zeros(len(tree.feature))
        for _ in range(int(tree.depth.max()) + 1):
            np.add.at(size, node, 1)
            inner = np.flatnonzero(tree.feature[node] >= 0)
            at = node[inner]
            if not len(inner):
                break
            moved = tree.left[at] + (x[a][inner, tree.feature[at]] > tree.cut[at])
            node = moved
            a = _narrowed(a, inner)
        return tree, size

    def loss(t: np.ndarray, guess: np.ndarray) -> float:
        return float(-np.log(np.clip((t * guess).sum(1), 1e-12, 1)).mean()) if classes else float(((t - guess) ** 2).mean())

    errors, prior = np.zeros(len(shrinks)), 0.0
    for f in range(3):
        tree, size = grown(fold != f)
        prior += loss(target[fold == f], np.tile(tree.value[0], (int((fold == f).sum()), 1)))
        for k, shrink in enumerate(shrinks):
            own = tree._replace(value=_shrunken(tree, size, shrink))
            *_, guess = trees.by_depth(own, x[fold == f])
            errors[k] += loss(target[fold == f], guess)
    k = int(errors.argmin())
    tree, size = grown(np.ones(n, bool))
    at_leaf = size[tree.feature < 0]
    dof = float((at_leaf / (at_leaf + shrinks[k])).sum())
    out = {"hs_dof": dof, "hs_dof_frac": dof / n, "hs_shrinkage": shrinks[k] / n, "hs_leaves": float(len(at_leaf)), "hs_cv_score": 1 - float(errors[k] / prior) if prior > 0 else None}
    return out | ({"hs_log_loss": float(errors[k] / 3), "hs_vs_prior": float((prior - errors[k]) / 3)} if classes else {})


def _narrowed(mask: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The rows of a mask that are still on their way down."""
    out = np.zeros(len(mask), bool)
    out[np.flatnonzero(mask)[inner]] = True
    return out


def target_information(x: np.ndarray, y: np.ndarray, classes: bool) -> dict:
    """Nearest-neighbour mutual information of the columns with the target: mean, largest, entropy
    and concentration of their shares, the part of columns that are noise beside the best one,
    and with classes the mean over H(Y)."""
    if len(y) < 4 or len(np.unique(y)) < 2:
        return {}
    mi = np.array([mutual.with_class(c, y) if classes else mutual.with_number(c, y) for c in x.T])
    mean, total = float(mi.mean()), float(mi.sum())
    share = mi[mi > 0] / total if total > 0 else mi[:0]
    ranked, n = np.sort(mi), len(mi)
    gini = float((2 * np.arange(1, n + 1) - n - 1) @ ranked / (n * total)) if total > 0 else 0.0
    entropy = float(-(share * np.log(share)).sum())
    out = {"mi_mean": mean, "mi_max": float(mi.max()), "mi_entropy": entropy, "mi_entropy_norm": entropy / float(np.log(n)) if n > 1 else None, "gini_mi": gini, "ns_ratio": float((mi < NOISE * max(mi.max(), 1e-10)).mean())}
    p = np.unique(y, return_counts=True)[1] / len(y)
    return out | ({"mi_norm": mean / float(-(p * np.log(p)).sum())} if classes else {})


def complexity(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str = "y", classes: bool = False, most_rows: int | None = None) -> DataFrame:
    """REGRESSION or CLASSIFICATION of each dataset."""
    return per_dataset(rows, keys, columns, y, CLASSIFICATION if classes else REGRESSION, classification_complexity if classes else regression_complexity, most_rows)


def shrinkage(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str = "y", classes: bool = False, most_rows: int | None = None) -> DataFrame:
    """SHRUNKEN of each dataset; the last two are null for numbers."""
    return per_dataset(rows, keys, columns, y, SHRUNKEN, lambda x, t: shrunken_tree(x, t, classes), most_rows)


def information(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str = "y", classes: bool = False, most_rows: int | None = None) -> DataFrame:
    """INFORMATION of each dataset; mi_norm is null for numbers."""
    return per_dataset(rows, keys, columns, y, INFORMATION, lambda x, t: target_information(x, t, classes), most_rows)
