"""Conformal methods whose calibration is weighted by nearness; grouped numpy.

A cell is one (dataset, seed, model); its rows fit a task, but not a matrix of all their pairs:
weights are summed by ``functions.kernels``.  Kernels are Gaussian in standardised features.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ppd
from ..functions.kernels import HELD, Places, Running, effective_sizes, kernel, median_squared_distance, own_sums, squared_distances


def standardise(fit: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """By the mean and population spread of ``fit``; constant columns become 0."""
    mean, sd = fit.mean(0), fit.std(0)
    sd = np.where(sd > 1e-12, sd, np.inf)
    return [(x - mean) / sd for x in (fit, *others)]


def bandwidth_for(x: np.ndarray, target: float) -> float:
    """The bandwidth whose effective size meets the target, by bisection."""
    size = effective_sizes(x)
    low, high = 1e-3, 1e3
    for _ in range(60):
        mid = np.sqrt(low * high)
        # A wider kernel spreads weights, so its effective size grows.
        low, high = (mid, high) if size(mid) < target else (low, mid)
    return float(np.sqrt(low * high))


def median_bandwidth(x: np.ndarray) -> float:
    d2 = median_squared_distance(x)
    return float(np.sqrt(d2)) if d2 > 0 else 1.0


def weighted_quantile(values: np.ndarray, weights: np.ndarray, q: float) -> np.ndarray:
    """For each row of weights the least value whose cumulative share reaches q; rows without
    weight take the plain quantile."""
    order = np.argsort(values, kind="stable")
    w = weights[:, order]
    total = w.sum(1, keepdims=True)
    w = np.where(total > 0, np.divide(w, total, out=np.zeros_like(w), where=total > 0), 1.0 / max(1, len(values)))
    at = (np.cumsum(w, 1) >= q - 1e-12).argmax(1)
    return values[order][at]


def calibrated_local(s: np.ndarray, x_cal: np.ndarray, x_test: np.ndarray, bandwidth: float, alpha: float) -> np.ndarray:
    """The largest feasible threshold of each test point when its own score joins the
    calibration: for every candidate threshold, the kernel-weighted ranks of all rows are
    compared with that of the test row, whose share of as extreme ranks must pass alpha."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    s, x_cal = s[order], x_cal[order]
    wanted = next(c for c in range(n + 1) if (1 + c) / (n + 1) > alpha)
    if not wanted:
        return np.full(len(x_test), np.inf)
    if not np.isfinite(x_cal).all():
        return np.full(len(x_test), -np.inf)
    base, total = own_sums(x_cal, bandwidth)
    # The test row weighs 0 to 1, so a rank lies between these; the rank that ``wanted`` rows reach, too.
    least, most = base / (total + 1), (base + 1) / (total + 1)
    sure, never = (np.partition(r, n - wanted)[n - wanted] for r in (least, most))
    sure, never = sure - 1e-11, never + 1e-11
    always = least >= never
    unsure = np.flatnonzero(~always & (most >= sure - 1e-11))

    # Candidate j is just under s[j]: rows i >= j lie above it, rows below j under it.  The test row's
    # rank grows with j and the other ranks fall, so that feasible candidates come first.
    places = Places(x_test)
    run = Running(places, x_cal, bandwidth)

    def last_at_most(rank: float) -> tuple[np.ndarray, np.ndarray]:
        top = (rank + 1e-12) * (run.total + 1) - 1
        at, before = run.reach(np.nextafter(top, np.inf))
        return np.where(top >= 0, at, -1), np.where(top >= 0, before, 0.0)

    low, start = last_at_most(sure)
    high, _ = last_at_most(never)
    high = np.maximum(low, high)
    left = np.flatnonzero(high > low)
    left = left[np.argsort((high - low)[left], kind="stable")]
    while len(left):
        # As many as fit a block with the widest of them.
        widths = high[left] - np.maximum(low[left], 0) + 1
        fit = np.flatnonzero((widths + len(unsure)) * np.arange(1, len(left) + 1) > HELD // 4)
        rows, left = np.split(left, [max(1, int(fit[0])) if len(fit) else len(left)])
        first, x = np.maximum(low[rows], 0), places.x[rows]
        at = np.minimum(first[:, None] + np.arange((high[rows] - first).max()), n - 1)
        own = sum(((x_cal[at, k] - x[:, k, None]) ** 2 for k in range(x.shape[1])), np.zeros(at.shape))
        own = np.concatenate((start[rows, None], start[rows, None] + np.cumsum(kernel(own, bandwidth), 1)), 1)
        w = kernel(squared_distances(x, x_cal[unsure]), bandwidth)
        under, over = base[unsure] / (total[unsure] + w), (base[unsure] + w) / (total[unsure] + w)
        a, b = low[rows], high[rows]
        while (a < b).any():
            j = (a + b + 1) // 2
            rank = (own[np.arange(len(rows)), np.maximum(j - first, 0)] + 1) / (run.total[rows] + 1)
            reached = np.where(unsure >= j[:, None], over, under) >= rank[:, None] - 1e-12
            feasible = always.sum() + reached.sum(1) >= wanted
            a, b = np.where(feasible & (a < b), j, a), np.where(feasible | (a >= b), b, j - 1)
        low[rows] = a
    return np.concatenate((s, [np.inf, -np.inf]))[low][places.of]


def randomly_local(s: np.ndarray, x_cal: np.ndarray, x_test: np.ndarray, bandwidth: float, alpha: float, rng: np.random.Generator) -> np.ndarray:
    """Weights are centred at a perturbed copy of the test point; its own weight sits at infinity."""
    centre = x_test + bandwidth * rng.standard_normal(x_test.shape)
    own = kernel(((centre - x_test) ** 2).sum(1), bandwidth)
    order = np.argsort(s, kind="stable")
    run = Running(centre, x_cal[order], bandwidth)
    place, _ = run.reach((1 - alpha - 1e-12) * (run.total + own))
    return np.append(s[order], np.inf)[place]


def local_quantile(s: np.ndarray, x: np.ndarray, at: np.ndarray, bandwidth: float, q: float) -> np.ndarray:
    """``weighted_quantile`` of the scores for each row of ``at``, by kernel weights."""
    order = np.argsort(s, kind="stable")
    places = Places(at)
    run = Running(places, x[order], bandwidth)
    place, _ = run.reach((q - 1e-12) * run.total)
    plain = weighted_quantile(s, np.ones((1, len(s))), q)
    return np.where(run.total > 0, s[order][np.minimum(place, len(s) - 1)], plain)[places.of]


def smoothed_local(s_fit: np.ndarray, x_fit: np.ndarray, s_cal: np.ndarray, x_cal: np.ndarray, x_test: np.ndarray, bandwidth: float, alpha: float) -> np.ndarray:
    """A kernel-weighted score quantile fitted on one part, corrected on the other."""
    q_cal, q_test = (local_quantile(s_fit, x_fit, x, bandwidth, 1 - alpha) for x in (x_cal, x_test))
    left = np.sort(s_cal - q_cal)
    k = int(np.ceil((len(left) + 1) * (1 - alpha) - 1e-9))
    return q_test + (left[k - 1] if k <= len(left) else np.inf)


def posterior_mixture(s_fit: np.ndarray, x_fit: np.ndarray, s_cal: np.ndarray, x_cal: np.ndarray, x_test: np.ndarray, alpha: float, clusters: int, precision: int, rng: np.random.Generator) -> np.ndarray:
    """Weights from posterior memberships, after the published posterior conformal method: soft
    clusters of the features are fitted on one part; a test point's membership is drawn
    ``precision`` times, and calibration rows weigh by the likelihood of those draws under
    their own memberships; the point's own weight sits at infinity."""
    k = min(clusters, len(x_fit))
    centre = x_fit[rng.choice(len(x_fit), k, replace=False)]
    for _ in range(25):
        near = squared_distances(x_fit, centre).argmin(1)
        centre = np.stack([x_fit[near == c].mean(0) if (near == c).any() else centre[c] for c in range(k)])
    spread = max(float(squared_distances(x_fit, centre).min(1).mean()), 1e-12)

    def membership(x: np.ndarray) -> np.ndarray:
        d2 = squared_distances(x, centre)
        p = np.exp(-(d2 - d2.min(1, keepdims=True)) / (2 * spread))
        return np.clip(p / p.sum(1, keepdims=True), 1e-12, None)

    log_cal, p_test = np.log(membership(x_cal)), membership(x_test)
    drawn = rng.multinomial(precision, p_test / p_test.sum(1, keepdims=True))
    own = (drawn * np.log(p_test)).sum(1)
    order = np.argsort(s_cal, kind="stable")
    s_cal, log_cal = s_cal[order], log_cal[order]
    # Test rows with the same draws have the same weights, and only their own weights differ.
    drawn, of = np.unique(drawn, axis=0, return_inverse=True)
    of = of.reshape(-1)
    by = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[by], np.arange(len(drawn) + 1))
    at = np.empty(len(x_test), np.int64)
    for d, start, end in zip(drawn, ends[:-1], ends[1:], strict=True):
        log_w = log_cal @ d
        top = log_w.max()
        run = np.cumsum(np.exp(log_w - top))
        rows = by[start:end]
        at[rows] = np.searchsorted(run, (1 - alpha - 1e-12) * (run[-1] + np.exp(np.minimum(own[rows] - top, 700.0))))
    return np.append(s_cal, np.inf)[at]


class Cell(NamedTuple):
    """What a method sees of a cell: scores and features of the rows that fit and calibrate, and
    the test rows' features."""

    s_fit: np.ndarray
    x_fit: np.ndarray
    s_cal: np.ndarray
    x_cal: np.ndarray
    x_test: np.ndarray


def _pooled(cell: Cell) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Scores and features of all rows before the test, and a bandwidth that leaves a quarter of them."""
    x, test = standardise(np.concatenate((cell.x_fit, cell.x_cal)), cell.x_test)
    return np.concatenate((cell.s_fit, cell.s_cal)), x, test, bandwidth_for(x, max(2.0, len(x) / 4)) if len(x) > 4 else 1.0


def _cal_lcp(cell: Cell, alpha: float, rng: np.random.Generator, **_) -> np.ndarray:
    s, x, test, h = _pooled(cell)
    return calibrated_local(s, x, test, h, alpha)


def _cal_wcp(cell: Cell, alpha: float, rng: np.random.Generator, **_) -> np.ndarray:
    """Fixed weights around each test row: the least score whose weighted share, the test row's
    own weight counted as endless, reaches the level."""
    s, x, test, h = _pooled(cell)
    order = np.argsort(s, kind="stable")
    places = Places(test)
    run = Running(places, x[order], h)
    place, _ = run.reach((1 - alpha - 1e-12) * (run.total + 1.0))
    return np.append(s[order], np.inf)[place][places.of]


def _rlcp(cell: Cell, alpha: float, rng: np.random.Generator, **_) -> np.ndarray:
    s, x, test, h = _pooled(cell)
    return randomly_local(s, x, test, h, alpha, rng)


def _apart(cell: Cell) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    return standardise(cell.x_fit, cell.x_cal, cell.x_test) if len(cell.x_fit) >= 2 and len(cell.x_cal) else None


def _slcp(cell: Cell, alpha: float, rng: np.random.Generator, share: float | None = None, **_) -> np.ndarray:
    """``share``: a bandwidth that leaves this part of the fitting rows, instead of their median distance."""
    if (x := _apart(cell)) is None:
        return np.full(len(cell.x_test), np.inf)
    h = median_bandwidth(x[0]) if share is None else bandwidth_for(x[0], max(2.0, share * len(x[0])))
    return smoothed_local(cell.s_fit, x[0], cell.s_cal, x[1], x[2], h, alpha)


def _pcp(cell: Cell, alpha: float, rng: np.random.Generator, clusters: int = 4, precision: int = 20, **_) -> np.ndarray:
    if (x := _apart(cell)) is None:
        return np.full(len(cell.x_test), np.inf)
    return posterior_mixture(cell.s_fit, x[0], cell.s_cal, x[1], x[2], alpha, clusters, precision, rng)


#: Names to functions of (cell, alpha, rng, options) that give a threshold for each test row; add
#: to it to plug in a method.
METHODS: dict[str, Callable[..., np.ndarray]] = {"CalLCP": _cal_lcp, "CalWCP": _cal_wcp, "RLCP": _rlcp, "SLCP": _slcp, "PCP": _pcp}


def local_conformal(rows: DataFrame, keys: Sequence[str], levels: Sequence[float], alpha: float, features: Sequence[str], method: str, seed: int = 20260929, **options) -> DataFrame:
    """lower, upper and threshold of the test rows by a localised method on absolute scores."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    threshold = METHODS[method]
    base = rows.withColumn("mu", ppd.mean(F.col("ppd"), levels)).select(*keys, "role", "row_pos", "y", "mu", *features)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select(*keys, "row_pos", "y", "mu").schema)
    names = list(keys)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("row_pos", kind="stable")
        part = {r: cell[cell["role"] == r] for r in ("train", "cal", "test")}
        test = part["test"]
        x = {r: p[list(features)].to_numpy(float) for r, p in part.items()}
        s = {r: (p["y"] - p["mu"]).abs().to_numpy(float) for r, p in part.items()}
        rng = np.random.default_rng(np.random.SeedSequence([seed, len(cell)]))
        t = threshold(Cell(s["train"], x["train"], s["cal"], x["cal"], x["test"]), alpha, rng, **options)
        out = test[[*names, "row_pos", "y", "mu"]].copy()
        out["threshold"] = np.maximum(t, 0.0)
        return out

    made = base.groupBy(*keys).applyInPandas(run, fields + ", threshold double")
    return made.select(*keys, "row_pos", "y", F.lit(float(alpha)).alias("alpha"), (F.col("mu") - F.col("threshold")).alias("lower"), (F.col("mu") + F.col("threshold")).alias("upper"), "threshold").withColumn("empty_set", F.col("lower") > F.col("upper"))
