"""Predictive distributions: an array column of quantiles over shared, increasing levels.

The levels are a short list of plain numbers, so interpolation weights are worked out
once, and each function is an expression that stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CDF values stay this far from 0 and 1 (double-precision epsilon).
EPS = 2.220446049250313e-16


def quantile_grid(step: float = 0.005) -> list[float]:
    """The open grid step, 2*step, ... below 1, rounded to 12 places."""
    if not 0 < step < 0.5:
        raise ValueError("step must lie between 0 and 0.5")
    levels = []
    k = 1
    while round(k * step, 12) < 1.0 - 1e-12:
        levels.append(round(k * step, 12))
        k += 1
    if len(levels) < 2:
        raise ValueError("a grid needs two levels at least")
    return levels


def literal(levels: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(q)) for q in levels))


def monotone(ppd: Column) -> Column:
    """The running maximum along the levels."""
    start = F.struct(F.lit(None).cast("double").alias("top"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        top = F.greatest(acc["top"], x)
        return F.struct(top.alias("top"), F.array_append(acc["out"], top).alias("out"))

    return F.aggregate(ppd, start, step, lambda acc: acc["out"])


def crosses(ppd: Column) -> Column:
    """Whether some quantile is below the one before it."""
    later = F.slice(ppd, 2, F.greatest(F.size(ppd) - 1, F.lit(0)))
    return F.exists(F.zip_with(ppd, later, lambda a, b: b - a), lambda d: F.coalesce(d < 0, F.lit(False)))


def quantile_at(ppd: Column, levels: Sequence[float], q: float) -> Column:
    """Linear between levels, constant beyond the ends."""
    if q <= levels[0]:
        return ppd[0]
    if q >= levels[-1]:
        return ppd[len(levels) - 1]
    for k, level in enumerate(levels):
        if abs(level - q) < 1e-12:
            return ppd[k]
        if level > q:
            w = (q - levels[k - 1]) / (level - levels[k - 1])
            return ppd[k - 1] * (1.0 - w) + ppd[k] * w
    raise ValueError("levels must increase")


def interval(ppd: Column, levels: Sequence[float], alpha: float) -> tuple[Column, Column]:
    return quantile_at(ppd, levels, alpha / 2), quantile_at(ppd, levels, 1 - alpha / 2)


def _weighted_sum(values: Column, weights: Sequence[float]) -> Column:
    products = F.zip_with(values, literal(weights), lambda v, w: v * w)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def trapezoid_weights(levels: Sequence[float]) -> list[float]:
    gaps = [b - a for a, b in zip(levels, levels[1:], strict=False)]
    return [(g0 + g1) / 2 for g0, g1 in zip([0.0, *gaps], [*gaps, 0.0], strict=True)]


def grid_integral(values: Column, levels: Sequence[float]) -> Column:
    """The trapezoid integral over the levels with constant tails to 0 and 1."""
    weights = trapezoid_weights(levels)
    weights[0] += levels[0]
    weights[-1] += 1 - levels[-1]
    return _weighted_sum(values, weights)


def mean(ppd: Column, levels: Sequence[float]) -> Column:
    return grid_integral(ppd, levels)


def variance(ppd: Column, levels: Sequence[float]) -> Column:
    """The second central moment of the grid, 0 at least."""
    return F.greatest(grid_integral(F.transform(ppd, lambda v: v * v), levels) - F.pow(mean(ppd, levels), 2), F.lit(0.0))


def crps(ppd: Column, levels: Sequence[float], y: Column) -> Column:
    """Twice the trapezoid integral of pinball losses over the grid, without tails."""
    losses = F.zip_with(ppd, literal(levels), lambda v, q: F.when(y >= v, q * (y - v)).otherwise((q - 1.0) * (y - v)))
    return _weighted_sum(losses, trapezoid_weights(levels)) * 2.0


def cdf_at(ppd: Column, levels: Sequence[float], y: Column) -> Column:
    """The level of ``y``: linear between quantiles, the middle of a plateau that equals it,
    and EPS away from 0 and 1."""
    grid = literal(levels)
    below = F.size(F.filter(ppd, lambda v: v < y))
    upto = F.size(F.filter(ppd, lambda v: v <= y))
    n = len(levels)
    low, high = F.get(ppd, below - 1), F.get(ppd, below)
    level_low, level_high = F.get(grid, below - 1), F.get(grid, below)
    between = level_low + (level_high - level_low) * F.try_divide(y - low, high - low)
    plateau = (F.get(grid, below) + F.get(grid, upto - 1)) * 0.5
    raw = F.when(upto > below, plateau).when(below == 0, F.lit(float(levels[0]))).when(below == n, F.lit(float(levels[-1]))).otherwise(between)
    return F.least(F.greatest(raw, F.lit(EPS)), F.lit(1.0 - EPS))
