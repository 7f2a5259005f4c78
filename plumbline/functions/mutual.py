"""Mutual information by nearest neighbours, in nats."""

from __future__ import annotations

import numpy as np


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function for positive numbers."""
    x, out = np.asarray(x, float).copy(), 0.0
    for _ in range(6):
        small = x < 6
        out = out - np.where(small, 1 / x, 0.0)
        x = np.where(small, x + 1, x)
    z = 1 / x**2
    return out + np.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))


def _reach(x: np.ndarray, k: int) -> np.ndarray:
    """The distance to the k-th other number, for each of several on a line."""
    order = np.argsort(x, kind="stable")
    v = x[order]
    n = len(v)
    out = np.full(n, np.inf)
    # The k nearest form a window of k + 1 neighbours on the line that holds the number.
    for back in range(k + 1):
        first, last = np.arange(n) - back, np.arange(n) - back + k
        ok = (first >= 0) & (last < n)
        own = np.flatnonzero(ok)
        out[own] = np.minimum(out[own], np.maximum(v[own] - v[first[own]], v[last[own]] - v[own]))
    back = np.empty(n)
    back[order] = out
    return back


def _within(x: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Numbers of ``x`` nearer than ``reach`` to each of ``at``, by the differences themselves:
    a sum of place and reach may be rounded to the other side of a number."""
    v = np.sort(x)
    n = len(v)
    low, high = np.searchsorted(v, at - reach, "left"), np.searchsorted(v, at + reach, "right")
    for _ in range(2):
        edge = v[np.minimum(low, n - 1)]
        low = np.where((low < n) & (at - edge >= reach) & (edge <= at), np.searchsorted(v, edge, "right"), low)
        edge = v[np.maximum(high - 1, 0)]
        high = np.where((high > 0) & (edge - at >= reach) & (edge >= at), np.searchsorted(v, edge, "left"), high)
    edge = v[np.maximum(low - 1, 0)]
    low = np.where((low > 0) & (at - edge < reach), np.searchsorted(v, edge, "left"), low)
    edge = v[np.minimum(high, n - 1)]
    high = np.where((high < n) & (edge - at < reach), np.searchsorted(v, edge, "right"), high)
    return np.maximum(high - low, 0)


def with_number(x: np.ndarray, y: np.ndarray, k: int = 3, block: int = 1 << 22) -> float:
    """Of two continuous columns: by the distance to the k-th neighbour in the larger of both
    differences, and the neighbours nearer than that in each column."""
    n = len(x)
    if n <= k or x.std() == 0 or y.std() == 0:
        return 0.0
    x, y = x / x.std(), y / y.std()
    reach = np.empty(n)
    step = max(1, block // n)
    for a in range(0, n, step):
        far = np.maximum(np.abs(x[a : a + step, None] - x), np.abs(y[a : a + step, None] - y))
        reach[a : a + step] = np.partition(far, k, 1)[:, k]
    counts = [np.maximum(_within(v, v, reach), 1) for v in (x, y)]
    return max(0.0, float(digamma(np.array(n)) + digamma(np.array(k)) - sum(digamma(c).mean() for c in counts)))


def with_class(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Of a continuous column and a class: by the distance to the k-th neighbour of the same
    class, and the neighbours nearer than that of any class.  Classes of one row are left out."""
    if x.std() == 0:
        return 0.0
    x = x / x.std()
    reach, own, size = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for c in np.unique(y):
        mine = np.flatnonzero(y == c)
        if len(mine) > 1:
            size[mine], own[mine] = len(mine), min(k, len(mine) - 1)
            reach[mine] = _reach(x[mine], min(k, len(mine) - 1))
    used = size > 0
    if not used.any():
        return 0.0
    x, reach, own, size = x[used], reach[used], own[used], size[used]
    near = np.maximum(_within(x, x, reach), 1)
    return max(0.0, float(digamma(np.array(len(x))) + digamma(own).mean() - digamma(size).mean() - digamma(near).mean()))
