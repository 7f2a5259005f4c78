"""Exact nearest rows of numpy matrices, in blocks of distinct points."""

from __future__ import annotations

import numpy as np

#: Distances that are held at once.
BLOCK = 1 << 22


def nearest(fit: np.ndarray, x: np.ndarray, k: int, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance) of the ``k`` rows of ``fit`` nearest to each row of ``x``; the earlier row
    where distances are equal.  ``own``: ``x`` is ``fit``, and no row is its own neighbour.

    Equal rows are one point, so memory grows with the block and not with rows by rows.
    """
    n, k = len(fit), min(k, len(fit) - own)
    if k < 1 or not len(x):
        return np.zeros((len(x), max(k, 0)), np.int64), np.zeros((len(x), max(k, 0)))
    many = k + own
    points, at, count = np.unique(fit, axis=0, return_inverse=True, return_counts=True)
    asked, of = (points, at) if own else np.unique(x, axis=0, return_inverse=True)
    by_point, start = np.argsort(at.ravel(), kind="stable"), np.cumsum(count) - count
    some = np.minimum(count, many)
    rows, far = np.zeros((len(asked), many), np.int64), np.zeros((len(asked), many))
    step = max(1, BLOCK // len(points))
    for a in range(0, len(asked), step):
        block = asked[a : a + step]
        d2 = np.zeros((len(block), len(points)))
        for j in range(fit.shape[1]):
            d2 += (block[:, j, None] - points[None, :, j]) ** 2
        reach = np.partition(d2, many - 1, 1)[:, many - 1, None] if many <= len(points) else np.inf
        q, p = np.nonzero(d2 <= reach)
        times = some[p]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, query, dist = by_point[np.repeat(start[p], times) + within], np.repeat(q, times), np.repeat(d2[q, p], times)
        order = np.lexsort((row, dist, query))
        first = np.searchsorted(query[order], np.arange(len(block)))
        take = order[first[:, None] + np.arange(many)]
        rows[a : a + step], far[a : a + step] = row[take], np.sqrt(dist[take])
    rows, far = rows[of.ravel()], far[of.ravel()]
    if own:
        other = rows != np.arange(n)[:, None]
        other[other.all(1), -1] = False
        rows, far = rows[other].reshape(n, k), far[other].reshape(n, k)
    return rows, far
