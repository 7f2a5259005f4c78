"""Gaussian kernel weights between many rows, without a matrix of all pairs.

Equal rows are one place with a count.  Where the places fill a good part of the grid of their
columns' values, a kernel over all of them is a product of kernels over single columns, so that
sums over places are small matrix products; elsewhere pairs are gone through in blocks.  Both
are exact up to rounding.
"""

from __future__ import annotations

from math import prod

import numpy as np

#: Numbers that a block holds.
HELD = 1 << 21
#: A grid is used if it has at most so many times the places.
SPARSE = 8
#: Rows between two bounds of which no sums are kept; bounds at once where they cost a product each.
FINE, BOUNDS = 256, 16


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def kernel(d2: np.ndarray, bandwidth: float) -> np.ndarray:
    return np.exp(-d2 / (2 * bandwidth * bandwidth))


def blocks(n: int, width: int):
    """Ranges of rows that hold at most HELD numbers at this width."""
    step = max(1, HELD // max(1, width))
    return ((k, min(n, k + step)) for k in range(0, n, step))


class Places:
    """The distinct rows of a matrix: ``x``, their ``count``, and the place ``of`` each row."""

    def __init__(self, x: np.ndarray):
        self.axes, codes = [], []
        self.of = np.zeros(len(x), np.int64)
        for column in x.T:
            values, code = np.unique(column, return_inverse=True)
            self.axes.append(values)
            codes.append(code)
            self.of = np.unique(self.of * len(values) + code, return_inverse=True)[1]
        self.count = np.bincount(self.of).astype(float)
        first = np.zeros(len(self.count), np.int64)
        first[self.of[::-1]] = np.arange(len(x))[::-1]
        self.x, self.shape = x[first], tuple(map(len, self.axes))
        self.grid = prod(self.shape) <= SPARSE * len(self.count)
        self.cell = np.zeros(len(first), np.int64)
        if self.grid:
            for code, size in zip(codes, self.shape, strict=True):
                self.cell = self.cell * size + code[first]

    def __len__(self) -> int:
        return len(self.count)


def _by_axis(a: np.ndarray, b: np.ndarray, bandwidth: float) -> np.ndarray:
    return kernel((a[:, None] - b[None, :]) ** 2, bandwidth)


def sums(left: Places | np.ndarray, right: Places, weights: np.ndarray, bandwidth: float) -> np.ndarray:
    """For each place or row of ``left`` the kernel-weighted sums of the columns of ``weights``, which has
    a row for each place of ``right``."""
    x, width = left.x if isinstance(left, Places) else left, weights.shape[1]
    out = np.empty((len(x), width))
    if not right.grid:
        for a, b in blocks(len(x), len(right)):
            out[a:b] = kernel(squared_distances(x[a:b], right.x), bandwidth) @ weights
    elif isinstance(left, Places) and left.grid:
        near = [_by_axis(a, b, bandwidth) for a, b in zip(left.axes, right.axes, strict=True)]
        for a, b in blocks(width, prod(map(max, zip(left.shape, right.shape, strict=True)))):
            cube = np.zeros((prod(right.shape), b - a))
            cube[right.cell] = weights[:, a:b]
            cube = cube.reshape(*right.shape, b - a)
            for k, one in enumerate(near):
                cube = np.moveaxis(np.tensordot(one, cube, (1, k)), 0, k)
            out[:, a:b] = cube.reshape(-1, b - a)[left.cell]
    else:
        longest = int(np.argmax(right.shape))
        cube = np.zeros((prod(right.shape), width))
        cube[right.cell] = weights
        cube = np.ascontiguousarray(np.moveaxis(cube.reshape(*right.shape, width), longest, 0)).reshape(right.shape[longest], -1)
        for a, b in blocks(len(x), cube.shape[1]):
            rest = np.ones((b - a, 1))
            for k in (k for k in range(len(right.shape)) if k != longest):
                rest = (rest[:, :, None] * _by_axis(x[a:b, k], right.axes[k], bandwidth)[:, None, :]).reshape(b - a, -1)
            made = _by_axis(x[a:b, longest], right.axes[longest], bandwidth) @ cube
            out[a:b] = np.matmul(rest[:, None, :], made.reshape(b - a, -1, width))[:, 0]
    return out


class Running:
    """Kernel weights of the rows or places ``left`` over the rows ``x``, summed in the order of ``x``:
    ``total`` is the sum over all, and ``upto`` has those up to each of ``bounds``."""

    def __init__(self, left: Places | np.ndarray, x: np.ndarray, bandwidth: float):
        self.left, self.x, self.bandwidth, self.places = left, x, bandwidth, Places(x)
        self.rows = left.x if isinstance(left, Places) else left
        self.cheap = self.places.grid and isinstance(left, Places) and left.grid
        kept = max(BOUNDS, 2 * HELD // max(1, len(left), len(self.places))) if self.cheap else BOUNDS
        self.bounds = np.linspace(0, len(x), min(kept, -(-len(x) // FINE) or 1) + 1).astype(np.int64)
        self.upto = self._upto(None, self.bounds)
        self.total = self.upto[:, -1]

    def _upto(self, rows: np.ndarray | None, bounds: np.ndarray) -> np.ndarray:
        left, n = self.left if rows is None else self.rows[rows], len(bounds) - 1
        part = np.repeat(np.arange(n), np.diff(bounds))
        of, right = self.places.of[bounds[0] : bounds[-1]], self.places
        if not right.grid and len(of) < len(self.x):
            right = Places(self.x[bounds[0] : bounds[-1]])
            of = right.of
        weights = np.bincount(of * n + part, minlength=len(right) * n).reshape(-1, n).astype(float)
        made = np.zeros((len(left), n + 1))
        if len(of):
            np.cumsum(sums(left, right, weights, self.bandwidth), 1, out=made[:, 1:])
        return made

    def reach(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first row at which each sum reaches its target, or how many there are if none does, and
        the sum before it."""
        at, before = np.full(len(self.rows), len(self.x)), self.total.copy()
        some = np.flatnonzero(self.total >= target) if len(self.x) else np.zeros(0, np.int64)
        self._descend(some, self.bounds, self.upto[some], target, at, before)
        return at, before

    def _descend(self, rows: np.ndarray, bounds: np.ndarray, upto: np.ndarray, target: np.ndarray, at: np.ndarray, before: np.ndarray) -> None:
        last = len(bounds) - 2
        # What rounding leaves short of its target is in the last part.
        part = np.minimum((upto[:, 1:] < target[rows, None]).sum(1), last)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(last + 2))
        for k in np.flatnonzero(np.diff(ends)):
            own = order[ends[k] : ends[k + 1]]
            low, high, own_rows, start = bounds[k], bounds[k + 1], rows[own], upto[own, k]
            if self.cheap or high - low <= 4 * FINE:
                self._within(own_rows, low, high, start, target, at, before)
            else:
                finer = np.linspace(low, high, min(BOUNDS, -(-(high - low) // FINE)) + 1).astype(np.int64)
                self._descend(own_rows, finer, start[:, None] + self._upto(own_rows, finer), target, at, before)

    def _within(self, rows: np.ndarray, low: int, high: int, start: np.ndarray, target: np.ndarray, at: np.ndarray, before: np.ndarray) -> None:
        for a, b in blocks(len(rows), high - low):
            own = rows[a:b]
            run = start[a:b, None] + np.cumsum(kernel(squared_distances(self.rows[own], self.x[low:high]), self.bandwidth), 1)
            place = np.minimum((run < target[own, None]).sum(1), high - low - 1)
            at[own] = low + place
            before[own] = np.where(place > 0, run[np.arange(b - a), place - 1], start[a:b])


def own_sums(x: np.ndarray, bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row the summed weights of the rows up to it, itself included, and of all rows."""
    places = Places(x)
    base, total = np.empty(len(x)), np.empty(len(x))
    if not places.grid:
        for a, b in blocks(len(x), len(x)):
            near = kernel(squared_distances(x[a:b], x), bandwidth)
            base[a:b], total[a:b] = np.tril(near, a).sum(1), near.sum(1)
        return base, total
    run = Running(places, x, bandwidth)
    for k, (low, high) in enumerate(zip(run.bounds[:-1], run.bounds[1:], strict=True)):
        for a, b in blocks(high - low, high - low):
            near = kernel(squared_distances(x[low + a : low + b], x[low:high]), bandwidth)
            base[low + a : low + b] = run.upto[places.of[low + a : low + b], k] + np.tril(near, a).sum(1)
    return base, run.total[places.of]


def effective_sizes(x: np.ndarray):
    """A function from a bandwidth to n over the squared norm of the row-normalised kernel of the rows, less one."""
    places = Places(x)
    count, n = places.count, len(places)
    held = squared_distances(places.x, places.x) if not places.grid and n * n <= HELD else None

    def size(bandwidth: float) -> float:
        if places.grid:
            # The square of a kernel is the kernel of a narrower band.
            total, square = (sums(places, places, count[:, None], h)[:, 0] for h in (bandwidth, bandwidth / np.sqrt(2)))
        else:
            total, square = np.empty(n), np.empty(n)
            for a, b in blocks(n, n):
                near = kernel(squared_distances(places.x[a:b], places.x) if held is None else held[a:b], bandwidth)
                total[a:b] = near @ count
                square[a:b] = np.square(near, out=near) @ count
        norm = float((count * np.divide(square, total * total, out=np.zeros(n), where=total > 0)).sum())
        return len(x) / norm - 1 if norm > 0 else 0.0

    return size


def median_squared_distance(x: np.ndarray) -> float:
    """The median over all pairs of rows, by counts of the leading bits of the distances."""
    places, n = Places(x), len(x)
    pairs = n * (n - 1) // 2

    def each():
        for a, b in blocks(len(places), len(places)):
            d2 = squared_distances(places.x[a:b], places.x[a:]) + 0.0
            weight = np.triu(places.count[a:b, None] * places.count[None, a:], 1)
            same = np.arange(b - a)
            d2[same, same], weight[same, same] = 0.0, places.count[a:b] * (places.count[a:b] - 1) / 2
            keep = np.arange(d2.shape[1])[None, :] >= same[:, None]
            yield d2[keep].view(np.int64), weight[keep]

    def select(rank: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Distances and weights of a few near this rank, and the weight below them."""
        prefix, shift, under = 0, 64, 0.0
        while True:
            bits = min(20, shift)
            shift -= bits
            weights, numbers = np.zeros(1 << bits), np.zeros(1 << bits, np.int64)
            for key, weight in each():
                own = slice(None) if shift + bits == 64 else (key >> (shift + bits)) == prefix
                digit = (key[own] >> shift) & ((1 << bits) - 1)
                weights += np.bincount(digit, weight[own], 1 << bits)
                numbers += np.bincount(digit, minlength=1 << bits)
            upto = np.cumsum(weights) + under
            digit = int((upto <= rank).sum())
            prefix, under = prefix << bits | digit, upto[digit] - weights[digit]
            if numbers[digit] <= HELD or not shift:
                break
        found, by = np.zeros(0, np.int64), np.zeros(0)
        for key, weight in each():
            own = (key >> shift) == prefix
            found, at = np.unique(np.concatenate((found, key[own])), return_inverse=True)
            by = np.bincount(at, np.concatenate((by, weight[own])), len(found))
        return found.view(float), np.cumsum(by) + under, under

    if not pairs or not np.isfinite(x).all():
        return float("nan")
    low, high = (pairs - 1) // 2, pairs // 2
    values, upto, _ = select(low)
    first = values[(upto <= low).sum()]
    if upto[-1] <= high:
        values, upto, _ = select(high)
    return float((first + values[(upto <= high).sum()]) / 2)
