"""Extremely randomised regression trees in numpy, grown a level at a time."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Tree(NamedTuple):
    """Parallel arrays by node: the feature (-1 in leaves), its cut, the left child (the right
    one is next to it) and the mean."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, least: int = 5, depth: int = 24, tried: float = 1.0) -> Tree:
    """A tree whose every node takes the best of one random cut of each feature, or of a random
    part ``tried`` of them; leaves have ``least`` rows at least.  ``y`` may have several columns."""
    n, p = x.shape
    y = y.reshape(n, -1).astype(float)
    some = max(1, round(tried * p))
    node, rows, nodes = np.zeros(n, np.int64), np.arange(n), 1
    feature, cut, left = [np.full(1, -1)], [np.zeros(1)], [np.zeros(1, np.int64)]
    for _ in range(depth):
        ids, own = np.unique(node[rows], return_inverse=True)
        m, xs, ys = len(ids), x[rows], y[rows]
        low, high = np.full((m, p), np.inf), np.full((m, p), -np.inf)
        np.minimum.at(low, own, xs)
        np.maximum.at(high, own, xs)
        at = low + rng.random((m, p)) * (high - low)
        goes = xs <= at[own]
        count = np.bincount(own, minlength=m)[:, None]
        small = np.column_stack([np.bincount(own, goes[:, j], m) for j in range(p)])
        gain = np.zeros((m, p))
        for c in range(y.shape[1]):
            total = np.bincount(own, ys[:, c], m)[:, None]
            part = np.column_stack([np.bincount(own, goes[:, j] * ys[:, c], m) for j in range(p)])
            with np.errstate(divide="ignore", invalid="ignore"):
                gain += part**2 / small + (total - part) ** 2 / (count - small) - total**2 / count
        allowed = (small >= least) & (count - small >= least)
        if some < p:
            allowed &= rng.random((m, p)).argsort(1).argsort(1) < some
        gain = np.where(allowed, gain, -np.inf)
        best = gain.argmax(1)
        splits = gain[np.arange(m), best] > 1e-12
        if not splits.any():
            break
        child = nodes + 2 * (np.cumsum(splits) - 1)
        flat = [np.concatenate(v) for v in (feature, cut, left)]
        flat[0][ids[splits]], flat[1][ids[splits]], flat[2][ids[splits]] = best[splits], at[np.arange(m), best][splits], child[splits]
        more = 2 * int(splits.sum())
        feature, cut, left = [flat[0], np.full(more, -1)], [flat[1], np.zeros(more)], [flat[2], np.zeros(more, np.int64)]
        nodes += more
        keep = splits[own]
        side = goes[np.arange(len(rows)), best[own]]
        node[rows[keep]] = (child[own] + ~side)[keep]
        rows = rows[keep]
    size = np.maximum(np.bincount(node, minlength=nodes), 1)[:, None]
    value = np.column_stack([np.bincount(node, y[:, c], nodes) for c in range(y.shape[1])]) / size
    return Tree(np.concatenate(feature), np.concatenate(cut), np.concatenate(left), value)


def predict(tree: Tree, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(tree.feature[node] >= 0)
        if not len(inner):
            return tree.value[node]
        at = node[inner]
        node[inner] = tree.left[at] + (x[inner, tree.feature[at]] > tree.cut[at])


def forest(x: np.ndarray, y: np.ndarray, trees: int = 100, least: int = 5, seed: int = 0, tried: float = 1.0) -> list[Tree]:
    return [grow(x, y, np.random.default_rng((seed, k)), least, tried=tried) for k in range(trees)]


def each_tree(made: list[Tree], x: np.ndarray) -> np.ndarray:
    """A column of predictions for each tree of one output."""
    return np.column_stack([predict(t, x)[:, 0] for t in made])


def mean_of(made: list[Tree], x: np.ndarray) -> np.ndarray:
    return sum(predict(t, x) for t in made) / len(made)


class Cart(NamedTuple):
    """A tree grown level by level, so that its first levels are the tree of less depth.

    ``feature`` is -1 in leaves; ``value`` has a row for each node, ``depth`` its level."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: np.ndarray


def cart(x: np.ndarray, y: np.ndarray, max_depth: int = 30, least: int = 1) -> Cart:
    """Exact least-squares splits of all nodes of a level at once.  ``y`` has a column for each
    output; with one-hot classes the splits are those of the Gini impurity."""
    y = y.reshape(len(y), -1).astype(float)
    n, p = x.shape
    node, rows = np.zeros(n, np.int64), np.arange(n)
    feature, cut, left, value, depth = np.full(1, -1), np.zeros(1), np.zeros(1, np.int64), y.mean(0, keepdims=True), np.zeros(1, np.int64)
    order = [np.argsort(x[:, j], kind="stable") for j in range(p)]
    for level in range(max_depth):
        ids, own = np.unique(node[rows], return_inverse=True)
        of = np.full(len(feature), -1)
        of[ids] = np.arange(len(ids))
        m = len(ids)
        size = np.bincount(own, minlength=m)
        total = np.column_stack([np.bincount(own, y[rows, c], m) for c in range(y.shape[1])])
        best, at, by = np.full(m, 1e-10 * max(1.0, float((y**2).mean()))), np.zeros(m), np.full(m, -1)
        open_rows = np.zeros(n, bool)
        open_rows[rows] = True
        base = (total**2).sum(1) / size
        for j in range(p):
            sorted_rows = order[j][open_rows[order[j]]]
            group = of[node[sorted_rows]]
            sorted_rows = sorted_rows[np.argsort(group, kind="stable")]
            group = of[node[sorted_rows]]
            begin = np.searchsorted(group, np.arange(m))
            sums = np.cumsum(y[sorted_rows], 0)
            before = np.where(begin[:, None] > 0, sums[begin - 1], 0.0)[group]
            few = np.arange(len(group)) - begin[group] + 1
            many = size[group] - few
            v = x[sorted_rows, j]
            ok = (many >= least) & (few >= least)
            ok[:-1] &= v[:-1] < v[1:]
            ok &= many > 0
            low = sums - before
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, (low**2).sum(1) / few + ((total[group] - low) ** 2).sum(1) / many - base[group], -np.inf)
            top = np.maximum.reduceat(gain, begin)
            first = np.full(m, len(gain))
            hit = np.flatnonzero(gain >= top[group])
            np.minimum.at(first, group[hit], hit)
            better = top > best
            best[better], by[better] = top[better], j
            k = first[better]
            at[better] = (v[k] + v[np.minimum(k + 1, len(v) - 1)]) / 2
            # Halves of neighbouring floats can round up to the right one.
            at[better] = np.where(at[better] >= v[np.minimum(k + 1, len(v) - 1)], v[k], at[better])
        splits = by >= 0
        if not splits.any():
            break
        child = len(feature) + 2 * (np.cumsum(splits) - 1)
        feature[ids[splits]], cut[ids[splits]], left[ids[splits]] = by[splits], at[splits], child[splits]
        keep = splits[own]
        side = x[rows, np.maximum(by[own], 0)] > at[own]
        node[rows[keep]] = (child[own] + side)[keep]
        rows = rows[keep]
        more = 2 * int(splits.sum())
        made = node[rows] - len(feature)
        count = np.bincount(made, minlength=more)[:, None]
        mean = np.column_stack([np.bincount(made, y[rows, c], more) for c in range(y.shape[1])]) / count
        feature, cut, left = np.append(feature, np.full(more, -1)), np.append(cut, np.zeros(more)), np.append(left, np.zeros(more, np.int64))
        value, depth = np.concatenate((value, mean)), np.append(depth, np.full(more, level + 1))
    return Cart(feature, cut, left, value, depth)


def by_depth(tree: Cart, x: np.ndarray):
    """Predictions of the trees of depth 0, 1, 2 and so on, up to the whole one."""
    node = np.zeros(len(x), np.int64)
    yield tree.value[node]
    for _ in range(int(tree.depth.max())):
        inner = np.flatnonzero(tree.feature[node] >= 0)
        at = node[inner]
        node[inner] = tree.left[at] + (x[inner, tree.feature[at]] > tree.cut[at])
        yield tree.value[node]


def leaves(tree: Cart, depth: int) -> int:
    """Leaves of the tree that is cut at a depth."""
    return int(((tree.depth < depth) & (tree.feature < 0) | (tree.depth == depth)).sum())


def boosted(x: np.ndarray, y: np.ndarray, test: np.ndarray, rounds: int = 50, rate: float = 0.1, depth: int = 3, classes: bool = False) -> np.ndarray:
    """Predictions for ``test`` of trees of a depth fitted to what is left; with ``classes`` of
    one-hot ``y`` the margins of a softmax."""
    y = y.reshape(len(y), -1).astype(float)
    start = np.log(np.maximum(y.mean(0), 1e-9)) if classes else y.mean(0)
    own, out = np.tile(start, (len(x), 1)), np.tile(start, (len(test), 1))
    for _ in range(rounds):
        share = np.exp(own - own.max(1, keepdims=True))
        left = y - share / share.sum(1, keepdims=True) if classes else y - own
        tree = cart(x, left, depth)
        # A leaf's mean residual is small next to a class's margin, so steps are longer there.
        step = rate * (4.0 if classes else 1.0)
        *_, a = by_depth(tree, x)
        *_, b = by_depth(tree, test)
        own, out = own + step * a, out + step * b
    return out
