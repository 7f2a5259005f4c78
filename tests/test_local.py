"""Localised conformal methods against their definitions, and in bounded memory."""

import tracemalloc

import numpy as np
import pytest

from plumbline.operators import conformal_local


def cell(n, kind, seed=0):
    rng = np.random.default_rng(seed)
    x = {
        "grid": lambda: np.stack([rng.integers(0, 6, n) / 100, rng.integers(0, 5, n) / 100, rng.integers(1, 30, n) * 1.0], 1),
        "continuous": lambda: rng.normal(size=(n, 3)),
        "constant": lambda: np.ones((n, 2)),
    }[kind]()
    s = np.abs(rng.normal(size=n)) * (1 + np.abs(x[:, 0]))
    return conformal_local.Cell(s[: n // 4], x[: n // 4], s[n // 4 : n // 2], x[n // 4 : n // 2], x[n // 2 :])


def peak(method, rows=12000):
    """MB at most while a cell's thresholds are found."""
    own = cell(rows, "grid")
    tracemalloc.start()
    try:
        made = conformal_local.METHODS[method](own, 0.1, np.random.default_rng(1))
        return tracemalloc.get_traced_memory()[1] / 1e6, made
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("kind", ["grid", "continuous", "constant"])
def test_posterior_mixture_by_row(kind):
    """Each test row's weights over all calibration rows, from the same draws."""
    own = cell(240, kind)
    got = conformal_local.METHODS["PCP"](own, 0.2, np.random.default_rng(4))
    x_fit, x_cal, x_test = conformal_local.standardise(own.x_fit, own.x_cal, own.x_test)
    rng = np.random.default_rng(4)
    centre = x_fit[rng.choice(len(x_fit), 4, replace=False)]
    for _ in range(25):
        near = conformal_local.squared_distances(x_fit, centre).argmin(1)
        centre = np.stack([x_fit[near == c].mean(0) if (near == c).any() else centre[c] for c in range(4)])
    spread = max(float(conformal_local.squared_distances(x_fit, centre).min(1).mean()), 1e-12)

    def member(x):
        d2 = conformal_local.squared_distances(x, centre)
        p = np.exp(-(d2 - d2.min(1, keepdims=True)) / (2 * spread))
        return np.clip(p / p.sum(1, keepdims=True), 1e-12, None)

    order = np.argsort(own.s_cal)
    for t, p in zip(got, member(x_test), strict=True):
        drawn = rng.multinomial(20, p / p.sum())
        log_w, log_own = np.log(member(x_cal)) @ drawn, drawn @ np.log(p)
        w = np.exp(log_w - max(log_w.max(), log_own))
        can = np.cumsum(w[order]) / (w.sum() + np.exp(log_own - max(log_w.max(), log_own))) >= 0.8 - 1e-12
        assert t == (own.s_cal[order][can.argmax()] if can.any() else np.inf)


def test_posterior_mixture_memory():
    used, made = peak("PCP")
    assert used < 200 and len(made) == 6000


@pytest.mark.parametrize("kind", ["grid", "continuous", "constant"])
@pytest.mark.parametrize("rows", [9, 240, 6000])
def test_smoothed_by_row(kind, rows):
    own = cell(rows, kind)
    x_fit, x_cal, x_test = conformal_local.standardise(own.x_fit, own.x_cal, own.x_test)
    d2 = ((x_fit[:, None] - x_fit[None]) ** 2).sum(2)[np.triu_indices(len(x_fit), 1)]
    h = np.sqrt(np.median(d2)) or 1.0
    assert conformal_local.median_bandwidth(x_fit) == pytest.approx(h, rel=1e-12)
    q_cal, q_test = (conformal_local.weighted_quantile(own.s_fit, conformal_local.kernel(((x[:, None] - x_fit[None]) ** 2).sum(2), h), 0.9) for x in (x_cal, x_test))
    left, k = np.sort(own.s_cal - q_cal), int(np.ceil((len(x_cal) + 1) * 0.9 - 1e-9))
    expected = q_test + (left[k - 1] if k <= len(left) else np.inf)
    np.testing.assert_allclose(conformal_local.METHODS["SLCP"](own, 0.1, None), expected, rtol=1e-12)


def test_smoothed_memory():
    used, made = peak("SLCP")
    assert used < 200 and len(made) == 6000


@pytest.mark.parametrize("kind", ["grid", "continuous", "constant"])
@pytest.mark.parametrize(("rows", "alpha"), [(7, 0.1), (60, 0.1), (160, 0.35)])
def test_calibrated_by_candidate(kind, rows, alpha):
    """Every candidate threshold of every test row, the largest first."""
    own = cell(rows, kind)
    s, x, test, h = conformal_local._pooled(own)
    got = conformal_local.METHODS["CalLCP"](own, alpha, None)
    order = np.argsort(s, kind="stable")
    s, x, n = s[order], x[order], len(s)
    near = conformal_local.kernel(((x[:, None] - x[None]) ** 2).sum(2), h)
    base, total = np.tril(near).sum(1), near.sum(1)
    for t, row in zip(got, test, strict=True):
        w = conformal_local.kernel(((row - x) ** 2).sum(1), h)
        expected = -np.inf
        for j in range(n, -1, -1):
            ranks = (base + np.where(np.arange(n) >= j, w, 0.0)) / (total + w)
            if (1 + (ranks >= (w[:j].sum() + 1) / (w.sum() + 1) - 1e-12).sum()) / (n + 1) > alpha:
                expected = s[j] if j < n else np.inf
                break
        assert t == expected


@pytest.mark.parametrize("kind", ["grid", "continuous", "constant"])
def test_bandwidth_by_matrix(kind):
    """The effective size of the whole kernel matrix at the bandwidth found is the target."""
    x = conformal_local._pooled(cell(400, kind))[1]
    near = conformal_local.kernel(((x[:, None] - x[None]) ** 2).sum(2), conformal_local.bandwidth_for(x, 50.0))
    size = len(x) / ((near / near.sum(1, keepdims=True)) ** 2).sum() - 1
    assert size == pytest.approx(50.0 if kind != "constant" else len(x) - 1)


def test_calibrated_memory():
    used, made = peak("CalLCP")
    assert used < 200 and len(made) == 6000


@pytest.mark.parametrize("kind", ["grid", "continuous", "constant"])
@pytest.mark.parametrize("rows", [7, 240, 2400])
def test_fixed_weights_by_matrix(kind, rows):
    own = cell(rows, kind)
    s, x, test, h = conformal_local._pooled(own)
    order = np.argsort(s)
    w = conformal_local.kernel(((test[:, None] - x[order][None]) ** 2).sum(2), h)
    reached = np.cumsum(w, 1) / (w.sum(1, keepdims=True) + 1) >= 0.9 - 1e-12
    expected = np.where(reached.any(1), s[order][reached.argmax(1)], np.inf)
    np.testing.assert_array_equal(conformal_local.METHODS["CalWCP"](own, 0.1, None), expected)


def test_fixed_weights_memory():
    used, made = peak("CalWCP")
    assert used < 200 and len(made) == 6000


@pytest.mark.parametrize(("kind", "rows"), [(kind, rows) for kind in ("grid", "continuous", "constant") for rows in (7, 240, 2400)] + [("grid", 9000)])
def test_random_centres_by_matrix(kind, rows):
    own = cell(rows, kind)
    s, x, test, h = conformal_local._pooled(own)
    centre = test + h * np.random.default_rng(6).standard_normal(test.shape)
    order = np.argsort(s)
    w = np.concatenate([conformal_local.kernel(((part[:, None] - x[order][None]) ** 2).sum(2), h) for part in np.array_split(centre, 20)])
    reached = np.cumsum(w, 1) / (w.sum(1) + conformal_local.kernel(((centre - test) ** 2).sum(1), h))[:, None] >= 0.9 - 1e-12
    expected = np.where(reached.any(1), s[order][reached.argmax(1)], np.inf)
    np.testing.assert_array_equal(conformal_local.METHODS["RLCP"](own, 0.1, np.random.default_rng(6)), expected)


def test_random_centres_memory():
    used, made = peak("RLCP")
    assert used < 200 and len(made) == 6000
