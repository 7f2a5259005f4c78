"""Queries that SQL cannot express against plain code over the whole of a small table."""

import itertools
import math

import numpy as np
import pytest

from plumbline.operators import bootstrap
from plumbline.plans import queries as Q

SF = "/root/testdata/sf0.001"
#: Cells of the smaller table have too few rows for slabs.
LARGER = "/root/testdata/sf0.01"


def _t_p(t, df):
    """Two-sided p of Student's t by summing the density over its angle."""
    if not np.isfinite(t):
        return 0.0
    theta = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, 20_001)
    density = np.cos(theta) ** (df - 1)
    whole = np.cos(np.linspace(-math.pi / 2, math.pi / 2, 40_001)) ** (df - 1)
    return float(2 * np.trapezoid(density, theta) / np.trapezoid(whole, dx=math.pi / 40_000))


def _ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def _result(spark, name, folder=SF):
    return Q.QUERIES[name].run(spark, folder).toPandas()


def test_spearman_p(spark):
    got = _result(spark, "q_spearman_p").set_index(Q._SKEYS)
    pairs = Q._xy(spark, SF).toPandas()
    for key, own in pairs.groupby(Q._SKEYS):
        x, y = _ranks(own.x.to_numpy(float)), _ranks(own.y.to_numpy(float))
        if x.std() == 0 or y.std() == 0:
            continue
        r = np.corrcoef(x, y)[0, 1]
        assert got.r[key] == pytest.approx(r, abs=1e-6)
        assert got.p[key] == pytest.approx(_t_p(r * math.sqrt((len(x) - 2) / max(1 - r * r, 1e-300)), len(x) - 2), abs=2e-4)


def test_rubin_p(spark):
    got = _result(spark, "q_rubin_p").set_index(["dataset_id", "model"])
    rows = Q._seed_estimates(spark, SF).toPandas()
    for key, own in rows.groupby(["dataset_id", "model"]):
        k, est, within, between = len(own), own.mae.mean(), own.v.mean(), own.mae.var(ddof=1)
        total = within + (1 + 1 / k) * between
        df = (k - 1) / ((1 + 1 / k) * between / total) ** 2
        row = got.loc[key]
        assert row.est == pytest.approx(est, abs=1e-6) and row.se == pytest.approx(math.sqrt(total), abs=1e-6) and row.df == pytest.approx(df, rel=1e-5)
        if df < 400:
            assert row.p == pytest.approx(_t_p(est / math.sqrt(total), df), abs=1e-4)
            assert _t_p((row.ci_high - row.est) / row.se, df) == pytest.approx(0.05, abs=1e-3)


def test_wilcoxon_p(spark):
    """By all signs of the ranks, where no two differences are equal."""
    got = _result(spark, "q_wilcoxon_p")
    cells = Q._cells(spark, SF).where("alpha = 0.1").groupBy("dataset_id").pivot("model").agg({"interval_score": "avg"}).toPandas().set_index("dataset_id")
    seen = 0
    for row in got.itertuples():
        d = (cells[row.model_a] - cells[row.model_b]).dropna().to_numpy()
        if len(d) > 12 or len(set(np.abs(d))) < len(d) or (d == 0).any():
            continue
        rank = _ranks(np.abs(d))
        stat = min(rank[d > 0].sum(), rank[d < 0].sum())
        sums = [sum(r for r, s in zip(rank, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
        want = min(1.0, 2 * np.mean([s <= stat for s in sums]))
        assert row.p == pytest.approx(want, abs=1e-6)
        seen += 1
    assert seen


def test_normality(spark):
    got = _result(spark, "x_target_normality").set_index("dataset_id").y_ks_normal
    for d, own in Q.reg_panel(spark, SF).select("dataset_id", "y").toPandas().groupby("dataset_id"):
        z = np.sort((own.y - own.y.mean()) / own.y.std(ddof=0))
        p = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
        i = np.arange(1, len(z) + 1)
        assert got[d] == pytest.approx(max((i / len(z) - p).max(), (p - (i - 1) / len(z)).max()), abs=1e-5)


def test_rank_bootstrap(spark):
    got = _result(spark, "t_rank_bootstrap")
    means = Q._long(spark, SF).where("alpha is null").groupBy("dataset_id", "model", "metric").agg({"value": "avg"}).withColumnRenamed("avg(value)", "value").toPandas()
    for metric, own in means.groupby("metric"):
        wide = own.pivot(index="dataset_id", columns="model", values="value").sort_index().sort_index(axis=1).to_numpy()
        rank = np.array([_ranks(-r if metric == "r2" else r) for r in wide])
        rng = np.random.default_rng(bootstrap.RANK_SEED)
        drawn = np.concatenate([rank[rng.integers(0, len(rank), (1000, len(rank)))].mean(1) for _ in range(10)])
        mine = got[got.metric == metric].sort_values("model")
        np.testing.assert_allclose(mine.mean_rank, rank.mean(0), atol=1e-6)
        np.testing.assert_allclose(mine[["ci_low", "ci_high"]], np.percentile(drawn, [2.5, 97.5], axis=0).T, atol=1e-6)


def test_transitions(spark):
    got = _result(spark, "t_transitions").sort_values("ensemble").reset_index(drop=True)
    rows = Q._ensembles(spark, SF).toPandas()
    rng = np.random.default_rng(bootstrap.ENSEMBLE_SEED)
    for k, (a, b) in enumerate(((1, 4), (4, 8))):
        wide = rows.pivot(index=["dataset_id", "model"], columns="ensemble", values="value")
        gain = (wide[a] - wide[b]).groupby("dataset_id").mean().sort_index().to_numpy()
        drawn = np.concatenate([gain[rng.integers(0, len(gain), (1000, len(gain)))].mean(1) for _ in range(10)])
        assert (got.ensemble[k], got.next[k]) == (a, b) and got.mean_gain[k] == pytest.approx(gain.mean(), abs=1e-6) and got.frac_improved[k] == pytest.approx((gain > 0).mean(), abs=1e-6)
        np.testing.assert_allclose([got.ci_low[k], got.ci_high[k]], np.percentile(drawn, [2.5, 97.5]), atol=1e-6)


def test_all_metrics_are_their_parts(spark):
    """The long table of everything against the operators one by one."""
    got = _result(spark, "r_all_metrics", LARGER).set_index(["dataset_id", "seed", "model", "alpha", "metric"]).value
    slabs = _result(spark, "r_worst_slab", LARGER)
    assert slabs.worst_slab_coverage.notna().sum() > 300
    for r in slabs.itertuples():
        key = (r.dataset_id, r.seed, r.model, r.alpha)
        for name in ("worst_slab_coverage", "wsc_abs_dev", "total_abs_dev"):
            want = getattr(r, name, None)
            if want is None or np.isnan(want):
                assert (*key, name) not in got.index
            else:
                assert got[(*key, name)] == pytest.approx(want, abs=1e-6)
    wide = _result(spark, "c_all_metrics").set_index(["dataset_id", "model"]).sort_index()
    rest = _result(spark, "c_metrics_wide").set_index(["dataset_id", "model"]).sort_index()
    for c in rest.columns:
        np.testing.assert_allclose(wide[c].astype(float), rest[c].astype(float), atol=1e-6)
