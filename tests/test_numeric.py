"""Numeric functions against brute force and known values."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import distributions as D
from plumbline.functions import ppd
from plumbline.operators import bootstrap, conformal, conformal_local, learners, mixed, preprocessing, registry, regression, sampling, selection, statistics, tables, validation


def test_quantile_grid():
    assert len(ppd.quantile_grid(0.005)) == 199
    assert ppd.quantile_grid(0.25) == [0.25, 0.5, 0.75]
    with pytest.raises(ValueError):
        ppd.quantile_grid(0.5)


def test_ppd_expressions(spark):
    levels = [0.1, 0.3, 0.5, 0.9]
    rows = [(k, sorted(v)) for k, v in enumerate(np.random.default_rng(0).normal(size=(20, 4)).round(1).tolist())]
    df = spark.createDataFrame(rows, "k int, ppd array<double>").withColumn("y", (F.col("k") - 10) / 8.0)
    p = F.col("ppd")
    got = df.select("k", ppd.quantile_at(p, levels, 0.4).alias("q"), ppd.crps(p, levels, F.col("y")).alias("c"), ppd.cdf_at(p, levels, F.col("y")).alias("u"), ppd.grid_integral(p, levels).alias("m"), ppd.cdf_at(p, levels, p[1]).alias("self")).toPandas()
    for r in got.itertuples():
        v, y = np.array(rows[r.k][1]), (r.k - 10) / 8
        assert r.q == pytest.approx(np.interp(0.4, levels, v))
        loss = np.where(y >= v, np.array(levels) * (y - v), (np.array(levels) - 1) * (y - v))
        assert r.c == pytest.approx(2 * np.trapezoid(loss, levels))
        assert r.m == pytest.approx(np.trapezoid(v, levels) + 0.1 * v[0] + 0.1 * v[-1])
        same = np.flatnonzero(v == v[1])
        assert r.self == pytest.approx((levels[same[0]] + levels[same[-1]]) / 2)
        if y not in v and len(set(v)) == 4:
            assert r.u == pytest.approx(np.interp(y, v, levels))


def test_monotone_and_crossing(spark):
    df = spark.createDataFrame([([1.0, 0.5, 2.0],), ([1.0, 1.0, 2.0],), ([],)], "ppd array<double>")
    got = df.select(ppd.monotone(F.col("ppd")).alias("m"), ppd.crosses(F.col("ppd")).alias("c")).collect()
    assert [r["m"] for r in got] == [[1.0, 1.0, 2.0], [1.0, 1.0, 2.0], []]
    assert [r["c"] for r in got] == [True, False, False]


def test_t_and_normal():
    assert D.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert D.t_ppf(0.975, 5) == pytest.approx(2.5705818, abs=1e-6)
    assert D.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert D.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_kolmogorov():
    assert D.kolmogorov_sf(0.5, 1) == pytest.approx(1.0)
    assert D.kolmogorov_sf(0.274, 10) == pytest.approx(1 - 0.62847, abs=2e-4)
    rng = np.random.default_rng(1)
    u = np.sort(rng.uniform(size=(20000, 7)), 1)
    i = np.arange(1, 8)
    d = np.maximum(i / 7 - u, u - (i - 1) / 7).max(1)
    assert D.kolmogorov_sf(0.4, 7) == pytest.approx((d >= 0.4).mean(), abs=0.01)


@given(st.lists(st.integers(1, 1000), min_size=1, max_size=9, unique=True), st.integers(0, 511))
@settings(max_examples=30, deadline=None)
def test_wilcoxon_exact(sizes, signs):
    d = np.array([v if signs >> k & 1 else -v for k, v in enumerate(sizes)], float)
    rank = np.argsort(np.argsort(np.abs(d))) + 1
    plus, n = rank[d > 0].sum(), len(d)
    all_sums = [sum(r for r, s in zip(rank, z, strict=True) if s) for z in itertools.product((0, 1), repeat=n)]
    low = min(plus, n * (n + 1) // 2 - plus)
    want = min(1.0, 2 * sum(x <= low for x in all_sums) / 2**n)
    assert D.wilcoxon_p(d) == pytest.approx(want)


def test_registry_sets():
    assert len(registry.LOWER_IS_BETTER) == 33
    assert registry.AXIS <= registry.TRADE_OFF and registry.SIGNED <= registry.TRADE_OFF and not registry.AXIS & registry.SIGNED
    assert registry.direction("r2") == 1 and registry.direction("mae") == -1 and registry.direction("avg_length") == 0
    with pytest.raises(ValueError):
        registry.ascending("avg_length")


def test_acat_and_bh(spark):
    same = spark.createDataFrame([(1, 0.2), (1, 0.2), (2, None)], "k int, p double")
    assert statistics.acat(same, ["k"]).collect()[0]["p_acat"] == pytest.approx(0.2)
    ps = [0.01, 0.04, 0.03, 0.2, None]
    got = statistics.benjamini_hochberg(spark.createDataFrame([(1, p) for p in ps], "k int, p double"), ["k"]).collect()
    assert sorted((r["p"], round(r["q"], 6)) for r in got if r["p"] is not None) == [(0.01, 0.04), (0.03, 0.053333), (0.04, 0.053333), (0.2, 0.2)]


def test_order_statistic_is_infinite(spark):
    cal = spark.createDataFrame([(1, float(v)) for v in range(5)] + [(2, float(v)) for v in range(30)], "k int, score double")
    got = {r["k"]: r["threshold"] for r in conformal.order_statistic(cal, ["k"], 0.1).collect()}
    assert got == {1: math.inf, 2: 27.0}


def test_split_coverage_holds(spark):
    rng = np.random.default_rng(3)
    rows = [(1, int(i), ("train", "cal", "test", "test")[i % 4], float(y), [float(-1), 0.0, 1.0], 0.0) for i, y in enumerate(rng.normal(size=4000))]
    df = spark.createDataFrame(rows, "k int, row_pos int, role string, y double, ppd array<double>, point_pred double")
    made = conformal.split_conformal(df, ["k"], [0.25, 0.5, 0.75], [0.1])
    cover = regression.score_intervals(made).agg(F.avg("covered")).first()[0]
    assert cover == pytest.approx(0.9, abs=0.03)


def test_local_weights():
    v, w = np.array([3.0, 1.0, 2.0]), np.array([[1.0, 1, 1], [0, 0, 0], [0, 0, 5]])
    assert conformal_local.weighted_quantile(v, w, 0.5).tolist() == [2.0, 2.0, 2.0]
    s, x = np.arange(20.0), np.zeros((20, 1))
    # With one place for all, the localised rule is the plain order statistic.
    assert conformal_local.calibrated_local(s, x, np.zeros((1, 1)), 1.0, 0.1)[0] == 18.0


def test_pair_delta_and_empty(spark):
    t = spark.createDataFrame([(1, "a", 2.0, 0.5), (1, "b", 1.0, 0.7), (2, "a", 0.0, 0.1), (2, "b", 1.0, 0.2)], "dataset_id int, model string, mae double, r2 double")
    got = {r["dataset_id"]: (r["mae"], round(r["r2"], 6)) for r in tables.pair_delta(t, "a", "b", ["mae", "r2", "avg_length"], ["dataset_id"]).collect()}
    assert got == {1: (0.5, 0.2), 2: (None, 0.1)}
    assert tables.pair_delta(t.limit(0), "a", "b", ["mae"], ["dataset_id"]).count() == 0


def test_peer_z_needs_two(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 5.0), (3, "a", 2.0), (3, "b", 2.0)], "dataset_id int, model string, mae double")
    got = {(r["dataset_id"], r["model"]): r["mae"] for r in tables.peer_z(t, ["mae"], ["dataset_id"]).collect()}
    assert got[1, "a"] == 1.0 and got[1, "b"] == -1.0 and got[2, "a"] is None and got[3, "a"] is None


def test_mixed_model_recovers():
    rng = np.random.default_rng(5)
    g = np.repeat(np.arange(60), 5)
    x = np.column_stack((np.ones(300), rng.normal(size=300)))
    y = x @ [1.0, 2.0] + rng.normal(size=60)[g] * 1.5 + rng.normal(size=300) * 0.5
    fit = mixed.random_intercept(y, x, g)
    assert fit.beta[1] == pytest.approx(2.0, abs=0.15) and fit.residual == pytest.approx(0.25, rel=0.3) and fit.between == pytest.approx(2.25, rel=0.5)
    assert mixed.pivoted_columns(np.column_stack((x[:, 1], 2 * x[:, 1], x[:, 0]))) in ([0, 2], [1, 2])


def test_shapley_adds_up():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 3))
    y = x[:, 0] * 2 + (x[:, 1] > 0)
    model = learners.boosted_trees(x, y, rounds=20)
    c = learners.contributions(model, x[:10], x[10:20])
    base = learners.predict_trees(model, x[10:20]).mean()
    np.testing.assert_allclose(c.sum(1) + base, learners.predict_trees(model, x[:10]), atol=1e-9)


@given(st.dictionaries(st.integers(0, 5), st.integers(2, 40), min_size=1, max_size=5), st.data())
@settings(max_examples=40, deadline=None)
def test_quotas(counts, data):
    size = data.draw(st.integers(len(counts), sum(counts.values())))
    got = sampling.quotas(counts, size)
    assert sum(got.values()) == size and all(1 <= got[c] <= counts[c] for c in counts)


def test_quotas_infeasible():
    with pytest.raises(sampling.InfeasibleSample):
        sampling.quotas({"a": 2}, 5)
    assert sampling.diverse_members([frozenset({1}), frozenset({1, 2}), frozenset({3})], 2) == [1, 2]


def test_bootstrap_repeats():
    v = np.arange(10.0)
    a, b = (bootstrap.means(v, np.random.default_rng(7), 50) for _ in range(2))
    assert (a == b).all() and (a == v[np.random.default_rng(7).integers(0, 10, (50, 10))].mean(1)).all()


def test_slab_merging():
    slabs = regression._numeric_slabs(np.array([1.0] * 8 + [2.0, 3.0]), 3, 5)
    assert slabs[0][0] < 1.0 and slabs[-1][1] > 3.0
    assert sum(((np.array([1.0] * 8 + [2.0, 3.0]) > a) & (np.array([1.0] * 8 + [2.0, 3.0]) <= b)).sum() for a, b in slabs) == 10
    assert sorted(map(sorted, regression._category_slabs(np.array(list("aaaaabbc")), 3))) == [["a"], ["b", "c"]]


def test_validation(spark):
    t = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, float("nan"))], "k int, value double")
    with pytest.raises(validation.ConstraintError):
        validation.require(validation.duplicates(t, ["k"]), "duplicates")
    validation.require(validation.duplicates(t, ["k", "value"]), "duplicates")
    assert validation.incomplete(t, ["k"], 2).collect()[0]["k"] == 2
    assert selection.partition_problems({"a": ["x"], "b": ["x", "y"]}, ["x", "y", "z"]) == ["x", "z"]


def test_preprocessing(spark):
    t = spark.createDataFrame([(1, "a", 1.0, True), (1, "b", None, True), (1, "c", 3.0, False), (1, None, float("inf"), False)], "k int, c string, x double, in_context boolean")
    got = [r["c"] for r in preprocessing.ordinal(t, ["c"]).orderBy("x").select("x", "c").collect()]
    assert sorted(map(str, got)) == ["-1", "0", "1", "None"]
    assert sorted(r["x"] for r in preprocessing.impute_median(t, ["k"], ["x"]).collect()) == [1.0, 1.0, 1.0, 3.0]
    assert preprocessing.task_of(t.schema, "c") == "classification" and preprocessing.task_of(t.schema, "x") == "regression"
