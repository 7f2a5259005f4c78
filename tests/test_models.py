"""Trees, mutual information, complexity, component and instance prediction against plain code."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import mutual, trees
from plumbline.functions.neighbours import nearest
from plumbline.operators import complexity, conformal, conformal_local, ensembles, instance_features, instance_predict, learners, mixed, preprocessing, registry, regression, sampling, selection, tables


def _split(x, y, depth):
    """A tree by trying every cut of every feature, as nested tuples."""
    best = (1e-9, None, None)
    for j in range(x.shape[1]) if depth else ():
        for v in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= v
            gain = len(y) * y.var() - low.sum() * y[low].var() - (~low).sum() * y[~low].var()
            if gain > best[0] + 1e-9:
                best = (gain, j, v)
    if best[1] is None:
        return y.mean()
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _split(x[low], y[low], depth - 1), _split(x[~low], y[~low], depth - 1)


def _walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("seed", range(4))
def test_cart_by_depth(seed):
    """The first levels of one deep tree are the shorter trees, and every cut is the best one."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 15, (90, 3)).astype(float)
    y = x[:, 0] + rng.normal(size=90)
    tree = trees.cart(x, y)
    for depth, guess in enumerate(trees.by_depth(tree, x)):
        want = _split(x, y, depth)
        np.testing.assert_allclose(guess[:, 0], [_walk(want, r) for r in x])
        if depth == 5:
            break
    assert trees.leaves(tree, 0) == 1 and trees.leaves(tree, 1) == 2


def test_extra_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = np.column_stack((np.sin(2 * x[:, 0]) + x[:, 1], x[:, 1] > 0))
    made = trees.forest(x[:400], y[:400], 40, 4, tried=0.7)
    guess = trees.mean_of(made, x[400:])
    assert complexity.r2(y[400:, 0], guess[:, 0]) > 0.7 and complexity.r2(y[400:, 1], guess[:, 1]) > 0.7
    for t in made[:5]:
        node = np.zeros(400, int)
        while (inner := t.feature[node] >= 0).any():
            at = node[inner]
            node[inner] = t.left[at] + (x[:400][inner, t.feature[at]] > t.cut[at])
        assert np.bincount(node)[np.unique(node)].min() >= 4
        np.testing.assert_allclose(t.value[node[:1]][0], y[:400][node == node[0]].mean(0))


@given(st.lists(st.integers(0, 12), min_size=5, max_size=40), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_neighbours_on_a_line(values, k):
    x = np.array(values, float) / 3
    far = np.sort(np.abs(x[:, None] - x), 1)
    np.testing.assert_array_equal(mutual._reach(x, k), far[:, k])
    reach = mutual._reach(x, k)
    np.testing.assert_array_equal(mutual._within(x, x, reach), (np.abs(x[:, None] - x) < reach[:, None]).sum(1))


def test_mutual_information():
    rng = np.random.default_rng(1)
    for r in (0.0, 0.5, 0.9):
        z = rng.multivariate_normal([0, 0], [[1, r], [r, 1]], 3000)
        assert mutual.with_number(z[:, 0], z[:, 1]) == pytest.approx(-0.5 * np.log(1 - r * r), abs=0.05)
    x = rng.normal(size=8000)
    c = (2 * x + rng.normal(size=8000) > 0).astype(int)
    place = np.searchsorted(np.quantile(x, np.linspace(0, 1, 41)[1:-1]), x)
    p = np.histogram2d(place, c, (40, 2))[0] / 8000
    some = p > 0
    assert mutual.with_class(x, c) == pytest.approx((p[some] * np.log(p[some] / (p.sum(1, keepdims=True) * p.sum(0))[some])).sum(), abs=0.03)
    np.testing.assert_allclose(mutual.digamma(np.array([1.0, 2.0, 10.0])), [-0.5772156649, 0.4227843351, 2.2517525891], atol=1e-9)
    assert mutual.with_number(np.ones(10), np.arange(10.0)) == 0 and mutual.with_class(np.arange(3.0), np.arange(3)) == 0


def test_complexity():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    linear = complexity.regression_complexity(x, x @ [1, 2, 0] + 0.1 * rng.normal(size=400))
    assert linear["linear_r2"] > 0.99 and linear["complexity_ratio"] < 1
    step = complexity.regression_complexity(x, (x[:, 0] > 0) * 1.0)
    assert step["tree_target_met"] == 1 and step["tree_min_depth"] == 1 and step["tree_terminal_nodes"] == 2 and step["snr"] > 20
    ring = complexity.classification_complexity(x, ((x[:, :2] ** 2).sum(1) > 1.4).astype(int))
    assert ring["linear_acc"] < 0.65 < 0.85 < ring["nonlinear_acc"] and ring["nonlinear_acc_norm"] == pytest.approx(2 * ring["nonlinear_acc"] - 1)
    assert complexity.regression_complexity(x, np.ones(400)) == {} == complexity.classification_complexity(x[:5], np.arange(5))
    noise = complexity.regression_complexity(x, rng.normal(size=400))
    assert noise["tree_target_met"] == 0 and noise["tree_min_depth"] == complexity.MOST_DEPTH


def test_shrunken_tree_by_path():
    """A leaf's value is the root's plus each step down over 1 + shrink / N of the node above."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 2)), rng.normal(size=80)
    tree = trees.cart(x, y, 3)
    size = np.zeros(len(tree.feature))
    for r in x:
        k = 0
        size[k] += 1
        while tree.feature[k] >= 0:
            k = tree.left[k] + int(r[tree.feature[k]] > tree.cut[k])
            size[k] += 1
    value = complexity._shrunken(tree, size, 10.0)
    for r in x[:10]:
        k, want = 0, tree.value[0, 0]
        while tree.feature[k] >= 0:
            child = tree.left[k] + int(r[tree.feature[k]] > tree.cut[k])
            want += (tree.value[child, 0] - tree.value[k, 0]) / (1 + 10.0 / size[k])
            k = child
        assert value[k, 0] == pytest.approx(want)
    made = complexity.shrunken_tree(x, (x[:, 0] > 0).astype(int), True)
    assert made["hs_vs_prior"] > 0 and 0 < made["hs_dof"] < made["hs_leaves"]


def test_datasets_of_all_kinds(spark):
    """Missing values, a constant target, few rows and none."""
    rows = [(1, float(k), None if k == 3 else float(k % 7), float(k)) for k in range(40)] + [(2, float(k), 1.0, 5.0) for k in range(30)] + [(3, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "d int, a double, b double, y double")
    got = {r["d"]: r for r in complexity.complexity(df, ["d"], ["a", "b"]).collect()}
    assert got[1]["linear_r2"] is not None and not np.isnan(got[1]["linear_r2"]) and all(v is None or np.isnan(v) for v in got[2][1:] + got[3][1:])
    assert complexity.information(df.where("false"), ["d"], ["a", "b"]).count() == 0
    assert {r["d"] for r in complexity.information(df, ["d"], ["a", "b"]).collect()} == {1, 2, 3}


def test_fold_transform():
    train = np.array([[1.0, np.nan], [2.0, 5.0], [3.0, 7.0], [4.0, 9.0]])
    a, b = learners.fold_transform(train, np.array([[100.0, np.nan], [2.0, 5.0]]))
    assert a.shape == (4, 3) and np.allclose(a.mean(0), 0) and np.allclose(a.std(0), 1)
    # Beyond the range the largest rank; the same value has the same place as in training.
    assert b[0, 0] == pytest.approx(a[3, 0]) and b[1, 0] == pytest.approx(a[1, 0]) and b[0, 2] > b[1, 2]


def test_ridge_path():
    rng = np.random.default_rng(4)
    x, y, t = rng.normal(size=(30, 4)), rng.normal(size=(30, 2)), rng.normal(size=(5, 4))
    for alpha, got in zip((0.1, 10.0), learners.ridge_path(x, y, t, (0.1, 10.0)), strict=True):
        for c in range(2):
            beta, base = learners.ridge(x, y[:, c], alpha)
            np.testing.assert_allclose(got[:, c], t @ beta + base)


def test_components(spark):
    """A shift that follows a feature is predicted, noise is not; losses add up to those of the whole."""
    rng = np.random.default_rng(5)
    features = [(k, float(rng.normal()), float(rng.normal())) for k in range(60)]
    panel = [(k, m, 2 * a + 0.1 * rng.normal() + {"a": 0, "b": 1, "c": 3}[m]) for k, a, _ in features for m in "abc"]
    f = spark.createDataFrame(features, "dataset_id long, fa double, fb double")
    p = spark.createDataFrame(panel, "dataset_id long, model string, value double")
    held = learners.component_prediction(p, f, ["fa", "fb"], repeats=2, n_trees=20)
    gains = learners.component_gains(held).toPandas()
    shared = gains[gains.component == "shared"].groupby("learner").gain.min()
    assert len(gains) == 8 and shared["ridge"] > 0.9 and shared["extra_trees"] > 0.4 and gains[gains.component == "differential"].gain.max() < 0.2
    rows = held.toPandas()
    assert rows.groupby(["learner", "repeat"]).dataset_id.nunique().eq(60).all()
    np.testing.assert_allclose(rows.shared_loss, (rows.observed_shared - rows.predicted_shared) ** 2)
    wide = pd.DataFrame(panel, columns=["d", "m", "v"]).pivot(index="d", columns="m", values="v")
    one = rows[(rows.learner == "ridge") & (rows.repeat == 0)].set_index("dataset_id").sort_index()
    for fold, own in one.groupby("fold"):
        rest = wide.loc[one.index[one.fold != fold]].mean()
        np.testing.assert_allclose((wide.loc[own.index] - rest).mean(1), own.observed_shared)
    summary = learners.component_summary(learners.component_gains(held)).toPandas().set_index(["learner", "component"])
    want = gains.groupby(["learner", "component"]).gain
    np.testing.assert_allclose(summary.mean_gain.sort_index(), want.mean().sort_index())
    np.testing.assert_allclose(summary.sd_gain.sort_index(), want.std().sort_index())
    assert learners.component_prediction(p.where("dataset_id < 5"), f, ["fa"]).count() == 0


def test_instance_prediction(spark):
    rng = np.random.default_rng(6)
    rows = [(d, k, float(a := rng.normal()), float(rng.normal()), 1.0, int(a + 0.3 * rng.normal() > 0)) for d in range(8) for k in range(60)]
    df = spark.createDataFrame(rows, "dataset_id int, row_pos long, a double, b double, c double, hit int").withColumn("seed", F.lit(0)).withColumn("model", F.lit("m"))
    got = instance_predict.predictability(df, ["model"], ["a", "b", "c"], "hit", True, most=40).toPandas().set_index("feature")
    assert got.n_rows.eq(320).all() and got.cv_score.iloc[0] > 0.9 and got.linear_score.iloc[0] > 0.9
    assert got.importance["a"] > 0.2 > abs(got.importance["b"]) and np.isnan(got.importance["c"]) and got.direction["a"] == 1 and got.xi["a"] > 0.3
    alone = instance_predict.predictability(df.where("dataset_id = 0"), ["model"], ["a"], "hit", True).toPandas()
    assert alone.n_groups.iloc[0] == 1 and np.isnan(alone.cv_score.iloc[0])
    y, s = np.array([0, 1, 1, 0, 1]), np.array([0.1, 0.4, 0.4, 0.4, 0.9])
    pairs = [(0.5 if a == b else float(a > b)) for a in s[y == 1] for b in s[y == 0]]
    assert instance_predict.auc(y, s) == pytest.approx(np.mean(pairs))
    fold = instance_predict.group_folds(np.repeat([5, 6, 7, 8], [10, 3, 3, 4]), 2)
    assert len(set(fold[:10])) == 1 and np.bincount(fold).tolist() == [10, 10]


def test_tree_predictor(spark):
    rng = np.random.default_rng(7)
    rows = [(c, k, float(x := rng.uniform(-2, 2)), float(c * 10 + np.sin(2 * x) + 0.1 * rng.normal())) for c in (0, 1) for k in range(300)]
    df = spark.createDataFrame(rows, "cell int, row_pos int, x double, y double")
    levels = [0.1, 0.5, 0.9]
    got = learners.PREDICTORS["trees"](levels, keys=["cell"]).fit_predict(df.where("row_pos % 2 = 0"), df.where("row_pos % 2 = 1"), ["x"], "y").toPandas()
    assert len(got) == 300 and complexity.r2((got.y - 10 * got.cell).to_numpy(), (got.point_pred - 10 * got.cell).to_numpy()) > 0.8
    assert all(list(p) == sorted(p) for p in got.ppd)


# --------------------------------------------------------------------------- rules that were wrong
def test_ranks_follow_the_registry(spark):
    """Long names are ranked by their last part."""
    rows = [(1, m, name, v) for name in ("alpha_free.per_dataset.r2", "r2", "alpha_free.per_dataset.mae", "accuracy") for m, v in (("a", 0.9), ("b", 0.5))]
    got = {(r["metric"], r["model"]): r["rank"] for r in tables.ranks(spark.createDataFrame(rows, "dataset_id int, model string, metric string, value double"), ["dataset_id"]).collect()}
    assert got["alpha_free.per_dataset.r2", "a"] == got["r2", "a"] == got["accuracy", "a"] == 1 and got["alpha_free.per_dataset.mae", "a"] == 2


def test_order_takes_one_column(spark):
    df = spark.createDataFrame([("f", None, 100.0), ("g", 0.2, 1.0), ("h", 0.3, 0.0)], "feature string, xi double, shap double").withColumn("k", F.lit(1))
    assert [r["feature"] for r in selection.ordered(df, ["k"]).orderBy("place").collect()] == ["h", "g", "f"]
    with pytest.raises(ValueError):
        selection.ordered(df.drop("xi", "shap"), ["k"])


def test_quotas_refuse_small_classes():
    with pytest.raises(sampling.InfeasibleSample):
        sampling.quotas({"a": 50, "b": 2}, 20, minimum=3)
    assert sampling.quotas({"a": 50, "b": 3}, 20, minimum=3) == {"a": 17, "b": 3}


def test_deltas_need_a_baseline(spark):
    rows = [(1, 0, "m", 0.1, "x", "Vanilla", 1.0), (1, 0, "m", 0.1, "x", "SCP", 2.0), (2, 0, "m", 0.1, "x", "SCP", 2.0)]
    df = spark.createDataFrame(rows, "dataset_id int, seed int, base_model string, alpha double, metric string, method string, value double")
    assert conformal.paired_deltas(df.where("dataset_id = 1")).first()["delta"] == 1.0
    with pytest.raises(Exception, match="no Vanilla row for SCP 2"):
        conformal.paired_deltas(df).collect()


def test_means_need_all_seeds(spark):
    rows = [("mae", "m", 1, d, s, float(s)) for d in (1, 2) for s in range(5)]
    df = spark.createDataFrame(rows, "metric string, model string, ensemble int, dataset_id int, seed int, value double")
    assert ensembles.medians(ensembles.dataset_means(df)).first()["median_metric"] == 2.0
    with pytest.raises(Exception, match="4 rows where 5 seeds"):
        ensembles.dataset_means(df.where("dataset_id = 1 or seed > 0")).collect()


def test_no_support_for_a_mixed_model(spark):
    df = spark.createDataFrame([(k, "m", float(k), float(k)) for k in range(5)], "dataset_id int, model string, y double, x double")
    row = mixed.mixed_model(df, ["model"], "y", ["x"]).first()
    assert row["status"] == "insufficient_support" and row["feature"] is None


def test_weighted_method():
    """CalWCP against the definition, score by score."""
    rng = np.random.default_rng(8)
    cell = conformal_local.Cell(*(np.abs(rng.normal(size=12)), rng.normal(size=(12, 2)), np.abs(rng.normal(size=14)), rng.normal(size=(14, 2)), rng.normal(size=(9, 2))))
    got = conformal_local.METHODS["CalWCP"](cell, 0.2, rng)
    s, x, test, h = conformal_local._pooled(cell)
    for t, row in zip(got, test, strict=True):
        w = conformal_local.kernel(conformal_local.squared_distances(row[None], x), h)[0]
        can = [v for v in np.sort(s) if w[s <= v].sum() / (w.sum() + 1) >= 0.8 - 1e-12]
        assert t == (can[0] if can else np.inf)


def test_neighbour_blocks(spark, monkeypatch):
    """Blocks of the context give what one task would, ties and the row itself included."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 6, (120, 2)).astype(float)
    df = spark.createDataFrame([(0, k, *map(float, r)) for k, r in enumerate(x)], "d int, row_pos long, a double, b double")
    row, far = nearest(x, x, 4, own=True)
    for block in (1 << 16, 17):
        monkeypatch.setattr(instance_features, "CONTEXT_BLOCK", block)
        got = instance_features.neighbour_join(df, df, ["d"], ["a", "b"], 4, own=True).toPandas().sort_values(["q_pos", "place"])
        np.testing.assert_array_equal(got.c_pos.to_numpy().reshape(120, 4), row)
        np.testing.assert_allclose(got.distance.to_numpy().reshape(120, 4), far)


def test_groups_and_names(spark):
    assert selection.nested_groups(["a"], ["b"], ["c", "d"], ["d"]) == {"X": ["a"], "+Y": ["a", "b"], "+XY": ["a", "b", "c"], "+Aux": ["a", "b", "c", "d"]}
    with pytest.raises(ValueError):
        selection.nested_groups(["a"], ["a"], [], [])
    assert selection.predictors_of(["model", "a", "dim_ratio", "raw"], ["model"], raw_units=["raw"]) == ["a"]
    a, b = spark.range(1).withColumn("s", F.lit("x")), spark.range(1).withColumn("t", F.current_date()).withColumn("v", F.lit(1.5))
    assert preprocessing.text_columns(a, b) == ["s", "t"]
    assert all(m in registry.LOWER_IS_BETTER for own in registry.DEFAULT_RESPONSES.values() for m in own)
    points = regression.point_records(spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 3.0), (2, 4.0, 4.0)], "d int, y double, point_pred double"), ["d"]).collect()
    assert {(r["d"], r["r2"], r["metric_status"]) for r in points} == {(1, -1.0, "ok"), (2, None, "undefined")}
