"""Queries and operators use all of their rows."""

import numpy as np
import pytest

from plumbline.functions import neighbours
from plumbline.operators import dataset_features, regression
from plumbline.plans.queries import QUERIES
from plumbline.sources.panels import reg_panel

from .oracle import SF


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("n", [3, 12, 200])
def test_nearest(own, n, monkeypatch):
    """As by all distances, with ties and over several blocks."""
    monkeypatch.setattr(neighbours, "BLOCK", 500)
    rng = np.random.default_rng(n)
    fit = rng.integers(0, 4, (n, 3)).astype(float)
    x = fit if own else rng.integers(0, 4, (37, 3)).astype(float)
    d2 = ((x[:, None] - fit[None]) ** 2).sum(2)
    if own:
        np.fill_diagonal(d2, np.inf)
    want = np.argsort(d2, 1, kind="stable")[:, : min(5, n - own)]
    rows, far = neighbours.nearest(fit, x, 5, own)
    assert (rows == want).all() and np.allclose(far, np.sqrt(np.take_along_axis(d2, want, 1)))


def test_matrix_features_use_all_rows(spark):
    """A tree has as many leaves as the root of all rows; every dataset and seed has features."""
    rng = np.random.default_rng(0)
    n = 3600
    rows = spark.createDataFrame([(1, *map(float, v)) for v in rng.normal(size=(n, 3))], "dataset_id long, a double, b double, y double")
    assert dataset_features.matrix_features(rows, ["dataset_id"], ["a", "b"]).first()["tree_leaves"] == 60
    cells = {tuple(r) for r in reg_panel(spark, SF).select("dataset_id", "seed").distinct().collect()}
    got = QUERIES["x_matrix_features"].run(spark, SF).collect()
    assert {(r["dataset_id"], r["seed"]) for r in got} == cells and len(got) == len(cells) == 50


def test_distance_features_of_every_cell(spark):
    """Each row of every second half has features; those of a cell equal all distances'."""
    panel = reg_panel(spark, SF)
    keys = ["dataset_id", "seed", "model", "row_pos"]
    got = QUERIES["i_distance_features"].run(spark, SF).toPandas()
    want = panel.where(regression.in_second_half()).select(*keys)
    assert sorted(map(tuple, got[keys].to_numpy().tolist())) == sorted(tuple(r) for r in want.collect())
    cell = panel.where("dataset_id = 3 and seed = 2 and model = 'N'").withColumn("late", regression.in_second_half()).toPandas().sort_values("row_pos")
    x = cell[["x_disc", "x_tax", "x_qty"]].to_numpy(float)
    late = cell["late"].to_numpy(bool)
    a, b = ((x[s] - x[~late].mean(0)) / x[~late].std(0) for s in (late, ~late))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    d.sort(1)
    own = got[(got["dataset_id"] == 3) & (got["seed"] == 2) & (got["model"] == "N")].sort_values("row_pos")
    assert np.allclose(own["knn_1"], d[:, 0], atol=1e-9) and np.allclose(own["knn_10"], d[:, :10].mean(1), atol=1e-9)
