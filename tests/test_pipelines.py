"""Runs from end to end: predictions, metrics, features, conformal experiments, exports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import reports
from plumbline.plans import pipelines
from plumbline.sources import store as S
from plumbline.sources.panels import KEYS, LEVELS, clf_panel, reg_panel

SF = "/root/testdata/sf0.001"


def _rows(spark, datasets=2):
    own = reg_panel(spark, SF).where(f"dataset_id < {datasets} and model = 'A'").drop("model", "ppd", "point_pred")
    return own.withColumns({"task": F.lit("regression"), "ratio": F.lit(1.0), "split": F.when(F.col("row_pos") % 2 == 0, "train").otherwise("test")})


def test_prediction_and_metrics_commands(spark, tmp_path):
    root, rows = str(tmp_path / "store"), str(tmp_path / "rows")
    _rows(spark).write.parquet(rows)
    assert pipelines.main(["predict", root, rows, "--features", "x_disc", "x_qty", "--step", "0.05"]) == 0
    store = S.Store(spark, [root])
    made = store.scan("predictions")
    assert made.where("size(ppd) <> 19").count() == 0 and {r[0] for r in made.select("model").distinct().collect()} == {"trees"}
    assert pipelines.main(["metrics", root, "--step", "0.05", "--alphas", "0.1"]) == 0
    names = {r[0] for r in store.scan("metrics").select("metric").distinct().collect()}
    assert {"r2", "crps_mean", "interval_score", "pit_ece"} <= names
    # Nothing is left to do.
    todo = store.pending("predictions", _rows(spark).select("task", "dataset_id", "seed", "ratio").distinct().withColumn("model", F.lit("trees")), pipelines.KEYS)
    assert todo.count() == 0


def test_classification_metrics(spark, tmp_path):
    store = S.Store(spark, [str(tmp_path)])
    rows = clf_panel(spark, SF).withColumns({"task": F.lit("classification"), "seed": F.lit(0), "ratio": F.lit(1.0)})
    store.save(rows, "predictions")
    made = pipelines.metrics_run(store, LEVELS, task="classification", n_classes=10).toPandas()
    accuracy = rows.groupBy("dataset_id", "model").agg(F.avg((F.array_position("proba", F.array_max("proba")) - 1 == F.col("y_idx")).cast("double")).alias("a")).toPandas().set_index(["dataset_id", "model"]).a.sort_index()
    got = made[made.metric == "accuracy"].set_index(["dataset_id", "model"]).value.sort_index()
    np.testing.assert_allclose(got, accuracy)
    assert {"log_loss", "brier_score", "macro_f1", "cmce_em", "classwise_ece_ew"} <= set(made.metric)


def test_point_records_have_r2_alone(spark, tmp_path):
    store = S.Store(spark, [str(tmp_path)])
    rows = reg_panel(spark, SF).where("dataset_id = 1").withColumns({"task": F.lit("regression"), "ratio": F.lit(1.0)})
    store.save(rows.withColumn("ppd", F.when(F.col("model") != "A", F.col("ppd"))), "predictions")
    made = pipelines.metrics_run(store, LEVELS).toPandas()
    assert set(made[made.model == "A"].metric) == {"r2"} and "crps_mean" in set(made[made.model == "N"].metric)


def test_feature_command(spark, tmp_path):
    root, rows = str(tmp_path / "store"), str(tmp_path / "rows")
    _rows(spark).write.parquet(rows)
    assert pipelines.main(["features", root, rows, "--features", "x_disc", "x_qty", "--groups", *pipelines.FEATURE_GROUPS]) == 0
    made = S.Store(spark, [root]).scan("dataset_features")
    assert made.count() == 10 and {"max_abs_pearson", "linear_r2", "hs_dof", "mi_max", "tree_min_depth"} <= set(made.columns)


def test_added_feature_group(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(pipelines.FEATURE_GROUPS, "size", lambda rows, keys, numeric, categorical, y: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("own_size")))
    made = pipelines.feature_run(S.Store(spark, [str(tmp_path)]), _rows(spark, 1), ["x_qty"], groups=["size", "moments"])
    assert made.agg(F.sum("own_size")).first()[0] == _rows(spark, 1).count()


def test_conformal_commands(spark, tmp_path):
    root, out = str(tmp_path / "store"), str(tmp_path / "out")
    rows = reg_panel(spark, SF).where("dataset_id < 2 and seed = 0 and model <> 'R'").withColumns({"task": F.lit("regression"), "ratio": F.lit(1.0)})
    role = F.when(F.col("row_pos") < F.col("n_test") / 4, "train").when(F.col("row_pos") < F.col("n_test") / 2, "cal").otherwise("test")
    S.Store(spark, [root]).save(rows.withColumn("role", role), "predictions")
    args = ["conformal-run", root, "--features", "x_qty", "x_tax", "--alphas", "0.1", "--step", "0.05"]
    assert pipelines.main(args) == 0
    assert pipelines.main(["conformal-evaluate", root]) == 0 and pipelines.main(["conformal-summarize", root, out]) == 0
    summary = spark.read.csv(f"{out}/summary.csv", header=True)
    assert summary.select("method").distinct().count() == 11 and set(summary.columns) >= {"mean_delta", "frac_negative"}
    with pytest.raises(ValueError, match="alphas"):
        pipelines.main([*args[:-3], "0.2", "--step", "0.05"])


def test_table_commands(spark, tmp_path):
    rows = [("regression", d, m, s, e, "mae", d + s * 0.1 + "ab".index(m) / e) for d in range(4) for m in "ab" for s in range(5) for e in (1, 4)]
    trials = spark.createDataFrame(rows, S.TRIALS)
    S.write_tsv(trials, str(tmp_path / "t"))
    assert pipelines.main(["ensemble-tables", str(tmp_path / "t"), str(tmp_path / "e")]) == 0
    got = {(r["model"], r["ensemble"]): float(r["median_metric"]) for r in spark.read.csv(f"{tmp_path}/e/ensemble_medians.csv", header=True).collect()}
    assert got["a", "1"] == pytest.approx(1.7) and got["b", "4"] == pytest.approx(1.95)
    S.write_tsv(trials.where("ensemble = 1"), str(tmp_path / "t1"))
    assert pipelines.main(["benchmark-tables", str(tmp_path / "t1"), str(tmp_path / "b")]) == 0
    ranks = spark.read.csv(f"{tmp_path}/b/rank_intervals.csv", header=True).collect()
    assert {r["model"]: float(r["mean_rank"]) for r in ranks} == {"a": 1.0, "b": 2.0}


def test_instance_analysis_leaves_raw_units_out(spark):
    rows = reg_panel(spark, SF).withColumns({"alpha": F.lit(0.1), "covered": (F.abs(F.col("y") / F.col("point_pred") - 1) < F.col("spread") / 2).cast("int")})
    made = pipelines.instance_analysis(rows, ["x_qty", "x_disc", "y"], {"covered": True}, raw_units=["y"])["covered"].toPandas()
    assert set(made.feature) == {"x_qty", "x_disc"} and made.n_groups.eq(10).all()


# --------------------------------------------------------------------------- sinks
def test_json_lines_in_order(spark, tmp_path):
    rows = spark.range(50).repartition(3)
    S.write_json_lines(rows, str(tmp_path / "j"), {"version": 2})
    import gzip

    lines = [x for p in sorted((tmp_path / "j").glob("part-*")) for x in (gzip.open(p, "rt") if p.suffix == ".gz" else p.open())]
    kinds = [json.loads(x)["type"] for x in lines]
    assert kinds == ["metadata", *["metric"] * 50, "complete"] and json.loads(lines[-1])["rows"] == 50
    assert S.json_lines_metadata(spark, str(tmp_path / "j")) == {"version": 2}
    S.write_text(spark, f"{tmp_path}/j/part-~.txt", json.dumps({"type": "complete", "rows": 49}) + "\n")
    with pytest.raises(ValueError, match="complete"):
        S.read_json_lines(spark, str(tmp_path / "j"), rows.schema)


def test_models_are_whole_or_absent(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler

    path = str(tmp_path / "m")
    assert not S.model_exists(spark, path)
    S.save_model(spark, VectorAssembler(inputCols=["a"], outputCol="b"), path)
    assert S.model_exists(spark, path)
    (tmp_path / "m" / "more").write_text("left by another run")
    assert not S.model_exists(spark, path)


def test_checkpoint_folders(spark, tmp_path):
    own, other = str(tmp_path / "own"), tmp_path / "other"
    S.make_checkpoints(spark, own)
    S.make_checkpoints(spark, own)
    S.drop_checkpoints(spark, own)
    assert not (tmp_path / "own").exists()
    other.mkdir()
    (other / "x").write_text("keep")
    for call in (S.make_checkpoints, S.drop_checkpoints):
        with pytest.raises(ValueError):
            call(spark, str(other))
    assert (other / "x").exists()


def test_validation_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    a = S.write_validation(spark, f"{tmp_path}/validation.json", {"duplicates": 0}, {"rows": rows})
    b = S.write_validation(spark, f"{tmp_path}/validation.json", {"duplicates": 3}, {"rows": rows.orderBy(F.desc("k")), "none": rows.where("false")})
    assert a["ok"] and not b["ok"] and a["sources"]["rows"] == b["sources"]["rows"] and b["sources"]["none"] is None
    assert json.loads((tmp_path / "validation.json").read_text())["checks"] == {"duplicates": 3}


def test_pages(spark):
    rows = spark.createDataFrame([("m<1>", "mae", "f", 1, 0.5, 0.25), ("m2", "mae", "g", 1, None, 0.125)], "model string, response string, feature string, place int, coef double, cv_r2 double")
    page = reports.fit_quality_page({"trees": rows})
    assert "m&lt;1&gt;" in page and "0.25" in page and page.startswith("<!DOCTYPE html>")
    assert reports.selection_page({"selected": rows}).count("<tr>") == 3 and "coef" in reports.model_effects_page(rows)
    digest = reports.Digest().section("rows", spark.range(30), 20).render()
    assert "... 10 more rows" in digest


def test_scan_of_many_specs(spark, tmp_path):
    store = S.Store(spark, [str(tmp_path)])
    rows = spark.range(40).select(F.lit("regression").alias("task"), (F.col("id") % 8).cast("int").alias("dataset_id"), (F.col("id") % 5).cast("int").alias("seed"), F.lit(1.0).alias("ratio"), F.lit("m").alias("model"))
    store.save(rows, "metrics")
    wanted = [S.Spec(d, s, 1.0) for d in range(3) for s in range(2)]
    got = {(r["dataset_id"], r["seed"]) for r in store.scan("metrics", specs=wanted).collect()}
    assert got == {(r["dataset_id"], r["seed"]) for r in rows.collect()} & {(s.dataset_id, s.seed) for s in wanted}
    assert KEYS == ["dataset_id", "seed", "model"]
