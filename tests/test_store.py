"""Stores, exchange formats, pipelines and the stream."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import conformal
from plumbline.plans import pipelines
from plumbline.sources import store as S
from plumbline.sources.panels import KEYS, LEVELS, reg_panel
from plumbline.streaming.coverage import windowed_coverage, with_bounds

SF = "/root/testdata/sf0.001"


def _predictions(spark):
    return reg_panel(spark, SF).where("dataset_id < 3").withColumns({"task": F.lit("regression"), "ratio": F.lit(1.0)})


def test_metrics_run_and_prune(spark, tmp_path):
    store = S.Store(spark, [str(tmp_path)])
    store.save(_predictions(spark), "predictions")
    made = pipelines.metrics_run(store, LEVELS, numeric=["x_qty"])
    assert made.count() > 0
    assert store.pending("metrics", store.scan("predictions").select(*pipelines.KEYS).distinct(), pipelines.KEYS).count() == 0
    plan = store.scan("predictions", specs=[S.Spec(1, 0, 1.0)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dataset_id" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert [r["model"] for r in store.models(S.Spec(1, 0, 1.0)).collect()] == ["A", "N", "R"]


def test_first_root_wins(spark, tmp_path):
    a, b = S.Store(spark, [str(tmp_path / "a")]), S.Store(spark, [str(tmp_path / "b")])
    row = lambda v: spark.createDataFrame([("regression", 1, 0, 1.0, "m", v)], "task string, dataset_id int, seed int, ratio double, model string, value double")
    a.save(row(1.0), "metrics")
    b.save(row(2.0), "metrics")
    both = S.Store(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert [r["value"] for r in both.scan("metrics").collect()] == [1.0]
    with pytest.raises(FileNotFoundError):
        both.scan("models")


def test_exchange_formats(spark, tmp_path):
    rows = spark.createDataFrame([("regression", 1, "m", 0, 8, "mae", 0.5), ("regression", 2, "m", 0, 8, "mae", None)], S.TRIALS)
    S.write_tsv(rows, str(tmp_path / "t"))
    assert S.read_tsv(spark, str(tmp_path / "t")).exceptAll(rows).count() == 0
    S.write_json_lines(rows, str(tmp_path / "j"), {"version": 1})
    assert S.read_json_lines(spark, str(tmp_path / "j"), S.TRIALS).exceptAll(rows).count() == 0
    (tmp_path / "ids").write_text("# ids\n1\n\n2\n2\n")
    assert sorted(r[0] for r in S.read_ids(spark, str(tmp_path / "ids")).collect()) == [1, 2]
    names = spark.createDataFrame([("x/dataset_12_seed_3_ratio_1.0__rf.pkl",), ("other",)], "path string")
    got = S.parse_file_names(names).collect()
    assert (got[0]["dataset_id"], got[0]["seed"], got[0]["ratio"], got[0]["model"]) == (12, 3, 1.0, "rf") and got[1]["dataset_id"] is None


def test_protocol_is_claimed_once(spark, tmp_path):
    S.claim_protocol(spark, str(tmp_path), "v1", 10)
    S.claim_protocol(spark, str(tmp_path), "v1", 10)
    with pytest.raises(ValueError):
        S.claim_protocol(spark, str(tmp_path), "v2", 10)


def test_conformal_run(spark):
    rows = conformal.quarter_roles(reg_panel(spark, SF).where("dataset_id = 1 and seed = 0"), KEYS)
    got = pipelines.conformal_run(rows, KEYS, LEVELS, [0.1], ["x_qty", "x_tax"])
    assert got.select("method").distinct().count() == 12


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_coverage(with_bounds(stream, 5.0, 50.0)).writeStream.outputMode("complete").format("memory").queryName("cov").start()
    query.processAllAvailable()
    query.stop()
    want = windowed_coverage(with_bounds(events.withColumn("ts", F.col("ts").cast("timestamp")), 5.0, 50.0))
    assert spark.table("cov").exceptAll(want).count() == 0 and want.count() == spark.table("cov").count()
