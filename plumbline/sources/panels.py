"""Deterministic panels of predictions from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Levels of the panel's distributions.
LEVELS = [round(0.05 * k, 12) for k in range(1, 20)]
KEYS = ["dataset_id", "seed", "model"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reg_panel(spark: SparkSession, sf_dir: str, levels: list[float] | None = None) -> DataFrame:
    """150 cells of predicted numbers, with ``ppd`` over the levels."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 5").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_linestatus")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 10).alias("dataset_id"))
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    y = F.col("l_extendedprice") / 1000
    rows = lines.join(parts, "l_partkey").select(
        "dataset_id",
        (F.col("l_linenumber") - 1).alias("seed"),
        F.col("l_returnflag").alias("model"),
        y.alias("y"),
        (y * (1 + (F.col("l_discount") - F.lit(0.05)) * (1 + (flag + F.col("dataset_id")) % 3))).alias("point_pred"),
        (F.lit(0.05) + F.col("l_tax")).alias("spread"),
        F.col("l_discount").alias("x_disc"),
        F.col("l_tax").alias("x_tax"),
        F.col("l_quantity").cast("double").alias("x_qty"),
        F.col("l_linestatus").alias("c_status"),
        "l_orderkey", "l_partkey", "l_suppkey",
    )
    cell = Window.partitionBy(*KEYS)
    order = cell.orderBy("l_orderkey", "l_partkey", "l_suppkey", "y", "x_disc", "x_tax", "x_qty", "c_status")
    rows = rows.withColumns({"row_pos": (F.row_number().over(order) - 1).cast("long"), "n_test": F.count(F.lit(1)).over(cell)})
    ppd = F.array(*(F.col("point_pred") * (1 + (F.lit(q) - F.lit(0.5)) * F.col("spread")) for q in levels or LEVELS))
    return rows.withColumn("ppd", ppd).drop("l_orderkey", "l_partkey", "l_suppkey")


def clf_panel(spark: SparkSession, sf_dir: str, classes: int = 10) -> DataFrame:
    """Class probabilities of three models: softmax of ten dimensions each."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("dataset_id"), F.col("label").alias("y_idx"), "embedding")
    made = []
    for k in range(3):
        raw = F.transform(F.slice("embedding", k * classes + 1, classes), lambda v: F.exp(v.cast("double")))
        made.append(F.struct(F.lit(f"m{k}").alias("model"), raw.alias("raw")))
    out = rows.select("vec_id", "dataset_id", "y_idx", F.explode(F.array(*made)).alias("m")).select("vec_id", "dataset_id", "y_idx", "m.*")
    total = F.aggregate("raw", F.lit(0.0), lambda acc, v: acc + v)
    return out.withColumn("total", total).select("vec_id", "dataset_id", "model", "y_idx", F.transform("raw", lambda v: v / F.col("total")).alias("proba"))


def bin_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary outcome with a score that grows with the text's length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y"))
    return labels.join(docs, "doc_id").select("doc_id", "lang", "y", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"))


def feature_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide dataset features: means and spreads of numbers, shares of the first status."""
    rows = reg_panel(spark, sf_dir)
    return rows.groupBy("dataset_id", "seed").agg(F.avg("x_disc").alias("f_disc_mean"), F.stddev_pop("x_disc").alias("f_disc_sd"), F.avg("x_tax").alias("f_tax_mean"), F.avg("x_qty").alias("f_qty_mean"), F.stddev_pop("x_qty").alias("f_qty_sd"), F.avg("y").alias("f_y_mean"), F.stddev_pop("y").alias("f_y_sd"), F.avg((F.col("c_status") == "F").cast("double")).alias("f_status_share"), F.count(F.lit(1)).alias("n_context"), F.lit(4).alias("n_features"))
