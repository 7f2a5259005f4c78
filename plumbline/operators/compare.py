"""Comparisons of models over datasets."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import wilcoxon_p
from ..functions.scalar import correlation, finite
from .tables import average_rank


def model_comparison(table: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("model", "alpha"), places: int = 4) -> DataFrame:
    """Mean, median and sample spread of each metric, rounded half to even."""
    made = []
    for m in metrics:
        x = finite(F.col(m))
        made += [F.bround(F.avg(x), places).alias(f"{m}_mean"), F.bround(F.median(x), places).alias(f"{m}_median"), F.bround(F.stddev_samp(x), places).alias(f"{m}_std")]
    return table.groupBy(*keys).agg(*made)


def simple_means(table: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return table.groupBy(*keys).agg(*(F.avg(finite(F.col(m))).alias(m) for m in metrics))


def coverage_bias(table: DataFrame) -> DataFrame:
    """Dataset means first; then the share of datasets over and under nominal, and the mean."""
    means = table.groupBy("model", "alpha", "dataset_id").agg(F.avg(finite(F.col("cov_dev_signed"))).alias("dev"))
    return means.groupBy("model", "alpha").agg(F.avg((F.col("dev") > 0).cast("double")).alias("frac_over"), F.avg((F.col("dev") < 0).cast("double")).alias("frac_under"), F.avg("dev").alias("mean_signed_dev"))


def slab_availability(table: DataFrame, keys: Sequence[str] = ("model", "alpha")) -> DataFrame:
    there = finite(F.col("worst_slab_coverage")).isNotNull()
    return table.groupBy(*keys).agg(F.count_if(there).alias("n_finite"), F.count(F.lit(1)).alias("n_total"), F.avg(there.cast("double")).alias("frac_finite"))


def interval_efficiency(table: DataFrame) -> DataFrame:
    out = table.groupBy("alpha", "model").agg(*(f(finite(F.col(m))).alias(f"{m}_{n}") for m in ("avg_width_norm", "interval_score") for n, f in (("mean", F.avg), ("median", F.median))))
    return out.orderBy("alpha", "avg_width_norm_median", "model")


def dataset_means(table: DataFrame, metric: str, alpha: float | None = None) -> DataFrame:
    rows = table if alpha is None else table.where(F.col("alpha") == alpha)
    return rows.groupBy("dataset_id", "model").agg(F.avg(finite(F.col(metric))).alias("value"))


def worst_datasets(table: DataFrame, metric: str, alpha: float | None = None, n: int = 10) -> DataFrame:
    """The n largest dataset and model means; ties by dataset, then model."""
    return dataset_means(table, metric, alpha).orderBy(F.desc_nulls_last("value"), "dataset_id", "model").limit(n)


def model_extremes(table: DataFrame, metric: str, alpha: float | None = None, n: int = 5) -> DataFrame:
    """The n best and n worst datasets of each model by a metric of which less is better."""
    means = dataset_means(table, metric, alpha).where("value is not null")
    own = Window.partitionBy("model")
    placed = means.withColumns({"best": F.row_number().over(own.orderBy("value", "dataset_id")), "worst": F.row_number().over(own.orderBy(F.desc("value"), "dataset_id"))})
    ends = placed.withColumn("end", F.explode(F.array(F.struct(F.lit("best").alias("kind"), F.col("best").alias("place")), F.struct(F.lit("worst").alias("kind"), F.col("worst").alias("place")))))
    return ends.where(F.col("end.place") <= n).select("model", "end.kind", "end.place", "dataset_id", "value")


def wins(table: DataFrame, metric: str, alpha: float | None = None, ascending: bool = True) -> DataFrame:
    """How many datasets each model is best on; the first by name wins ties."""
    means = dataset_means(table, metric, alpha).where("value is not null")
    order = F.col("value").asc() if ascending else F.col("value").desc()
    first = means.withColumn("k", F.row_number().over(Window.partitionBy("dataset_id").orderBy(order, "model"))).where("k = 1")
    return first.groupBy("model").agg(F.count(F.lit(1)).alias("wins"))


def pairs(means: DataFrame) -> DataFrame:
    """Values of every two models on the datasets they share."""
    a, b = means.toDF("dataset_id", "model_a", "value_a"), means.toDF("dataset_id", "model_b", "value_b")
    return a.join(b, "dataset_id").where("model_a < model_b")


def pairwise_wilcoxon(table: DataFrame, metric: str, alpha: float | None = None) -> DataFrame:
    """Two-sided signed-rank tests of dataset means; p is null under 5 shared datasets."""

    @F.pandas_udf("double")
    def p(diff: pd.Series) -> float:
        return wilcoxon_p(diff.to_numpy())

    gap = F.col("value_a") - F.col("value_b")
    both = pairs(dataset_means(table, metric, alpha).where("value is not null")).withColumn("gap", gap)
    size = F.count(F.lit(1)).alias("n")
    stat = both.where("gap <> 0").withColumn("r", average_rank(F.abs("gap"), ["model_a", "model_b"]))
    stat = stat.groupBy("model_a", "model_b").agg(F.coalesce(F.sum(F.when(F.col("gap") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("gap") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"))
    out = both.groupBy("model_a", "model_b").agg(p("gap").alias("p_raw")).join(both.groupBy("model_a", "model_b").agg(size), ["model_a", "model_b"]).join(stat, ["model_a", "model_b"], "left")
    zero = F.lit(0.0)
    return out.select("model_a", "model_b", "n", F.coalesce("w_plus", zero).alias("w_plus"), F.least(F.coalesce("w_plus", zero), F.coalesce("w_minus", zero)).alias("statistic"), F.when(F.col("n") >= 5, F.col("p_raw")).alias("p"))


def ranking_agreement(table: DataFrame, metric: str, alpha: float | None = None) -> DataFrame:
    """Spearman correlation of every two models over shared datasets, 5 at least."""
    both = pairs(dataset_means(table, metric, alpha).where("value is not null"))
    keys = ["model_a", "model_b"]
    ranked = both.withColumns({"ra": average_rank(F.col("value_a"), keys), "rb": average_rank(F.col("value_b"), keys)})
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("ra"), F.col("rb")).alias("rho"))
    return out.where("n >= 5")
