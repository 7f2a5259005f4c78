"""Summaries of ensemble sizes: seed means of datasets, medians over datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ("metric", "model", "ensemble")


def dataset_means(trials: DataFrame, seeds: int = 5, keys: Sequence[str] = GROUP) -> DataFrame:
    """Means over seeds of every dataset; an error where there are not exactly ``seeds`` rows."""
    made = trials.groupBy(*keys, "dataset_id").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("__n"))
    wrong = F.raise_error(F.concat_ws(" ", F.col("__n").cast("string"), F.lit(f"rows where {seeds} seeds are due:"), *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in (*keys, "dataset_id"))))
    return made.withColumn("value", F.when(F.col("__n") != seeds, wrong.cast("double")).otherwise(F.col("value"))).drop("__n")


def medians(means: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Medians of equal weight over datasets, and how many there are."""
    return means.groupBy(*keys).agg(F.median("value").alias("median_metric"), F.count_distinct("dataset_id").alias("n_datasets"))


def interval_medians(means: DataFrame, coverages: Sequence[str], width: str, keys: Sequence[str] = ("ensemble", "model")) -> DataFrame:
    """For each kind of coverage its median beside that of the width; datasets with a coverage count."""
    own = means.where(F.col("metric").isin(*coverages, width))
    kind = F.explode(F.array(*map(F.lit, coverages)))
    each = own.select(*keys, "dataset_id", "metric", "value", kind.alias("coverage_type"))
    mine = F.col("metric") == F.col("coverage_type")
    made = each.groupBy(*keys, "coverage_type").agg(F.median(F.when(mine, F.col("value"))).alias("coverage"), F.median(F.when(F.col("metric") == width, F.col("value"))).alias("width"), F.count_if(mine).alias("n_datasets"))
    return made.where("n_datasets > 0")


def panel_summary(rows: DataFrame, keys: Sequence[str], value: str, first: Sequence[str] = ()) -> DataFrame:
    """Mean and sample standard deviation of a value, and the columns of ``first`` as they are in
    the row of the smallest repeat."""
    return rows.groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}"), F.stddev_samp(value).alias(f"sd_{value}"), *(F.min_by(c, "repeat").alias(c) for c in first))
