"""Long and wide tables: trials, seed means, peer-relative values, pair deltas.

Keys are columns; a missing alpha is null and means that the metric has no level.
Values that are NaN or infinite are null before they are averaged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, ratio
from .registry import ABSOLUTE_DELTA, axis_direction, category, direction, scale, signed

KEYS = ("dataset_id", "model", "seed", "ratio")


# --------------------------------------------------------------------------- trials
def trials(long: DataFrame, task: str, ensemble: int = 8) -> DataFrame:
    """(task, dataset_id, model, seed, ensemble, metric, value); the metric's name has its
    level: alpha_free.per_dataset.x or alpha_dependent.<alpha>.per_dataset.x."""
    level = F.when(F.col("alpha").isNull(), "alpha_free").otherwise(F.concat(F.lit("alpha_dependent."), F.col("alpha").cast("string")))
    return long.select(F.lit(task).alias("task"), "dataset_id", "model", "seed", F.lit(ensemble).alias("ensemble"), F.concat_ws(".", level, F.lit("per_dataset"), "metric").alias("metric"), "value")


def aggregate_trials(trial: DataFrame) -> DataFrame:
    """Seed means and the number of seeds that have a value."""
    return trial.groupBy("task", "dataset_id", "model", "ensemble", "metric").agg(F.avg(finite(F.col("value"))).alias("mean_across_five_splits"), F.count(finite(F.col("value"))).alias("n_seeds"))


def feature_means(features: DataFrame, task: str) -> DataFrame:
    """Seed means of every feature of long (dataset_id, seed, feature, value)."""
    return features.groupBy(F.lit(task).alias("task"), "dataset_id", "feature").agg(F.avg(finite(F.col("value"))).alias("mean_across_five_splits"), F.count(finite(F.col("value"))).alias("n_seeds"))


def normalised_crps(trial: DataFrame, scales: DataFrame, name: str = "alpha_free.per_dataset.crps_mean") -> DataFrame:
    """``trial`` and further rows: CRPS over the training response's spread, 1e-10 at least."""
    made = trial.where(F.col("metric") == name).join(scales, ["task", "dataset_id", "seed"], "left")
    value = F.col("value") / F.greatest(F.col("training_response_std"), F.lit(1e-10))
    return trial.unionByName(made.select("task", "dataset_id", "model", "seed", "ensemble", F.lit(name.replace("crps_mean", "normalized_crps")).alias("metric"), value.alias("value")))


def ensemble_panel(trial: DataFrame, labels: dict[str, str], alpha: str = "0.1") -> DataFrame:
    """Rows of ensembles whose metric is alpha-free or of one level, with a label."""
    wanted = F.col("metric").startswith("alpha_free.") | F.col("metric").startswith(f"alpha_dependent.{alpha}.")
    last = F.element_at(F.split("metric", r"\."), -1)
    named = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return trial.where((F.col("ensemble") > 0) & wanted).withColumn("label", F.try_element_at(named, last)).where("label is not null")


# --------------------------------------------------------------------------- long and wide
def unpivoted(wide: DataFrame, ids: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as (metric, value) rows; text and flags are left out."""
    numeric = [f.name for f in wide.schema if f.name not in {*ids, *skip} and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")]
    return wide.select(*ids, *(F.col(c).cast("double").alias(c) for c in numeric)).unpivot(list(ids), numeric, "metric", "value")


def metrics_table(long: DataFrame, metrics_free: Sequence[str], metrics_alpha: Sequence[str], keys: Sequence[str] = ("dataset_id", "model", "seed")) -> DataFrame:
    """Wide: a row for each key and alpha; alpha-free metrics are repeated on each level."""
    keys = list(keys)
    by_level = long.where("alpha is not null").groupBy(*keys, "alpha").pivot("metric", list(metrics_alpha)).agg(F.first("value"))
    free = long.where("alpha is null").groupBy(*keys).pivot("metric", list(metrics_free)).agg(F.first("value"))
    return free.join(by_level, keys, "left").withColumn("nominal_coverage", 1.0 - F.col("alpha"))


def eval_table(metrics: DataFrame, features: DataFrame) -> DataFrame:
    """Metrics with dataset features by (dataset_id, seed); shared names keep the metrics'
    column.  ``features_missing`` marks rows without features; the ratio of context rows to
    features is added where both counts are there."""
    fresh = [c for c in features.columns if c in ("dataset_id", "seed") or c not in metrics.columns]
    out = metrics.join(features.select(*fresh).withColumn("has_features", F.lit(True)), ["dataset_id", "seed"], "left")
    out = out.withColumn("features_missing", F.col("has_features").isNull()).drop("has_features")
    if {"n_context", "n_features"} <= set(out.columns):
        out = out.withColumn("context_to_feature_ratio", F.when(F.col("n_features") > 0, ratio(F.col("n_context"), F.col("n_features"))))
    return out


def average_table(table: DataFrame, values: Sequence[str], keys: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """Seed means of ``values``; other columns keep their first value by seed."""
    keep = [F.min_by(c, F.struct("seed")).alias(c) for c in first]
    return table.groupBy(*keys).agg(*(F.avg(finite(F.col(c))).alias(c) for c in values), *keep)


def slice_by(table: DataFrame, column: str, value: object) -> DataFrame:
    """Rows with the value; None finds missing ones."""
    return table.where(F.col(column).eqNullSafe(F.lit(value)))


def slice_alpha(table: DataFrame, alpha: float | None, once_at: float | None = None) -> DataFrame:
    """Rows of a level; without one the alpha-free values once: those without a level and
    those of ``once_at``; without either all rows."""
    if alpha is not None:
        return table.where(F.col("alpha") == F.lit(alpha))
    if once_at is not None:
        return table.where(F.col("alpha").isNull() | (F.col("alpha") == F.lit(once_at)))
    return table


def filter_ratio(table: DataFrame, ratio_value: object) -> DataFrame:
    """Rows whose ratio equals the value, as a number within rounding or else as text."""
    number = F.expr("try_cast(ratio as double)")
    try:
        want = float(ratio_value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return table.where(F.col("ratio").cast("string") == str(ratio_value))
    return table.where(F.abs(number - want) <= 1e-8 + 1e-5 * abs(want))


def ensembles(table: DataFrame) -> DataFrame:
    return table.select("n_estimators").distinct().orderBy(F.asc_nulls_last("n_estimators"))


# --------------------------------------------------------------------------- ranks and peers
def average_rank(value: Column, keys: Sequence[str], ascending: bool = True) -> Column:
    """The rank within keys, ties sharing the mean of their places."""
    own = Window.partitionBy(*keys)
    order = value.asc() if ascending else value.desc()
    return F.rank().over(own.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def ranks(long: DataFrame, keys: Sequence[str], value: str = "value", metric: str = "metric") -> DataFrame:
    """``long`` with ``rank``: models within keys and metric, best first; metrics without
    direction are ranked as if lower were better."""
    return long.withColumn("signed", signed(F.col(metric), F.col(value))).withColumn("rank", average_rank(F.col("signed"), [*keys, metric])).drop("signed")


def joint_ranks(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean place of each ensemble size among all (model, ensemble) configurations of a
    dataset, scaled to 0..1."""
    placed = long.withColumn("signed", signed(F.col("metric"), F.col("value"))).withColumn("rank", average_rank(F.col("signed"), ["metric", *keys])).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("metric", *keys)))
    mean = placed.groupBy("metric", "model", "ensemble").agg(F.avg("rank").alias("mean_rank"), F.max("n").alias("n"))
    return mean.groupBy("metric", "ensemble").agg(F.avg(ratio(F.col("mean_rank") - 1, F.col("n") - 1)).alias("normalised_rank"))


def peer_z(table: DataFrame, metrics: Sequence[str], keys: Sequence[str], peers: Sequence[str] | None = None, bias: bool = False) -> DataFrame:
    """Each metric as its z-score among peer models of the same keys, signed so that higher
    is better (biases keep their sign); null where all peers agree or there are under two."""
    own = Window.partitionBy(*keys)
    peer = F.col("model").isin(list(peers)) if peers else F.lit(True)
    rows = table.where(peer)
    some = F.size(F.collect_set("model").over(own)) >= 2
    out = {}
    for m in metrics:
        sign = axis_direction(m, bias)
        if sign is not None:
            x = finite(F.col(m))
            out[m] = F.when(some, ratio(x - F.avg(x).over(own), F.nullif(F.stddev_pop(x).over(own), F.lit(0.0))) * float(sign))
    return rows.select(*[c for c in rows.columns if c not in metrics], *(v.alias(m) for m, v in out.items()))


def pair_delta(table: DataFrame, a: str, b: str, metrics: Sequence[str], keys: Sequence[str], features: Sequence[str] = ()) -> DataFrame:
    """Signed change from model a to model b, positive where b is better: relative, or
    absolute for bounded metrics; metrics without direction are left out."""
    use = [m for m in metrics if direction(m)]
    left = table.where(F.col("model") == a).select(*keys, *features, *(finite(F.col(m)).alias(f"a_{m}") for m in use))
    right = table.where(F.col("model") == b).select(*keys, *(finite(F.col(m)).alias(f"b_{m}") for m in use))
    made = []
    for m in use:
        gap = F.col(f"b_{m}") - F.col(f"a_{m}")
        made.append((float(direction(m)) * (gap if m in ABSOLUTE_DELTA else ratio(gap, F.col(f"a_{m}")))).alias(m))
    return left.join(right, list(keys)).select(*keys, *features, F.lit(f"{a}_vs_{b}").alias("model"), *made).dropna("all", subset=use)


def binary_delta(delta: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return delta.select(*[c for c in delta.columns if c not in metrics], *((F.col(m) > 0).cast("int").alias(m) for m in metrics))


def winsorise(table: DataFrame, column: str, keys: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``column`` held between its group's quantiles; ``clipped`` marks changed rows."""
    edges = table.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("edges"))
    joined = table.join(edges, list(keys))
    held = F.least(F.greatest(F.col(column), F.col("edges")[0]), F.col("edges")[1])
    return joined.withColumns({"clipped": held != F.col(column), column: held}).drop("edges")


def instance_table(features: DataFrame, outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Instance features with outcomes by keys and row_pos, only of cells whose row counts agree."""
    n_f, n_o = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_f")), outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_o"))
    good = n_f.join(n_o, list(keys)).where("n_f = n_o").select(*keys)
    joined = features.join(outcomes, [*keys, "row_pos"]).join(good, list(keys), "left_semi")
    return joined.withColumn("miscovered", 1 - F.col("covered"))


def fit_quality(fits: DataFrame, ids: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """One row a fit and score, with the response's category and scale."""
    unique = fits.dropDuplicates(list(ids)).select(*ids, *(F.col(c).cast("double").alias(c) for c in scores))
    known = lambda f: F.create_map(*(F.lit(x) for m in _metrics() for x in (m, f(m))))
    out = unique.unpivot(list(ids), list(scores), "score", "value")
    return out.withColumns({"category": F.coalesce(F.try_element_at(known(category), F.col("response")), F.lit("other")), "scale": F.coalesce(F.try_element_at(known(scale), F.col("response")), F.lit("scale_free"))})


def _metrics() -> list[str]:
    from .registry import LOWER_IS_BETTER

    return list(LOWER_IS_BETTER)


def importance_summary(parts: Sequence[DataFrame]) -> DataFrame:
    """Results of several fits one below the other, missing columns null."""
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def importances_with_xi(importances: DataFrame, xi: DataFrame) -> DataFrame:
    return importances.join(xi.select("feature", "xi"), "feature", "left")


def training_scale(train: DataFrame, task: str) -> DataFrame:
    """Population spread of the training response of each dataset and seed."""
    return train.groupBy("dataset_id", "seed").agg(F.count(F.lit(1)).alias("n_train"), F.stddev_pop("y").alias("training_response_std")).select(F.lit(task).alias("task"), "dataset_id", "seed", "n_train", "training_response_std")
