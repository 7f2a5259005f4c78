"""Metrics of predicted class probabilities.

Input: one row a test instance with key columns, ``y_idx`` (0-based class) and ``proba``
(array over the classes).  Binned differences are two-level aggregates; only class-wise
and cumulative calibration explode a row, into as many rows as there are classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import edge_bin, ratio, right_closed_bin

BINS = 15


def instance_columns(rows: DataFrame) -> DataFrame:
    """confidence, pred_label (first maximum), hit_top1, true_prob, brier_row, logloss_row,
    rank_true (1-based; ties by class) and mass_at_true of each row."""
    p, y = F.col("proba"), F.col("y_idx")
    top = F.array_max(p)
    truth = F.get(p, y)
    ahead = F.filter(F.transform(p, lambda v, k: F.struct(v.alias("v"), k.alias("k"))), lambda s: (s["v"] > truth) | ((s["v"] == truth) & (s["k"] < y)))
    brier = F.aggregate(F.transform(p, lambda v, k: F.pow(v - F.when(k == y, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, v: a + v)
    return rows.withColumns({
        "confidence": top,
        "pred_label": (F.array_position(p, top) - 1).cast("int"),
        "hit_top1": ((F.array_position(p, top) - 1) == y).cast("int"),
        "true_prob": truth,
        "brier_row": brier,
        "logloss_row": -F.log(F.least(F.greatest(truth, F.lit(1e-12)), F.lit(1 - 1e-12))),
        "rank_true": (F.size(ahead) + 1).cast("int"),
        "mass_at_true": F.aggregate(ahead, F.lit(0.0), lambda a, s: a + s["v"]) + truth,
    })


def equal_mass_bin(rows: DataFrame, keys: Sequence[str], score: str, n: int) -> DataFrame:
    """``rows`` with ``bin_em``: by linear quantile edges of the score within each cell."""
    edges = rows.groupBy(*keys).agg(F.percentile(score, F.array(*(F.lit(k / n) for k in range(1, n)))).alias("edges"))
    return rows.join(edges, list(keys)).withColumn("bin_em", edge_bin(F.col(score), F.col("edges"))).drop("edges")


def binned_difference(rows: DataFrame, keys: Sequence[str], score: str, target: str, bin_col: str, ece: str, mce: str) -> DataFrame:
    """Count-weighted mean and maximum over bins of |mean target - mean score|."""
    each = rows.groupBy(*keys, bin_col).agg(F.abs(F.avg(target) - F.avg(score)).alias("d"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(*keys).agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias(ece), F.max("d").alias(mce))


def _both_binnings(rows: DataFrame, keys: list[str], score: str, target: str, name: str, n: int) -> DataFrame:
    binned = equal_mass_bin(rows, keys, score, n).withColumn("bin_ew", right_closed_bin(F.col(score), n))
    width = binned_difference(binned, keys, score, target, "bin_ew", f"{name}_ece_ew", f"{name}_mce_ew")
    mass = binned_difference(binned, keys, score, target, "bin_em", f"{name}_ece_em", f"{name}_mce_em")
    return width.join(mass, keys)


def top_label(rows: DataFrame, keys: Sequence[str], n: int = BINS) -> DataFrame:
    keys = list(keys)
    accuracy = rows.groupBy(*keys).agg(F.avg("hit_top1").alias("accuracy"))
    return accuracy.join(_both_binnings(rows, keys, "confidence", "hit_top1", "confidence", n), keys)


def per_class(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each instance and class: k, p, is_k."""
    return rows.select(*keys, "y_idx", F.posexplode("proba").alias("k", "p")).withColumn("is_k", (F.col("k") == F.col("y_idx")).cast("int"))


def classwise(rows: DataFrame, keys: Sequence[str], n: int = BINS) -> DataFrame:
    """One-vs-rest calibration: the mean of the classes' ECE and the largest MCE."""
    keys = list(keys)
    each = _both_binnings(per_class(rows, keys), [*keys, "k"], "p", "is_k", "c", n)
    return each.groupBy(*keys).agg(F.avg("c_ece_ew").alias("classwise_ece_ew"), F.max("c_mce_ew").alias("classwise_mce_ew"), F.avg("c_ece_em").alias("classwise_ece_em"), F.max("c_mce_em").alias("classwise_mce_em"))


def nested_sets(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(mass, inside) of the most likely 1, 2, ... classes of each row."""
    order = F.array_sort(F.transform("proba", lambda v, k: F.struct((-v).alias("v"), k.alias("k"))))
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(False).alias("inside"), F.array().cast("array<struct<mass:double,inside:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        mass, inside = acc["mass"] - s["v"], acc["inside"] | (s["k"] == F.col("y_idx"))
        return F.struct(mass.alias("mass"), inside.alias("inside"), F.array_append(acc["out"], F.struct(mass.alias("mass"), inside.cast("int").alias("inside"))).alias("out"))

    return rows.select(*keys, F.explode(F.aggregate(order, start, step, lambda a: a["out"])).alias("s")).select(*keys, "s.mass", "s.inside")


def cumulative_mass(rows: DataFrame, keys: Sequence[str], n: int = BINS) -> DataFrame:
    """cmce_ew and cmce_em: calibration of the mass of nested sets."""
    keys = list(keys)
    # Masses are rounded so that sums in another order fall into the same bins.
    pairs = nested_sets(rows, keys).withColumn("mass", F.round("mass", 10))
    out = _both_binnings(pairs, keys, "mass", "inside", "c", n)
    return out.select(*keys, F.col("c_ece_ew").alias("cmce_ew"), F.col("c_ece_em").alias("cmce_em"))


def proper_scores(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg("brier_row").alias("brier_score"), F.avg("logloss_row").alias("log_loss"))


def auc(rows: DataFrame, keys: Sequence[str], score: str, target: str) -> DataFrame:
    """The Mann-Whitney form from average ranks; null where a side is missing."""
    own = Window.partitionBy(*keys)
    tie = F.count(F.lit(1)).over(Window.partitionBy(*keys, score))
    ranked = rows.select(*keys, score, target).withColumn("r", F.rank().over(own.orderBy(score)) + (tie - 1) / 2.0)
    out = ranked.groupBy(*keys).agg(F.sum(F.when(F.col(target) == 1, F.col("r"))).alias("s"), F.sum(F.col(target).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    neg = F.col("n") - F.col("pos")
    return out.select(*keys, ratio(F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2.0, F.col("pos") * neg).alias("auc"))


def auc_macro(rows: DataFrame, keys: Sequence[str], n_classes: int) -> DataFrame:
    """Binary: the AUC of class 1; else the mean of one-vs-rest AUCs, null if a class is absent."""
    each = per_class(rows, keys)
    if n_classes == 2:
        each = each.where("k = 1")
    out = auc(each, [*keys, "k"], "p", "is_k").groupBy(*keys).agg(F.avg("auc").alias("auc"), F.count("auc").alias("n"), F.count(F.lit(1)).alias("all"))
    return out.select(*keys, F.when(F.col("n") == F.col("all"), F.col("auc")).alias("roc_auc_ovr_macro"))


def macro_f1(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mean F1 over labels that occur as truth or prediction; 0 where F1 is undefined."""
    counted = rows.groupBy(*keys, "y_idx", "pred_label").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y_idx") == F.col("pred_label"), F.col("n")).otherwise(0)
    truth = counted.groupBy(*keys, F.col("y_idx").cast("int").alias("c")).agg(F.sum("n").alias("t"), F.sum(hit).alias("h"))
    said = counted.groupBy(*keys, F.col("pred_label").alias("c")).agg(F.sum("n").alias("s"))
    both = truth.join(said, [*keys, "c"], "full")
    f1 = 2.0 * F.coalesce("h", F.lit(0)) / (F.coalesce("t", F.lit(0)) + F.coalesce("s", F.lit(0)))
    return both.groupBy(*keys).agg(F.avg(f1).alias("macro_f1"))


#: Builders that further metrics can be added to: name to aggregate columns over instance rows.
EXTENSIONS: dict[str, list[Column]] = {}


def all_metrics(rows: DataFrame, keys: Sequence[str], n_classes: int, n: int = BINS) -> DataFrame:
    """Wide: every classification metric of each cell."""
    if n < 2:
        raise ValueError("at least two bins are needed")
    keys = list(keys)
    scored = instance_columns(rows)
    out = top_label(scored, keys, n)
    for other in (classwise(scored, keys, n), cumulative_mass(scored, keys, n), proper_scores(scored, keys), auc_macro(scored, keys, n_classes), macro_f1(scored, keys)):
        out = out.join(other, keys)
    for columns in EXTENSIONS.values():
        out = out.join(scored.groupBy(*keys).agg(*columns), keys)
    return out


def class_counts(rows: DataFrame, keys: Sequence[str], split: str, n_classes: int) -> DataFrame:
    """Counts of every class in every split, zeros included."""
    counted = rows.groupBy(*keys, split, F.col("y_idx").cast("int").alias("y_idx")).agg(F.count(F.lit(1)).alias("n"))
    full = rows.select(*keys, split).distinct().withColumn("y_idx", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
    return full.join(counted, [*keys, split, "y_idx"], "left").fillna(0, ["n"])
