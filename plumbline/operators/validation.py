"""Constraints on tables: each returns the rows that break it; ``require`` raises if there are any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ppd
from ..functions.scalar import finite


class ConstraintError(ValueError):
    """A table breaks a constraint."""


def require(broken: DataFrame, what: str) -> None:
    first = broken.limit(3).collect()
    if first:
        raise ConstraintError(f"{what}: {[r.asDict() for r in first]}")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left keys without a right row, and keys that the right side has more than once."""
    lost = left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti").withColumn("problem", F.lit("missing"))
    return lost.unionByName(duplicates(right, keys).select(*keys, F.lit("repeated").alias("problem")))


def incomplete(panel: DataFrame, keys: Sequence[str], expected: int, value: str = "value") -> DataFrame:
    """Groups that lack finite values."""
    return panel.groupBy(*keys).agg(F.count(finite(F.col(value))).alias("n_finite")).where(F.col("n_finite") != expected)


def missing_configurations(present: DataFrame, axes: Sequence[DataFrame]) -> DataFrame:
    """Combinations of the axes (small tables of allowed values) that are not there."""
    full = axes[0]
    for axis in axes[1:]:
        full = full.crossJoin(axis)
    return full.join(present.select(*full.columns).distinct(), full.columns, "left_anti")


def bad_bundle_rows(rows: DataFrame, n_levels: int) -> DataFrame:
    """Prediction rows with the wrong size, missing or infinite values, or crossing quantiles."""
    p = F.col("ppd")
    wrong = F.when(F.size(p) != n_levels, "size").when(F.exists(p, lambda v: finite(v).isNull()) | finite(F.col("y")).isNull(), "not_finite").when(ppd.crosses(p), "crossing")
    return rows.withColumn("problem", wrong).where("problem is not null")


def shared_rows(rows: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Row ids that occur in more than one role."""
    return rows.groupBy(*keys, row_id).agg(F.count_distinct("role").alias("n_roles")).where("n_roles > 1")


def broken_identity(rows: DataFrame, a: Column, b: Column, tol: float = 1e-9) -> DataFrame:
    """Rows whose two sides differ by more than the tolerance, relative to their size."""
    return rows.where(F.abs(a - b) > tol * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))


def unlike_rows(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], method: str = "method") -> DataFrame:
    """Keys whose methods do not share the same rows."""
    each = rows.groupBy(*keys, method).agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(*keys).agg(F.count_distinct("h", "n").alias("versions")).where("versions > 1")


def bad_probabilities(rows: DataFrame, tol: float = 1e-6) -> DataFrame:
    total = F.aggregate("proba", F.lit(0.0), lambda acc, v: acc + v)
    return rows.where(F.exists("proba", lambda v: (v < 0) | (v > 1) | F.isnan(v)) | (F.abs(total - 1.0) > tol))


def not_zero_sum(rows: DataFrame, keys: Sequence[str], value: str, tol: float = 1e-9) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(value).alias("total")).where(F.abs("total") > tol)


def common_panel(rows: DataFrame, expected: DataFrame, pair: Sequence[str], value: str) -> DataFrame:
    """Pairs without an undefined value and without a missing configuration."""
    bad = rows.where(finite(F.col(value)).isNull()).select(*pair)
    lost = expected.join(rows.select(*expected.columns), expected.columns, "left_anti").select(*pair)
    return rows.select(*pair).distinct().join(bad.union(lost).distinct(), list(pair), "left_anti")
