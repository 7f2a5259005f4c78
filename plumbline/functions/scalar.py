"""Small column rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x``, with NaN and infinities as null."""
    x = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    return F.when(F.abs(x) != float("inf"), x)


def no_nan(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def strict_avg(x: Column) -> Column:
    """The mean, or null where any value is missing."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of complete pairs, null for a constant side."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def right_closed_bin(score: Column, n: int) -> Column:
    """0 to n-1: equal-width bins of (0, 1] that are closed at the right, ends clipped."""
    edges = F.array(*(F.lit((k + 1) / n) for k in range(n)))
    return F.least(F.lit(n - 1), F.size(F.filter(edges, lambda e: e < score)))


def edge_bin(score: Column, edges: Column) -> Column:
    """The number of inner edges below the score."""
    return F.size(F.filter(edges, lambda e: e < score))


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def alpha_label(alpha: Column) -> Column:
    return F.when(alpha.isNull(), "free").otherwise(F.round(alpha, 3).cast("string"))


def entropy(p: Column) -> Column:
    """Nats of an array of probabilities, zeros left out."""
    return -F.aggregate(F.filter(p, lambda v: v > 0), F.lit(0.0), lambda acc, v: acc + v * F.log(v))


def gini(values: Column) -> Column:
    """The Gini coefficient of absolute values in an array; 0 if they sum to nothing."""
    ordered = F.array_sort(F.transform(values, lambda v: F.abs(v)))
    total = F.aggregate(ordered, F.lit(0.0), lambda acc, v: acc + v)
    n = F.size(values)
    ranked = F.aggregate(F.transform(ordered, lambda v, k: v * (k + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(total < 1e-10, 0.0).otherwise(F.try_divide(2.0 * ranked, n * total) - (n + 1) / n)


def label_index(classes: Column, y: Column) -> Column:
    """0-based place of a label in the sorted class list, null for others."""
    place = F.array_position(classes, y)
    return F.when(place > 0, place - 1)


def padded(values: Column, own: Column, n: int) -> Column:
    """Probabilities of a model's own classes on the global classes 0 to n-1, zeros elsewhere."""
    pairs = F.map_from_arrays(own, values)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at(pairs, k), F.lit(0.0)))


def winsorised(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def file_name(text: Column) -> Column:
    """A name that is safe in a path."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")
