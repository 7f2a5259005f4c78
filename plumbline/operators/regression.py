"""Metrics of predicted distributions of a number.

Input: one row a test instance with key columns, ``y``, ``ppd`` (see functions.ppd),
``point_pred``, ``row_pos`` and ``n_test``.  Metrics that depend on a level alpha are
taken over the second half of each cell by ``row_pos``; the others over all rows.
All metrics of a level are columns of one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions, ppd
from ..functions.scalar import ratio

ALPHAS = (0.05, 0.10, 0.15, 0.20)
PIT_BINS = 15
SLABS = 5


def pinball(y: Column, value: Column, tau: float | Column) -> Column:
    tau = F.lit(float(tau)) if not isinstance(tau, Column) else tau
    return F.when(y >= value, tau * (y - value)).otherwise((tau - 1.0) * (y - value))


def winkler(y: Column, lower: Column, upper: Column, alpha: Column) -> Column:
    zero = F.lit(0.0)
    return (upper - lower) + (2.0 / alpha) * (F.greatest(lower - y, zero) + F.greatest(y - upper, zero))


def intervals(rows: DataFrame, levels: Sequence[float], alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """``rows`` once for each alpha, with lower, upper, width, covered, winkler and pinballs."""
    made = []
    for a in alphas:
        low, high = ppd.interval(F.col("ppd"), levels, a)
        made.append(F.struct(F.lit(float(a)).alias("alpha"), low.alias("lower"), high.alias("upper")))
    out = rows.withColumn("made", F.explode(F.array(*made))).select(*rows.columns, "made.*")
    return score_intervals(out)


def score_intervals(out: DataFrame) -> DataFrame:
    """Row scores of given alpha, lower and upper; a bound that is NaN or null covers nothing."""
    y, lower, upper, alpha = (F.col(k) for k in ("y", "lower", "upper", "alpha"))
    known = ~(F.isnan(lower) | F.isnan(upper) | lower.isNull() | upper.isNull())
    return out.withColumns({
        "width": upper - lower,
        "covered": F.when(known, (y >= lower) & (y <= upper)).otherwise(False).cast("int"),
        "winkler": winkler(y, lower, upper, alpha),
        "pinball_lower_row": pinball(y, lower, alpha / 2.0),
        "pinball_upper_row": pinball(y, upper, 1.0 - alpha / 2.0),
    })


def in_second_half() -> Column:
    return F.col("row_pos") >= F.floor(F.col("n_test") / 2)


def interval_metrics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage, width and score metrics of each cell and alpha, from its second half."""
    half = scored.where(in_second_half())
    nominal = 1.0 - F.col("alpha")
    out = half.groupBy(*keys, "alpha").agg(
        F.avg("covered").alias("marginal_coverage"),
        F.avg("width").alias("avg_length"),
        F.stddev_pop("y").alias("spread_y"),
        F.avg("winkler").alias("interval_score"),
        F.avg("pinball_lower_row").alias("pinball_lower"),
        F.avg("pinball_upper_row").alias("pinball_upper"),
        F.count(F.lit(1)).alias("n_eval"),
    )
    return out.select(*keys, "alpha", "marginal_coverage", nominal.alias("nominal"), (F.col("marginal_coverage") - nominal).alias("cov_dev_signed"), F.abs(F.col("marginal_coverage") - nominal).alias("cov_abs_dev"), "avg_length", (F.col("avg_length") / F.greatest("spread_y", F.lit(1e-10))).alias("avg_width_norm"), "interval_score", "pinball_lower", "pinball_upper", ((F.col("pinball_lower") + F.col("pinball_upper")) / 2.0).alias("pinball_mean"), "n_eval")


def distribution_rows(rows: DataFrame, levels: Sequence[float]) -> DataFrame:
    """crps_row, pit and residual of each row; nothing is exploded."""
    return rows.withColumns({"crps_row": ppd.crps(F.col("ppd"), levels, F.col("y")), "pit": ppd.cdf_at(F.col("ppd"), levels, F.col("y")), "residual": F.col("y") - F.col("point_pred")})


def crps_metric(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg("crps_row").alias("crps_mean"))


def pit_metrics(rows: DataFrame, keys: Sequence[str], bins: int = PIT_BINS, p_value: bool = True) -> DataFrame:
    """Kolmogorov-Smirnov distance, calibration error and histogram distance of ``pit``."""
    own = Window.partitionBy(*keys)
    placed = rows.select(*keys, "pit").withColumns({"i": F.row_number().over(own.orderBy("pit")), "n": F.count(F.lit(1)).over(own)})
    gap = F.greatest(F.col("i") / F.col("n") - F.col("pit"), F.col("pit") - (F.col("i") - 1) / F.col("n"))
    levels = [(k + 1) / (bins + 1) for k in range(bins)]
    within = [F.avg((F.col("pit") <= q).cast("double")).alias(f"w{k}") for k, q in enumerate(levels)]
    place = F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1))
    share = [F.avg((place == k).cast("double")).alias(f"h{k}") for k in range(bins)]
    out = placed.groupBy(*keys).agg(F.max(gap).alias("pit_ks_stat"), F.count(F.lit(1)).alias("n"), *within, *share)
    ece = sum((F.abs(F.col(f"w{k}") - q) for k, q in enumerate(levels)), F.lit(0.0)) / bins
    l1 = sum((F.abs(F.col(f"h{k}") - 1.0 / bins) for k in range(bins)), F.lit(0.0))
    out = out.select(*keys, "pit_ks_stat", ece.alias("pit_ece"), l1.alias("pit_hist_l1"), "n")
    if p_value:
        out = out.withColumn("pit_ks_pvalue", distributions.kolmogorov_p(F.col("pit_ks_stat"), F.col("n")))
    return out.drop("n")


def point_accuracy(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """r2 (null for a constant target), rmse and mae."""
    e = F.col("y") - F.col("point_pred")
    out = rows.groupBy(*keys).agg(F.sum(e * e).alias("sse"), (F.var_pop("y") * F.count("y")).alias("sst"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))
    return out.select(*keys, F.when(F.col("sst") > 0, 1.0 - ratio(F.col("sse"), F.col("sst"))).alias("r2"), F.sqrt("mse").alias("rmse"), "mae")


# --------------------------------------------------------------------------- worst slab
def _numeric_slabs(x: np.ndarray, least: int, bins: int) -> list[tuple[float, float]]:
    """Half-open slabs (low, high] of quantile edges; slabs under ``least`` rows are merged
    into the smaller neighbour, the lower one on ties."""
    edge = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)))
    edge[0], edge[-1] = np.nextafter(edge[0], -np.inf), np.nextafter(edge[-1], np.inf)
    ordered = np.sort(x)
    while len(edge) > 2:
        size = np.diff(np.searchsorted(ordered, edge, "right"))
        k = int(size.argmin())
        if size[k] >= least:
            break
        left = size[k - 1] if k else np.inf
        right = size[k + 1] if k + 1 < len(size) else np.inf
        edge = np.delete(edge, k if left <= right else k + 1)
    return list(zip(edge[:-1], edge[1:], strict=True))


def _category_slabs(x: np.ndarray, least: int) -> list[set]:
    """Groups of categories; the smallest joins the next smallest until all have ``least`` rows."""
    value, size = np.unique(x, return_counts=True)
    groups = [(int(n), [v]) for v, n in zip(value, size, strict=True)]
    while len(groups) > 1:
        k = min(range(len(groups)), key=lambda i: groups[i][0])
        if groups[k][0] >= least:
            break
        n, own = groups.pop(k)
        j = min(range(len(groups)), key=lambda i: groups[i][0])
        m, other = groups.pop(j)
        groups.append((n + m, own + other))
    return [set(own) for _, own in groups]


def _worst_slab(cell: pd.DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int) -> dict:
    covered = cell["covered"].to_numpy(float)
    mid = len(cell) // 2
    least, best = max(1, mid // bins), None
    for j, name in enumerate([*numeric, *categorical]):
        column = cell[name]
        there = column.notna().to_numpy()
        x = column.to_numpy(float) if name in numeric else column.to_numpy(object)
        seen = there[:mid]
        valid = x[:mid][seen]
        distinct = len(set(valid.tolist()))
        if distinct < 2 or name in categorical and distinct > 0.5 * len(valid):
            continue
        if name in numeric:
            slabs = [there & (x > a) & (x <= b) for a, b in _numeric_slabs(valid.astype(float), least, bins)]
        else:
            slabs = [there & np.isin(x.astype(str), sorted(map(str, g))) for g in _category_slabs(valid.astype(str), least)]
        for inside in slabs:
            n = int(inside[:mid].sum())
            if n >= least and (best is None or covered[:mid][inside[:mid]].mean() < best[0]):
                best = (covered[:mid][inside[:mid]].mean(), j, name, n, inside[mid:])
    if best is None:
        return {"worst_slab_coverage": None, "worst_slab_feature_idx": -1, "worst_slab_feature_name": None, "wsc_search_n": 0, "wsc_eval_n": 0, "wsc_reason": "no_eligible_subgroup"}
    n = int(best[4].sum())
    return {"worst_slab_coverage": float(covered[mid:][best[4]].mean()) if n else None, "worst_slab_feature_idx": best[1], "worst_slab_feature_name": best[2], "wsc_search_n": best[3], "wsc_eval_n": n, "wsc_reason": "finite" if n else "empty_evaluation_subgroup"}


def worst_slab(scored: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (), bins: int = SLABS) -> DataFrame:
    """Coverage on the second half of the slab that is covered worst on the first.  Merging
    slabs is iterative, so a cell's covered flags and features go through numpy."""
    by = [*keys, "alpha"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.select(*by).schema)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("row_pos", kind="stable")
        return pd.DataFrame([{k: cell[k].iloc[0] for k in by} | _worst_slab(cell, numeric, categorical, bins)])

    schema = fields + ", worst_slab_coverage double, worst_slab_feature_idx int, worst_slab_feature_name string, wsc_search_n long, wsc_eval_n long, wsc_reason string"
    out = scored.select(*by, "row_pos", "covered", *numeric, *categorical).groupBy(*by).applyInPandas(run, schema)
    dev = F.col("worst_slab_coverage") - (1.0 - F.col("alpha"))
    return out.withColumns({"wsc_dev_signed": dev, "wsc_abs_dev": F.abs(dev)})


def worst_bin(scored: DataFrame, keys: Sequence[str], feature: str, bins: int = SLABS) -> DataFrame:
    """The plain variant: quantile bins of one feature, no merging, all in aggregates."""
    by = [*keys, "alpha"]
    first = scored.where(~in_second_half())
    edges = first.groupBy(*by).agg(F.percentile(feature, F.array(*(F.lit(k / bins) for k in range(1, bins)))).alias("edges"))
    binned = scored.join(edges, by).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(feature))))
    half = in_second_half()
    each = binned.groupBy(*by, "bin").agg(F.avg(F.when(~half, F.col("covered"))).alias("seen"), F.avg(F.when(half, F.col("covered"))).alias("worst_slab_coverage"))
    first_of = Window.partitionBy(*by).orderBy(F.asc_nulls_last("seen"), "bin")
    return each.withColumn("k", F.row_number().over(first_of)).where("k = 1").select(*by, "bin", "worst_slab_coverage")


def total_deviation(coverage: DataFrame, slabs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """total_abs_dev: both absolute coverage deviations added up."""
    return coverage.join(slabs, [*keys, "alpha"]).withColumn("total_abs_dev", F.col("cov_abs_dev") + F.col("wsc_abs_dev"))


# --------------------------------------------------------------------------- everything
#: Builders that further metrics can be added to: name, whether it depends on alpha, columns.
EXTENSIONS: dict[str, tuple[bool, list[Column]]] = {}


def all_metrics(rows: DataFrame, keys: Sequence[str], levels: Sequence[float], alphas: Sequence[float] = ALPHAS, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """Long (keys, alpha, metric, value): alpha-free metrics once, with null alpha."""
    keys = list(keys)
    free = distribution_rows(rows, levels)
    wide_free = crps_metric(free, keys).join(pit_metrics(free, keys), keys).join(point_accuracy(rows, keys), keys)
    scored = intervals(rows, levels, alphas)
    wide = interval_metrics(scored, keys)
    if numeric or categorical:
        slabs = worst_slab(scored, keys, numeric, categorical).select(*keys, "alpha", "worst_slab_coverage", "wsc_dev_signed", "wsc_abs_dev")
        wide = total_deviation(wide, slabs, keys)
    for depends, columns in EXTENSIONS.values():
        if depends:
            wide = wide.join(scored.where(in_second_half()).groupBy(*keys, "alpha").agg(*columns), [*keys, "alpha"])
        else:
            wide_free = wide_free.join(free.groupBy(*keys).agg(*columns), keys)

    def long(df: DataFrame, ids: list[str]) -> DataFrame:
        values = [c for c in df.columns if c not in ids]
        return df.select(*ids, *(F.col(c).cast("double").alias(c) for c in values)).unpivot(ids, values, "metric", "value")

    alpha_free = long(wide_free, keys).withColumn("alpha", F.lit(None).cast("double"))
    return alpha_free.unionByName(long(wide.drop("n_eval"), [*keys, "alpha"])).where(F.col("value").isNotNull())


def point_records(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R2 alone of records that have point predictions and no distribution, with the status of
    what was not asked for."""
    made = point_accuracy(rows.where(F.col("point_pred").isNotNull()), keys)
    return made.select(*keys, "r2", F.lit("not_requested").alias("distribution_status"), F.when(F.col("r2").isNull(), "undefined").otherwise("ok").alias("metric_status"))
