"""Conformal calibration of prediction intervals that is expressed in columns.

Input: rows with keys, ``role`` (train, cal or test), ``row_pos``, ``y``, ``ppd`` and
``point_pred``.  Scores of the calibration rows give one order statistic a cell and level;
it is joined to the test rows and inverted to bounds.  A level that needs more rows than
there are gives an infinite threshold, never a missing cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ppd
from ..functions.scalar import finite, ratio, strict_avg

SCORES = ("absolute", "normalised", "cqr", "cqr_standard", "pit")
#: Of fitting and calibration rows, which calibrate: both pooled, or the calibration part.
POOLED = ("SCP", "CalLCP", "RLCP")
INF = float("inf")


def quarter_roles(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roles by place: the first quarter trains, the second calibrates, the rest is the test."""
    role = F.when(F.col("row_pos") < F.col("n_test") / 4, "train").when(F.col("row_pos") < F.col("n_test") / 2, "cal").otherwise("test")
    return rows.withColumn("role", role)


def hashed_roles(rows: DataFrame, keys: Sequence[str], row_id: str, seed: int = 20260929, least: int = 10) -> DataFrame:
    """Roles by a seeded hash order within each cell; cells under 4 * least rows are left out."""
    own = Window.partitionBy(*keys)
    placed = rows.withColumns({"h": F.row_number().over(own.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in (*keys, row_id)))), row_id)) - 1, "m": F.count(F.lit(1)).over(own)})
    role = F.when(F.col("h") < F.floor(F.col("m") / 4), "train").when(F.col("h") < 2 * F.floor(F.col("m") / 4), "cal").otherwise("test")
    return placed.where(F.floor(F.col("m") / 4) >= least).withColumn("role", role).drop("h", "m")


def prepared_roles(rows: DataFrame, keys: Sequence[str], row_id: str, seed: int = 20260929) -> DataFrame:
    """A fixed test part (role test) stays; the rest is halved into train and cal by hash."""
    rest = Window.partitionBy(*keys, F.col("role") == "test")
    placed = rows.withColumns({"h": F.row_number().over(rest.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"))), row_id)) - 1, "m": F.count(F.lit(1)).over(rest)})
    return placed.withColumn("role", F.when(F.col("role") == "test", "test").when(F.col("h") < F.floor(F.col("m") / 2), "train").otherwise("cal")).drop("h", "m")


def _spread(levels: Sequence[float]) -> Column:
    return F.sqrt(F.greatest(ppd.variance(F.col("ppd"), levels), F.lit(1e-16)))


def score(kind: str, levels: Sequence[float], alpha: float) -> Column:
    y, mu = F.col("y"), ppd.mean(F.col("ppd"), levels)
    if kind == "absolute":
        return F.abs(y - mu)
    if kind == "normalised":
        return F.abs(y - mu) / F.greatest(_spread(levels), F.lit(1e-8))
    if kind in ("cqr", "cqr_standard"):
        low, high = ppd.interval(F.col("ppd"), levels, alpha)
        worst = F.greatest(low - y, y - high)
        return F.greatest(worst, F.lit(0.0)) if kind == "cqr" else worst
    if kind == "pit":
        u = ppd.cdf_at(F.col("ppd"), levels, y)
        return F.greatest(u, 1.0 - u)
    raise ValueError(f"unknown score {kind}")


def bounds(kind: str, levels: Sequence[float], alpha: float, threshold: Column) -> tuple[Column, Column]:
    """The set of y whose score is at most the threshold.  Thresholds of scores that cannot be
    negative are held at 0; a set that crosses is left so, and marked empty by the caller."""
    mu = ppd.mean(F.col("ppd"), levels)
    zero = F.greatest(threshold, F.lit(0.0))
    if kind == "absolute":
        return mu - zero, mu + zero
    if kind == "normalised":
        wide = zero * F.greatest(_spread(levels), F.lit(1e-8))
        return mu - wide, mu + wide
    if kind in ("cqr", "cqr_standard"):
        low, high = ppd.interval(F.col("ppd"), levels, alpha)
        t = zero if kind == "cqr" else threshold
        return low - t, high + t
    # PIT: the quantiles at 1 - t and t, all of the line from 1 on.
    grid = ppd.literal(levels)

    def at(q: Column) -> Column:
        k = F.size(F.filter(grid, lambda v: v <= q))
        n = len(levels)
        inner = F.get("ppd", k - 1) + (F.get("ppd", k) - F.get("ppd", k - 1)) * F.try_divide(q - F.get(grid, k - 1), F.get(grid, k) - F.get(grid, k - 1))
        return F.when(k == 0, F.get("ppd", F.lit(0))).when(k == n, F.get("ppd", F.lit(n - 1))).otherwise(inner)

    return F.when(threshold >= 1, -INF).otherwise(at(1.0 - threshold)), F.when(threshold >= 1, INF).otherwise(at(threshold))


def order_statistic(scores: DataFrame, keys: Sequence[str], alpha: float, value: str = "score") -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score of each cell; infinite beyond n."""
    own = Window.partitionBy(*keys)
    k = F.ceil((F.count(F.lit(1)).over(own) + 1) * F.lit(1.0 - alpha) - 1e-9)
    placed = scores.withColumns({"__place": F.row_number().over(own.orderBy(value)), "__wanted": k})
    return placed.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("__place") == F.col("__wanted"), F.col(value))), F.lit(INF)).alias("threshold"), F.count(F.lit(1)).alias("n_cal"))


def split_conformal(rows: DataFrame, keys: Sequence[str], levels: Sequence[float], alphas: Sequence[float], kind: str = "absolute", pooled: bool = True) -> DataFrame:
    """Bounds of the test rows for each level; calibration on train and cal together, or cal."""
    roles = ["train", "cal"] if pooled else ["cal"]
    out = None
    for a in alphas:
        cal = rows.where(F.col("role").isin(roles)).select(*keys, score(kind, levels, a).alias("score"))
        with_t = rows.where("role = 'test'").join(order_statistic(cal, keys, a), list(keys))
        low, high = bounds(kind, levels, a, F.col("threshold"))
        made = with_t.withColumns({"alpha": F.lit(float(a)), "lower": low, "upper": high})
        out = made if out is None else out.unionByName(made)
    return out.withColumn("empty_set", F.col("lower") > F.col("upper"))


def vanilla(rows: DataFrame, levels: Sequence[float], alphas: Sequence[float]) -> DataFrame:
    """The uncorrected central intervals of the test rows."""
    made = []
    for a in alphas:
        low, high = ppd.interval(F.col("ppd"), levels, a)
        made.append(F.struct(F.lit(float(a)).alias("alpha"), low.alias("lower"), high.alias("upper")))
    test = rows.where("role = 'test'")
    return test.withColumn("made", F.explode(F.array(*made))).select(*test.columns, "made.*").withColumn("empty_set", F.col("lower") > F.col("upper"))


def rectified(rows: DataFrame, keys: Sequence[str], levels: Sequence[float], alpha: float, feature: str, bins: int = 4, how: str = "difference") -> DataFrame:
    """Rectified conformal prediction whose score quantile is that of a feature's quantile bin,
    fitted on train rows: scores are rectified on cal rows, by difference or ratio."""
    scored = rows.withColumn("score", score("absolute", levels, alpha))
    edges = scored.where("role = 'train'").groupBy(*keys).agg(F.percentile(feature, F.array(*(F.lit(k / bins) for k in range(1, bins)))).alias("edges"), F.percentile("score", F.lit(1 - alpha)).alias("all_tau"))
    binned = scored.join(edges, list(keys)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(feature))))
    tau = binned.where("role = 'train'").groupBy(*keys, "bin").agg(F.percentile("score", F.lit(1 - alpha)).alias("bin_tau"))
    full = binned.join(tau, [*keys, "bin"], "left").withColumn("tau", F.greatest(F.coalesce("bin_tau", "all_tau"), F.lit(1e-8)))
    fixed = F.col("score") - F.col("tau") if how == "difference" else F.col("score") / F.col("tau")
    t = order_statistic(full.where("role = 'cal'").withColumn("fixed", fixed), keys, alpha, "fixed")
    test = full.where("role = 'test'").join(t, list(keys))
    half = F.greatest(F.col("tau") + F.col("threshold") if how == "difference" else F.col("tau") * F.col("threshold"), F.lit(0.0))
    mu = ppd.mean(F.col("ppd"), levels)
    return test.withColumns({"alpha": F.lit(float(alpha)), "lower": mu - half, "upper": mu + half}).withColumn("empty_set", F.col("lower") > F.col("upper"))


def interval_summary(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics of given bounds; empty sets cover nothing, infinite widths stay infinite."""
    empty = F.count_if(F.col("lower") > F.col("upper"))
    endless = F.count_if(F.abs(F.col("lower")) == INF)
    return scored.groupBy(*keys).agg(F.avg("covered").alias("coverage"), F.avg("width").alias("avg_width"), F.avg("winkler").alias("interval_score"), empty.alias("n_empty"), endless.alias("n_infinite"), F.count(F.lit(1)).alias("n"))


def paired_deltas(metrics: DataFrame, baseline: str = "Vanilla", keys: Sequence[str] = ("dataset_id", "seed", "base_model", "alpha", "metric")) -> DataFrame:
    """Each method's values beside the baseline's; a row without a baseline is an error."""
    base = metrics.where(F.col("method") == baseline).select(*keys, F.col("value").alias("base_value"), F.lit(True).alias("__found"))
    joined = metrics.where(F.col("method") != baseline).join(base, list(keys), "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit(f"no {baseline} row for"), *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in ("method", *keys))))
    checked = joined.withColumn("base_value", F.when(F.col("__found").isNull(), missing.cast("double")).otherwise(F.col("base_value"))).drop("__found")
    return checked.withColumns({"delta": F.col("value") - F.col("base_value"), "relative_delta": ratio(F.col("value") - F.col("base_value"), F.abs("base_value"))})


def summarise(deltas: DataFrame) -> DataFrame:
    """Strict dataset means, then means over datasets of equal weight."""
    by = deltas.groupBy("method", "base_model", "alpha", "metric", "dataset_id").agg(strict_avg(F.col("delta")).alias("delta"), strict_avg(F.col("relative_delta")).alias("relative_delta"))
    return by.groupBy("method", "base_model", "alpha", "metric").agg(strict_avg(F.col("delta")).alias("mean_delta"), F.median("relative_delta").alias("median_relative_delta"), F.avg((F.col("delta") < 0).cast("double")).alias("frac_negative"), F.count(F.lit(1)).alias("n_datasets"))


def relative_width(metrics: DataFrame) -> DataFrame:
    """Median over datasets of the width's change against the uncorrected interval, in percent."""
    means = metrics.where("metric = 'avg_width'").groupBy("method", "base_model", "alpha", "dataset_id").agg(strict_avg(F.col("value")).alias("value"))
    base = means.where("method = 'Vanilla'").select("base_model", "alpha", "dataset_id", F.col("value").alias("base_value"))
    change = 100.0 * ratio(F.col("value") - F.col("base_value"), F.col("base_value"))
    return means.where("method <> 'Vanilla'").join(base, ["base_model", "alpha", "dataset_id"]).withColumn("change", finite(change)).groupBy("method", "base_model", "alpha").agg(F.median("change").alias("median_width_change"), F.count("change").alias("n_datasets"))


def loss_status(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    x = F.col(value)
    return rows.groupBy(*keys).agg(F.count_if(x.isNull() | F.isnan(x)).alias("n_undefined"), F.count_if(F.abs(x) == INF).alias("n_infinite"), F.count(F.lit(1)).alias("n"))


def _fingerprint(row_id: str) -> list[Column]:
    """Sums and exclusive ors of 60-bit hashes of the rows: nothing is gathered, and no order matters."""
    h = F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 15), 16, 10)
    return [F.sum(h.cast("decimal(38,0)")).cast("string").alias("fingerprint"), F.bit_xor(h.cast("long")).cast("string").alias("spread")]


def data_usage(rows: DataFrame, keys: Sequence[str], pooled: bool) -> DataFrame:
    """Rows that fit, calibrate and test, and a fingerprint of each role's rows."""
    role = F.when((F.col("role") == "train") & F.lit(pooled), "cal").otherwise(F.col("role"))
    each = rows.withColumn("role", role).groupBy(*keys, "role").agg(F.count(F.lit(1)).alias("n_rows"), *_fingerprint("row_pos"))
    return each.withColumn("fingerprint", F.concat_ws("-", "fingerprint", "spread")).drop("spread")


def method_name(name: Column) -> Column:
    """Canonical names: the -standard suffix goes, and RCP+ is RCP."""
    return F.when(name == "RCP+", "RCP").otherwise(F.regexp_replace(name, "-standard$", ""))
