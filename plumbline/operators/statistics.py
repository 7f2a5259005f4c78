"""Rank correlations, combination of seeds and p-values, multiple testing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions
from ..functions.scalar import correlation, finite, ratio
from .tables import average_rank

TINY = 1e-15


def spearman(pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", least: int = 4, p_value: bool = True) -> DataFrame:
    """r and n of each group from complete pairs; null under ``least`` rows or for a constant
    side; p from Student's t."""
    rows = pairs.withColumns({"fx": finite(F.col(x)), "fy": finite(F.col(y))}).where("fx is not null and fy is not null")
    ranked = rows.withColumns({"rx": average_rank(F.col("fx"), keys), "ry": average_rank(F.col("fy"), keys)})
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("rx"), F.col("ry")).alias("r"))
    out = out.withColumn("r", F.when(F.col("n") >= least, F.least(F.greatest("r", F.lit(-1.0)), F.lit(1.0))))
    if p_value:
        t = ratio(F.col("r") * F.sqrt(F.col("n") - 2.0), F.sqrt(F.greatest(1.0 - F.col("r") * F.col("r"), F.lit(1e-300))))
        out = out.withColumn("p", distributions.t_p(t, F.col("n") - 2))
    return out


def chatterjee(pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", tie: str = "row_id", least: int = 10) -> DataFrame:
    """Chatterjee's coefficient of y given x.  Rows are ordered by x, ties by ``tie``; the form
    for ties in y holds for continuous y too."""
    rows = pairs.withColumns({"fx": finite(F.col(x)), "fy": finite(F.col(y))}).where("fx is not null and fy is not null")
    own = Window.partitionBy(*keys)
    upto = Window.partitionBy(*keys).orderBy("fy").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy(*keys).orderBy(F.desc("fy")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumns({"up": F.count(F.lit(1)).over(upto), "down": F.count(F.lit(1)).over(onward)})
    step = placed.withColumn("step", F.abs(F.col("up") - F.lag("up").over(own.orderBy("fx", tie))))
    out = step.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("moved"), F.sum("down").alias("s1"), F.sum(F.col("down") * F.col("down")).alias("s2"), F.stddev_pop("fx").alias("sx"), F.stddev_pop("fy").alias("sy"))
    xi = 1.0 - ratio(F.col("n") * F.col("moved"), 2.0 * (F.col("n") * F.col("s1") - F.col("s2")))
    ok = (F.col("n") >= least) & (F.col("sx") >= 1e-12) & (F.col("sy") >= 1e-12)
    return out.select(*keys, "n", F.when(ok, xi).alias("xi"))


# --------------------------------------------------------------------------- seeds
def rubin(rows: DataFrame, keys: Sequence[str], estimate: str, variance: str, level: float = 0.95, n: str | None = None, p_value: bool = True) -> DataFrame:
    """Rubin's rules: mean, within + (1 + 1/K) between variance, Barnard-Rubin degrees of
    freedom where ``n`` (the complete-data degrees) is given, t interval and p."""
    agg = [F.count(estimate).alias("k"), F.avg(estimate).alias("est"), F.avg(variance).alias("within"), F.coalesce(F.var_samp(estimate), F.lit(0.0)).alias("between")]
    out = rows.where(F.col(estimate).isNotNull() & F.col(variance).isNotNull()).groupBy(*keys).agg(*agg, *([F.min(n).alias("nu_com")] if n else []))
    extra = (1.0 + 1.0 / F.col("k")) * F.col("between")
    out = out.withColumns({"total": F.col("within") + extra, "share": ratio(extra, F.col("within") + extra)})
    old = ratio(F.col("k") - 1.0, F.pow("share", 2))
    if n:
        seen = (F.col("nu_com") + 1.0) / (F.col("nu_com") + 3.0) * F.col("nu_com") * (1.0 - F.col("share"))
        df = F.when(F.col("share") > 0, ratio(old * seen, old + seen)).otherwise(seen)
    else:
        df = F.when((F.col("share") > 0) & (F.col("k") > 1), old).otherwise(F.lit(1e9))
    out = out.withColumns({"se": F.sqrt("total"), "df": df})
    out = out.withColumn("t", ratio(F.col("est"), F.col("se")))
    if p_value:
        half = distributions.t_quantile(0.5 + level / 2, F.col("df")) * F.col("se")
        out = out.withColumns({"p": distributions.t_p(F.col("t"), F.col("df")), "ci_low": F.col("est") - half, "ci_high": F.col("est") + half})
    return out.select(*keys, "est", "se", "t", "df", F.col("k").alias("n_seeds"), F.col("within").alias("within_var"), F.col("between").alias("between_var"), *(["p", "ci_low", "ci_high"] if p_value else []))


def fisher_z(rows: DataFrame, keys: Sequence[str], r: str = "r", n: str = "n", level: float = 0.95, p_value: bool = True) -> DataFrame:
    """Correlations of seeds combined on the atanh scale with variance 1 / (n - 3), and back;
    seeds under 4 rows are left out."""
    held = F.least(F.greatest(F.col(r), F.lit(-1 + 1e-12)), F.lit(1 - 1e-12))
    z = rows.where(F.col(n) >= 4).where(F.col(r).isNotNull()).withColumns({"z": F.atanh(held), "v": F.when(F.col(n) > 3, 1.0 / (F.col(n) - 3.0))})
    out = rubin(z, keys, "z", "v", level, p_value=p_value)
    back = [F.tanh("est").alias("r"), "df", "n_seeds", "within_var", "between_var"]
    return out.select(*keys, *back, *(["p", F.tanh("ci_low").alias("ci_low"), F.tanh("ci_high").alias("ci_high")] if p_value else []))


def mean_sd(rows: DataFrame, keys: Sequence[str], value: str, level: float = 0.95, interval: bool = True) -> DataFrame:
    """Mean, standard error of the mean over seeds and its t interval."""
    out = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n_seeds"))
    if interval:
        half = distributions.t_quantile(0.5 + level / 2, F.col("n_seeds") - 1) * F.col("se")
        out = out.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})
    return out


def acat(rows: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    """The Cauchy combination of p-values."""
    held = F.least(F.greatest(F.col(p), F.lit(TINY)), F.lit(1 - TINY))
    mean = F.avg(F.tan((0.5 - held) * math.pi))
    return rows.where(F.col(p).isNotNull()).groupBy(*keys).agg((0.5 - F.atan(mean) / math.pi).alias("p_acat"), F.count(p).alias("n_p"))


def benjamini_hochberg(rows: DataFrame, keys: Sequence[str], p: str = "p", out: str = "q") -> DataFrame:
    """Adjusted p-values within keys; rows without p stay without."""
    own = Window.partitionBy(*keys, F.col(p).isNull())
    scaled = F.col(p) * F.count(p).over(own) / F.row_number().over(own.orderBy(p))
    later = own.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("scaled", scaled).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("scaled").over(later)))).drop("scaled")


def pooled_spearman(outcomes: DataFrame, features: DataFrame, task: str, skip: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """Correlation of each feature with each metric: pooled over models (the dataset's median)
    and of each model, with support gates and adjusted p within metric and tier."""
    least = 30 if task == "classification" else 20
    each = outcomes.select("metric", F.col("model").alias("tier"), "dataset_id", finite(F.col("value")).alias("y"))
    pooled = outcomes.groupBy("metric", "dataset_id").agg(F.median(finite(F.col("value"))).alias("y")).select("metric", F.lit("pooled").alias("tier"), "dataset_id", "y")
    both = pooled.unionByName(each).join(features.where(~F.col("feature").isin(list(skip)) if skip else F.lit(True)).select("dataset_id", "feature", finite(F.col("value")).alias("x")), "dataset_id")
    keys = ["metric", "tier", "feature"]
    whole = both.where("x is not null and y is not null")
    support = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("x").alias("nx"), F.count_distinct("y").alias("ny"))
    status = F.when(F.col("n") < least, "insufficient_support").when(F.col("nx") < 3, "constant_feature").when(F.col("ny") < 2, "constant_outcome").otherwise("ok")
    out = support.withColumn("status", status).join(spearman(whole, keys, p_value=p_value).drop("n"), keys, "left")
    ok = F.col("status") == "ok"
    out = out.withColumn("r", F.when(ok, F.col("r"))).withColumn("level", F.when(F.col("tier") == "pooled", "pooled").otherwise("individual"))
    if p_value:
        out = benjamini_hochberg(out.withColumn("p", F.when(ok, F.col("p"))), ["metric", "level"])
    return out


def strongest(correlations: DataFrame, k: int = 5) -> DataFrame:
    """The k strongest features of each metric by |r|, ties by name, and their first place."""
    own = Window.partitionBy("metric").orderBy(F.desc(F.abs("r")), "feature")
    top = correlations.where("r is not null").withColumn("place", F.row_number().over(own)).where(F.col("place") <= k)
    return top.groupBy("feature").agg(F.min("place").alias("best_place"), F.count(F.lit(1)).alias("n_metrics"))


#: How results of seeds are combined: name to (summary, keys) -> DataFrame; add to it to plug one in.
COMBINERS = {
    "fisher_z": lambda rows, keys: fisher_z(rows, keys),
    "mean_sd": lambda rows, keys, value="xi": mean_sd(rows, keys, value),
    "rubin": lambda rows, keys: rubin(rows, keys),
}
