"""Descriptive features of datasets.

Column-wise features are aggregates over (keys, feature, value) rows, so any number of
columns is one job; those that need whole matrices (neighbours, trees, singular values)
run in numpy on all rows of one dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions
from ..functions.neighbours import BLOCK, nearest
from ..functions.scalar import correlation, finite, ratio
from .tables import average_rank


def moments(x):
    """Mean, population spread, skewness and excess kurtosis of a column, as expressions; null
    where the spread is 0."""
    sd = F.stddev_pop(x)
    return F.avg(x), sd, F.when(sd > 0, F.skewness(x)), F.when(sd > 0, F.kurtosis(x))


def target_distribution(rows: DataFrame, keys: Sequence[str], y: str = "y", bins: int = 10) -> DataFrame:
    """Shape of the target: skewness, kurtosis, variation, bimodality, outliers, distance from
    a normal, and entropy over equal-width bins."""
    keys = list(keys)
    x = finite(F.col(y))
    rows = rows.select(*keys, x.alias("v")).where("v is not null")
    mean, sd, skew, kurt = moments(F.col("v"))
    base = rows.groupBy(*keys).agg(mean.alias("mean"), sd.alias("sd"), skew.alias("y_skew"), kurt.alias("y_kurtosis"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"))
    z = rows.join(base, keys).withColumn("z", ratio(F.col("v") - F.col("mean"), F.col("sd")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("v"))
    cdf = distributions_normal_cdf(F.col("z"))
    k = F.least(F.floor(ratio((F.col("v") - F.col("low")) * float(bins), F.col("high") - F.col("low"))), F.lit(bins - 1))
    placed = z.withColumns({"i": place, "cdf": cdf, "bin": k})
    out = placed.groupBy(*keys).agg(F.avg((F.abs("z") > 2).cast("double")).alias("outlier_frac_2sigma"), F.avg((F.abs("z") > 3).cast("double")).alias("outlier_frac_3sigma"), F.max(F.greatest(F.col("i") / F.col("n") - F.col("cdf"), F.col("cdf") - (F.col("i") - 1) / F.col("n"))).alias("y_ks_normal"))
    share = placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*keys)))
    entropy = share.groupBy(*keys).agg((-F.sum(F.col("p") * F.log("p"))).alias("y_entropy"))
    return base.join(out, keys).join(entropy, keys).select(*keys, "y_skew", "y_kurtosis", ratio(F.col("sd"), F.abs("mean")).alias("y_cv"), ratio(F.col("y_skew") * F.col("y_skew") + 1, F.col("y_kurtosis") + 3).alias("y_bimodality"), "y_ks_normal", "outlier_frac_2sigma", "outlier_frac_3sigma", "y_entropy")


def distributions_normal_cdf(z):
    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return pd.Series(1.0 - distributions.normal_sf(x.to_numpy(float))).where(x.notna().to_numpy())

    return cdf(z.cast("double"))


def long_numeric(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return rows.select(*keys, *keep, *(finite(F.col(c)).alias(c) for c in columns)).unpivot([*keys, *keep], list(columns), "feature", "value")


def feature_moments(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Averages over columns of their shape: skewness, kurtosis, outliers, bimodality, share of
    the mode, median absolute deviation over spread; and how unlike the scales are."""
    keys = list(keys)
    by = [*keys, "feature"]
    long = long_numeric(rows, keys, columns).where("value is not null")
    mean, sd, skew, kurt = moments(F.col("value"))
    base = long.groupBy(*by).agg(mean.alias("mean"), sd.alias("sd"), skew.alias("skew"), kurt.alias("kurt"), F.median("value").alias("med"), F.count("value").alias("n"))
    mode = long.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(F.max("c").alias("mode_count"))
    spread = long.join(base.select(*by, "mean", "sd", "med"), by).groupBy(*by).agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"), F.avg((F.abs(F.col("value") - F.col("mean")) > 3 * F.col("sd")).cast("double")).alias("out"))
    each = base.join(mode, by).join(spread, by)
    bim = ratio(F.col("skew") * F.col("skew") + 1, F.col("kurt") + 3)
    return each.groupBy(*keys).agg(F.avg(F.abs("skew")).alias("mean_abs_skew"), F.max(F.abs("skew")).alias("max_abs_skew"), F.avg("kurt").alias("mean_kurtosis"), F.avg("out").alias("mean_outlier_frac"), F.avg(bim).alias("mean_bimodality"), F.avg(F.col("mode_count") / F.col("n")).alias("mean_mode_share"), F.avg(ratio(F.col("mad"), F.col("sd"))).alias("mean_mad_over_sd"), F.stddev_pop(F.when(F.col("sd") > 0, F.log10("sd"))).alias("scale_dispersion"), F.count(F.lit(1)).alias("n_numeric"))


def categorical_features(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Cardinalities, id-like columns, normalised entropies, mode shares and rare mass."""
    keys = list(keys)
    by = [*keys, "feature"]
    long = rows.select(*keys, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(keys, list(columns), "feature", "value").where("value is not null")
    counts = long.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    p = F.col("c") / F.col("n")
    each = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("card"), F.first("n").alias("n"), (-F.sum(p * F.log(p))).alias("h"), F.max(p).alias("mode"), F.sum(F.when(p < 0.01, p).otherwise(0.0)).alias("rare"))
    id_like = ((F.col("card") >= 0.9 * F.col("n")) & (F.col("n") >= 20)).cast("double")
    return each.groupBy(*keys).agg(F.avg("card").alias("cardinality_mean"), F.max("card").alias("cardinality_max"), F.var_pop("card").alias("cardinality_var"), F.avg(id_like).alias("id_like_frac"), F.avg(F.when(F.col("card") > 1, ratio(F.col("h"), F.log("card"))).otherwise(0.0)).alias("entropy_mean"), F.avg("mode").alias("mode_frac_mean"), F.avg("rare").alias("rare_mass_mean"), F.count(F.lit(1)).alias("n_categorical"))


def class_distribution(rows: DataFrame, keys: Sequence[str], y: str = "y_idx") -> DataFrame:
    """Class counts: number, entropy, imbalance, smallest and largest share, Gini impurity."""
    keys = list(keys)
    counts = rows.where(F.col(y).isNotNull()).groupBy(*keys, y).agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    p = F.col("c") / F.col("n")
    out = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_classes"), (-F.sum(p * F.log(p))).alias("class_entropy"), F.max(p).alias("majority_frac"), F.min(p).alias("minority_frac"), (F.max("c") / F.min("c")).alias("imbalance_ratio"), (1.0 - F.sum(p * p)).alias("gini_impurity"), F.stddev_pop(p).alias("class_share_sd"))
    return out.withColumn("class_entropy_norm", F.when(F.col("n_classes") > 1, F.col("class_entropy") / F.log("n_classes")).otherwise(0.0))


def signal_quality(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str = "y") -> DataFrame:
    """Largest and mean |Pearson| and |Spearman| with the target, their gap, constant columns."""
    keys = list(keys)
    by = [*keys, "feature"]
    long = long_numeric(rows.withColumn("__y", finite(F.col(y))), keys, columns, ["__y"]).where("value is not null and __y is not null")
    ranked = long.withColumns({"rx": average_rank(F.col("value"), by), "ry": average_rank(F.col("__y"), by)})
    each = ranked.groupBy(*by).agg(F.abs(correlation(F.col("value"), F.col("__y"))).alias("pearson"), F.abs(correlation(F.col("rx"), F.col("ry"))).alias("spearman"), F.stddev_pop("value").alias("sd"))
    return each.groupBy(*keys).agg(F.max("pearson").alias("max_abs_pearson"), F.avg("pearson").alias("mean_abs_pearson"), F.max("spearman").alias("max_abs_spearman"), F.avg(F.col("spearman") - F.col("pearson")).alias("nonlinearity_gap"), F.avg((F.col("sd") < 1e-8).cast("double")).alias("near_constant_frac"))


def plug_in_mi(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str) -> DataFrame:
    """Mutual information of categorical columns with a class, from joint counts, in nats."""
    keys = list(keys)
    by = [*keys, "feature"]
    long = rows.select(*keys, F.col(y).cast("string").alias("__y"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)).unpivot([*keys, "__y"], list(columns), "feature", "value")
    joint = long.groupBy(*by, "value", "__y").agg(F.count(F.lit(1)).alias("c"))
    joint = joint.withColumns({"n": F.sum("c").over(Window.partitionBy(*by)), "cx": F.sum("c").over(Window.partitionBy(*by, "value")), "cy": F.sum("c").over(Window.partitionBy(*by, "__y"))})
    p = F.col("c") / F.col("n")
    return joint.groupBy(*by).agg(F.greatest(F.sum(p * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))), F.lit(0.0)).alias("mi"))


def class_signal(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str = "y_idx") -> DataFrame:
    """One-way analysis of variance of each column over classes: largest and mean F and eta
    squared."""
    keys = list(keys)
    by = [*keys, "feature"]
    long = long_numeric(rows, keys, columns, [y]).where("value is not null")
    groups = long.groupBy(*by, y).agg(F.count(F.lit(1)).alias("c"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("w"))
    groups = groups.withColumn("grand", F.sum(F.col("c") * F.col("m")).over(Window.partitionBy(*by)) / F.sum("c").over(Window.partitionBy(*by)))
    each = groups.groupBy(*by).agg(F.sum(F.col("c") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"), F.sum("w").alias("within"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    f = ratio(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))
    eta = ratio(F.col("between"), F.col("between") + F.col("within"))
    return each.groupBy(*keys).agg(F.max(f).alias("anova_f_max"), F.avg(f).alias("anova_f_mean"), F.max(eta).alias("eta2_max"), F.avg(eta).alias("eta2_mean"))


def dimensionality(rows: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """n, d, d/n, shares of discrete and binary columns, missing values."""
    keys = list(keys)
    columns = [*numeric, *categorical]
    d = len(columns)
    missing = sum((F.col(c).isNull().cast("double") for c in columns), F.lit(0.0))
    distinct = [F.count_distinct(c).alias(f"u_{k}") for k, c in enumerate(numeric)]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(missing / float(d)).alias("missing_frac"), F.avg((missing > 0).cast("double")).alias("missing_row_frac"), *distinct)
    share = lambda test: sum((test(F.col(f"u_{k}")).cast("double") for k in range(len(numeric))), F.lit(0.0)) / float(max(1, len(numeric)))
    return out.select(*keys, "n", F.lit(d).alias("d"), (F.lit(float(d)) / F.col("n")).alias("d_over_n"), share(lambda u: u <= 10).alias("discrete_frac"), share(lambda u: u == 2).alias("binary_frac"), "missing_frac", "missing_row_frac")


def correlation_structure(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and largest |r| between columns, every pair an aggregate of one pass."""
    made = []
    for i, a in enumerate(columns):
        made += [F.abs(correlation(finite(F.col(a)), finite(F.col(b)))).alias(f"r_{i}_{j}") for j, b in enumerate(columns) if j > i]
    names = [f"r_{i}_{j}" for i in range(len(columns)) for j in range(i + 1, len(columns))]
    pairs = rows.groupBy(*keys).agg(*made).withColumn("all", F.filter(F.array(*names), lambda v: v.isNotNull()))
    total = F.aggregate("all", F.lit(0.0), lambda acc, v: acc + v)
    return pairs.select(*keys, ratio(total, F.size("all")).alias("mean_abs_corr"), F.array_max("all").alias("max_abs_corr"))


def spread_ratio(rows: DataFrame, keys: Sequence[str], feature: str, y: str = "y", bins: int = 5) -> DataFrame:
    """Largest over smallest spread of the target within quantile bins of a feature."""
    keys = list(keys)
    edges = rows.groupBy(*keys).agg(F.percentile(feature, F.array(*(F.lit(k / bins) for k in range(1, bins)))).alias("edges"))
    binned = rows.join(edges, keys).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(feature))))
    each = binned.groupBy(*keys, "bin").agg(F.stddev_pop(y).alias("sd"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.groupBy(*keys).agg(ratio(F.max("sd"), F.min("sd")).alias("within_bin_sd_ratio"), F.count(F.lit(1)).alias("n_bins"))


def class_overlap(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str = "y_idx") -> DataFrame:
    """Over class pairs and columns: F2, the overlap of the classes' 5 to 95 percent ranges
    over their union (product over columns), and F3, the best column's share outside it."""
    keys = list(keys)
    by = [*keys, "feature"]
    long = long_numeric(rows, keys, columns, [y]).where("value is not null")
    ends = long.groupBy(*by, y).agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    a = ends.select(*by, F.col(y).alias("a"), F.col("q")[0].alias("la"), F.col("q")[1].alias("ha"))
    b = ends.select(*by, F.col(y).alias("b"), F.col("q")[0].alias("lb"), F.col("q")[1].alias("hb"))
    pair = a.join(b, by).where("a < b")
    low, high = F.greatest("la", "lb"), F.least("ha", "hb")
    pair = pair.withColumns({"low": low, "high": high, "overlap": ratio(F.greatest(high - low, F.lit(0.0)), F.greatest("ha", "hb") - F.least("la", "lb"))})
    inside = long.join(pair.select(*by, "a", "b", "low", "high"), by).where((F.col(y) == F.col("a")) | (F.col(y) == F.col("b")))
    f3 = inside.groupBy(*by, "a", "b").agg(F.avg(((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).cast("double")).alias("outside"))
    each = pair.join(f3, [*by, "a", "b"]).groupBy(*keys, "a", "b").agg(F.exp(F.sum(F.log(F.greatest("overlap", F.lit(1e-12))))).alias("f2"), F.max("outside").alias("f3"))
    return each.groupBy(*keys).agg(F.avg("f2").alias("f2_mean"), F.avg("f3").alias("f3_mean"))


def cluster_structure(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str = "y_idx") -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin of the classes as clusters, from centroids."""
    keys = list(keys)
    own = Window.partitionBy(*keys)
    x = rows.select(*keys, F.col(y).alias("c"), *(finite(F.col(k)).alias(k) for k in columns)).dropna()
    standard = x.select(*keys, "c", *(F.coalesce(ratio(F.col(k) - F.avg(k).over(own), F.stddev_pop(k).over(own)), F.lit(0.0)).alias(k) for k in columns))
    centre = standard.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("m"), *(F.avg(k).alias(f"c_{k}") for k in columns))
    d2 = sum((F.pow(F.col(k) - F.col(f"c_{k}"), 2) for k in columns), F.lit(0.0))
    near = standard.join(centre, [*keys, "c"]).groupBy(*keys, "c").agg(F.sum(d2).alias("w"), F.avg(F.sqrt(d2)).alias("s"))
    stats = centre.join(near, [*keys, "c"])
    out_of = sum((F.pow(F.col(f"c_{k}"), 2) for k in columns), F.lit(0.0))
    ch = stats.groupBy(*keys).agg(F.sum(F.col("m") * out_of).alias("b"), F.sum("w").alias("w"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"))
    ch = ch.select(*keys, ratio(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1)).alias("calinski_harabasz"), ratio(F.col("w"), F.col("b") + F.col("w")).alias("centroid_ratio"))
    a = stats.select(*keys, F.col("c").alias("ca"), F.col("s").alias("sa"), *(F.col(f"c_{k}").alias(f"a_{k}") for k in columns))
    b = stats.select(*keys, F.col("c").alias("cb"), F.col("s").alias("sb"), *(F.col(f"c_{k}").alias(f"b_{k}") for k in columns))
    gap = F.sqrt(sum((F.pow(F.col(f"a_{k}") - F.col(f"b_{k}"), 2) for k in columns), F.lit(0.0)))
    worst = a.join(b, keys).where("ca <> cb").groupBy(*keys, "ca").agg(F.max(ratio(F.col("sa") + F.col("sb"), gap)).alias("r"))
    return ch.join(worst.groupBy(*keys).agg(F.avg("r").alias("davies_bouldin")), keys)


# --------------------------------------------------------------------------- whole matrices
def _best_first_tree(x: np.ndarray, y: np.ndarray, leaves: int) -> dict:
    """A regression tree that splits the leaf whose best split gains most."""

    def best(idx: np.ndarray):
        out = (1e-12, -1, 0.0)
        t = y[idx]
        n = len(idx)
        for j in range(x.shape[1]):
            order = np.argsort(x[idx, j], kind="stable")
            v, s = x[idx, j][order], np.cumsum(t[order])
            k = np.arange(1, n)
            gain = s[:-1] ** 2 / k + (s[-1] - s[:-1]) ** 2 / (n - k) - s[-1] ** 2 / n
            gain = np.where(v[1:] > v[:-1], gain, -1.0)
            if n > 1 and gain.max() > out[0]:
                a = int(gain.argmax())
                out = (float(gain[a]), j, (v[a] + v[a + 1]) / 2)
        return out

    root = {"idx": np.arange(len(y)), "depth": 0}
    root["split"] = best(root["idx"])
    open_leaves, gains = [root], np.zeros(x.shape[1])
    while len(open_leaves) < leaves:
        leaf = max(open_leaves, key=lambda node: node["split"][0])
        gain, j, at = leaf["split"]
        if j < 0:
            break
        open_leaves = [node for node in open_leaves if node is not leaf]
        gains[j] += gain
        for side in (x[leaf["idx"], j] <= at, x[leaf["idx"], j] > at):
            child = {"idx": leaf["idx"][side], "depth": leaf["depth"] + 1}
            child["split"] = best(child["idx"])
            open_leaves.append(child)
    return {"leaves": open_leaves, "gains": gains}


def _gini(v: np.ndarray) -> float:
    v = np.sort(np.abs(v))
    total = v.sum()
    n = len(v)
    return float(2 * (np.arange(1, n + 1) * v).sum() / (n * total) - (n + 1) / n) if total > 1e-10 else 0.0


def _knn(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d2 = (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T
    np.fill_diagonal(d2, np.inf)
    near = np.argsort(d2, 1, kind="stable")[:, :k]
    return near, np.sqrt(np.maximum(np.take_along_axis(d2, near, 1), 0))


def _matrix_features(x: np.ndarray, y: np.ndarray, seed: int) -> dict:
    """Tree shape, hierarchical shrinkage, neighbours and singular values of one dataset."""
    rng = np.random.default_rng(seed)
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 1e-12, sd, np.inf)
    n = len(y)
    tree = _best_first_tree(z, y - y.mean(), max(5, int(np.sqrt(n))))
    depth = np.array([leaf["depth"] for leaf in tree["leaves"]], float)
    size = np.array([len(leaf["idx"]) for leaf in tree["leaves"]], float)
    gains = tree["gains"]
    shrink = 10.0
    singular = np.linalg.svd(z, compute_uv=False)
    share = np.cumsum(singular**2) / max(float((singular**2).sum()), 1e-300)
    k = min(5, n - 1)
    near, far = nearest(z, z, k, own=True)
    mixed = np.column_stack([rng.permutation(z[:, j]) for j in range(z.shape[1])])
    null = nearest(mixed, mixed, k, own=True)[1].mean()
    local = np.abs(y - y[near].mean(1))
    return {
        "tree_depth": float(depth.max()), "tree_depth_cv": float(depth.std() / depth.mean()) if depth.mean() else 0.0, "tree_imbalance": float(size.max() / size.mean()), "tree_leaves": float(len(size)),
        "importance_gini": _gini(gains), "importance_top1": float(gains.max() / gains.sum()) if gains.sum() > 0 else 0.0, "used_frac": float((gains > 0).mean()),
        "hs_dof": float((size / (size + shrink)).sum()), "hs_dof_frac": float((size / (size + shrink)).sum() / n),
        "pca95_ratio": float((np.searchsorted(share, 0.95) + 1) / z.shape[1]), "condition": float(singular[0] / max(singular[-1], 1e-12)),
        "knn_dist": float(far.mean()), "knn_null_ratio": float(far.mean() / null) if null > 0 else None, "conceptvar": float(local.mean() / y.std()) if y.std() > 0 else None,
    }


def matrix_features(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str = "y", seed: int = 0, most_rows: int | None = None) -> DataFrame:
    """Tree, shrinkage, neighbour and singular-value features of all rows of a dataset, or of its
    first ``most_rows`` by hash where a cap is given (the reference's is 10,000)."""
    probe = _matrix_features(np.random.default_rng(0).normal(size=(12, 2)), np.arange(12.0), 0)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    names = list(keys)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["__h", *columns, "__y"], kind="stable")
        x, t = cell[list(columns)].to_numpy(float), cell["__y"].to_numpy(float)
        ok = np.isfinite(x).all(1) & np.isfinite(t)
        made = _matrix_features(x[ok], t[ok], seed) if ok.sum() >= 10 else dict.fromkeys(probe)
        return pd.DataFrame([{k: cell[k].iloc[0] for k in names} | made]).astype({k: "float64" for k in probe})

    own = rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns), F.col(y).cast("double").alias("__y"), F.xxhash64(*columns, y).alias("__h"))
    if most_rows is not None:
        order = Window.partitionBy(*keys).orderBy("__h", *columns, "__y")
        own = own.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most_rows).drop("__k")
    return own.groupBy(*keys).applyInPandas(run, fields + "".join(f", {k} double" for k in probe))


def class_neighbours(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str = "y_idx", k: int = 5) -> DataFrame:
    """Share of unlike neighbours, share of rows with any, N2, and the mean silhouette; a task a
    dataset, with distances in blocks of rows."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    names, made = list(keys), ("knn_disagreement", "boundary_frac", "n2", "silhouette")

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        x = cell[list(columns)].to_numpy(float)
        labels, at = np.unique(cell["__y"].to_numpy(), return_inverse=True)
        n, sd = len(x), x.std(0)
        z = (x - x.mean(0)) / np.where(sd > 1e-12, sd, np.inf)
        out = dict.fromkeys(made)
        near, _ = nearest(z, z, min(k, n - 1), own=True)
        if near.size:
            unlike = at[near] != at[:, None]
            out["knn_disagreement"], out["boundary_frac"] = float(unlike.mean()), float(unlike.any(1).mean())
        size, hot = np.bincount(at), np.eye(len(labels))[at]
        within, other, s = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n)
        step = max(1, BLOCK // n)
        for a in range(0, n, step):
            own = np.arange(a, min(a + step, n))
            d = np.zeros((len(own), n))
            for j in range(z.shape[1]):
                d += (z[own, j, None] - z[None, :, j]) ** 2
            d = np.sqrt(d)
            same = at[own, None] == at[None, :]
            other[own] = np.where(same, np.inf, d).min(1)
            total, count = d @ hot, np.tile(size, (len(own), 1)).astype(float)
            count[np.arange(len(own)), at[own]] -= 1
            d[np.arange(len(own)), own] = np.inf
            within[own] = np.where(same, d, np.inf).min(1)
            mean = np.divide(total, count, out=np.full(total.shape, np.nan), where=count > 0)
            mine = mean[np.arange(len(own)), at[own]]
            mean[np.arange(len(own)), at[own]] = np.inf
            best = mean.min(1)
            ok = np.isfinite(mine) & np.isfinite(best)
            s[own[ok]] = (best[ok] - mine[ok]) / np.maximum(np.maximum(mine[ok], best[ok]), 1e-300)
        both = np.isfinite(within) & np.isfinite(other)
        if both.any() and other[both].sum() > 0:
            out["n2"] = float(within[both].sum() / other[both].sum())
        out["silhouette"] = float(s.mean())
        return pd.DataFrame([{c: cell[c].iloc[0] for c in names} | out]).astype(dict.fromkeys(made, "float64"))

    own = rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns), F.col(y).alias("__y")).dropna()
    return own.groupBy(*keys).applyInPandas(run, fields + "".join(f", {c} double" for c in made))
