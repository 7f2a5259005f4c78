"""Two-way decompositions of complete dataset-by-model panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import correlation, finite, ratio


def complete(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Only datasets that have a finite value of every model of their panel."""
    rows = panel.withColumn("value", finite(F.col("value"))).where("value is not null")
    models = panel.groupBy(*by).agg(F.count_distinct("model").alias("all_models")) if by else panel.agg(F.count_distinct("model").alias("all_models"))
    have = rows.groupBy(*by, "dataset_id").agg(F.count_distinct("model").alias("own_models"))
    have = have.join(models, list(by)) if by else have.crossJoin(F.broadcast(models))
    good = have.where("own_models = all_models").select(*by, "dataset_id")
    return rows.join(good, [*by, "dataset_id"], "left_semi")


def centred(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Grand mean, dataset effect, model effect and interaction of each value."""
    if by:
        all_rows, row, column = (Window.partitionBy(*by, *k) for k in ((), ("dataset_id",), ("model",)))
        grand = F.avg("value").over(all_rows)
        out = panel.withColumn("grand", grand)
    else:
        out = panel.crossJoin(F.broadcast(panel.agg(F.avg("value").alias("grand"))))
        row, column = Window.partitionBy("dataset_id"), Window.partitionBy("model")
    out = out.withColumns({"dataset_effect": F.avg("value").over(row) - F.col("grand"), "model_effect": F.avg("value").over(column) - F.col("grand")})
    return out.withColumn("interaction", F.col("value") - F.col("grand") - F.col("dataset_effect") - F.col("model_effect"))


def shares(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shares of the total sum of squares; they add up to 1."""
    parts = centred(panel, by)
    square = lambda c: F.sum(F.pow(c, 2))
    agg = [square(F.col("dataset_effect")).alias("d"), square(F.col("model_effect")).alias("m"), square(F.col("interaction")).alias("i"), square(F.col("value") - F.col("grand")).alias("t")]
    out = parts.groupBy(*by).agg(*agg) if by else parts.agg(*agg)
    return out.select(*by, *(ratio(F.col(k), F.col("t")).alias(n) for k, n in (("d", "dataset_share"), ("m", "model_share"), ("i", "interaction_share"))))


def split_stability(panel: DataFrame) -> DataFrame:
    """Correlation of interactions between every two seeds on datasets complete in all seeds."""
    rows = complete(panel, ["seed"])
    seeds = panel.agg(F.count_distinct("seed").alias("all_seeds"))
    good = rows.groupBy("dataset_id").agg(F.count_distinct("seed").alias("n")).crossJoin(F.broadcast(seeds)).where("n = all_seeds").select("dataset_id")
    parts = centred(rows.join(good, "dataset_id", "left_semi"), ["seed"]).select("seed", "dataset_id", "model", "interaction")
    a, b = parts.toDF("seed_a", "dataset_id", "model", "x"), parts.toDF("seed_b", "dataset_id", "model", "y")
    out = a.join(b, ["dataset_id", "model"]).where("seed_a < seed_b").groupBy("seed_a", "seed_b").agg(correlation(F.col("x"), F.col("y")).alias("r"), F.count_distinct("dataset_id").alias("n_datasets"))
    return out.where("n_datasets >= 2")


def gaps(panel: DataFrame) -> DataFrame:
    """Differences of every two models over datasets: mean, spread, signs, agreement."""
    means = panel.groupBy("dataset_id", "model").agg(F.avg("value").alias("value"))
    a, b = means.toDF("dataset_id", "model_a", "va"), means.toDF("dataset_id", "model_b", "vb")
    both = a.join(b, "dataset_id").where("model_a < model_b").withColumn("gap", F.col("va") - F.col("vb"))
    share = lambda c: F.avg(c.cast("double"))
    out = both.groupBy("model_a", "model_b").agg(F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("sd_gap"), F.count(F.lit(1)).alias("n"), share(F.col("gap") > 0).alias("frac_positive"), share(F.col("gap") < 0).alias("frac_negative"), share(F.col("gap") == 0).alias("frac_tie"))
    agree = F.when(F.col("mean_gap") > 0, F.col("frac_positive")).when(F.col("mean_gap") < 0, F.col("frac_negative")).otherwise(F.col("frac_tie"))
    return out.withColumn("direction_agreement", agree)


def normalised(panel: DataFrame) -> DataFrame:
    """Values over their dataset's mean magnitude, so that datasets weigh alike."""
    own = Window.partitionBy("dataset_id")
    return panel.withColumn("value", ratio(F.col("value"), F.avg(F.abs("value")).over(own)))


def profiles(panel: DataFrame, keys: Sequence[str] = ("metric", "model")) -> DataFrame:
    """Median and quartiles across datasets."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return panel.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"))
