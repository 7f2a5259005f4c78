"""Bootstrap intervals with a dataset as the unit.

Draws come from numpy generators with fixed seeds, so results can be repeated bit for bit.
What is drawn from is one value a dataset; groups are bounded by the number of datasets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import wilcoxon_p
from ..functions.scalar import finite
from .registry import signed

DRAWS = 10_000
RANK_SEED, ENSEMBLE_SEED, CONTRAST_SEED = 20261005, 20261006, 20260930


def means(values: np.ndarray, rng: np.random.Generator, draws: int = DRAWS, chunk: int = 1000) -> np.ndarray:
    """Means of resampled rows, one row a draw; draws are taken in chunks of bounded size."""
    n, out = len(values), []
    for k in range(0, draws, chunk):
        pick = rng.integers(0, n, size=(min(chunk, draws - k), n))
        out.append(values[pick].mean(1))
    return np.concatenate(out)


def mean_rank_intervals(ranked: DataFrame, metric: str = "metric", draws: int = DRAWS, seed: int = RANK_SEED) -> DataFrame:
    """Mean rank of each model and its percentile interval; models share each draw."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        wide = group.pivot(index="dataset_id", columns="model", values="rank").dropna().sort_index().sort_index(axis=1)
        drawn = means(wide.to_numpy(float), np.random.default_rng(seed), draws)
        low, high = np.percentile(drawn, [2.5, 97.5], axis=0)
        return pd.DataFrame({metric: group[metric].iloc[0], "model": wide.columns, "mean_rank": wide.to_numpy(float).mean(0), "ci_low": low, "ci_high": high, "n_datasets": len(wide)})

    return ranked.select(metric, "dataset_id", "model", F.col("rank").cast("double").alias("rank")).groupBy(metric).applyInPandas(run, f"{metric} string, model string, mean_rank double, ci_low double, ci_high double, n_datasets long")


def contrast_intervals(deltas: DataFrame, keys: Sequence[str], value: str = "delta", draws: int = DRAWS, seed: int = CONTRAST_SEED) -> DataFrame:
    """Mean paired contrasts and their intervals; contrasts over the same datasets share draws."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in deltas.select(*keys).schema)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        v = group.sort_values("dataset_id")["__v"].to_numpy(float)
        v = v[np.isfinite(v)]
        if not len(v):
            stats = (None, None, None)
        else:
            low, high = np.percentile(means(v, np.random.default_rng(seed), draws), [2.5, 97.5])
            stats = (v.mean(), low, high)
        return pd.DataFrame([{k: group[k].iloc[0] for k in keys} | dict(zip(("mean", "ci_low", "ci_high"), stats, strict=True)) | {"n_datasets": len(v)}]).astype({"mean": float, "ci_low": float, "ci_high": float})

    return deltas.select(*keys, "dataset_id", F.col(value).cast("double").alias("__v")).groupBy(*keys).applyInPandas(run, fields + ", mean double, ci_low double, ci_high double, n_datasets long")


def transitions(panel: DataFrame) -> DataFrame:
    """Signed improvement of each dataset and model from each ensemble size to the next."""
    own = Window.partitionBy("metric", "model", "dataset_id").orderBy("ensemble")
    here, there = signed(F.col("metric"), F.col("value")), signed(F.col("metric"), F.lead("value").over(own))
    steps = panel.withColumns({"next": F.lead("ensemble").over(own), "gain": here - there})
    return steps.where("next is not null").groupBy("metric", "ensemble", "next", "dataset_id").agg(F.avg(finite(F.col("gain"))).alias("gain"))


def transition_summary(steps: DataFrame, draws: int = DRAWS, seed: int = ENSEMBLE_SEED) -> DataFrame:
    """Mean gain, interval, share improved and signed-rank p of each transition.  All share one
    advancing generator, so they are drawn in order, by metric and size, in one task; its
    input is one value a dataset and transition."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rng, out = np.random.default_rng(seed), []
        for (metric, a, b), own in group.sort_values(["metric", "ensemble", "dataset_id"]).groupby(["metric", "ensemble", "next"], sort=True):
            v = own["gain"].to_numpy(float)
            low, high = np.percentile(means(v, rng, draws), [2.5, 97.5])
            out.append((metric, a, b, v.mean(), low, high, float((v > 0).mean()), wilcoxon_p(v), len(v)))
        return pd.DataFrame(out, columns=["metric", "ensemble", "next", "mean_gain", "ci_low", "ci_high", "frac_improved", "p", "n_datasets"])

    return steps.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(run, "metric string, ensemble int, next int, mean_gain double, ci_low double, ci_high double, frac_improved double, p double, n_datasets long")
