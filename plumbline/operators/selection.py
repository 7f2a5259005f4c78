"""Feature selection from importance summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered(importances: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("xi", "shap", "lr", "ridge")) -> DataFrame:
    """``place`` by the first of the columns that the table has, largest first, missing last;
    one column for all rows, as columns have scales of their own."""
    have = next((c for c in columns if c in importances.columns), None)
    if have is None:
        raise ValueError(f"none of {', '.join(columns)} is there to order by")
    own = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(have), "feature")
    return importances.withColumn("place", F.row_number().over(own))


def select(importances: DataFrame, keys: Sequence[str], how: str = "topk", k: int = 5, threshold: float = 0.0, value: str = "importance", p_max: float | None = None) -> DataFrame:
    """topk, threshold or threshold_topk of |value| within keys, with its place."""
    rows = importances.where(F.col(value).isNotNull())
    if p_max is not None:
        rows = rows.where(F.col("p") <= p_max)
    if how in ("threshold", "threshold_topk"):
        rows = rows.where(F.abs(F.col(value)) >= threshold)
    elif how != "topk":
        raise ValueError(f"unknown selection {how}")
    own = Window.partitionBy(*keys).orderBy(F.desc(F.abs(F.col(value))), "feature")
    placed = rows.withColumn("place", F.row_number().over(own))
    return placed if how == "threshold" else placed.where(F.col("place") <= k)


def union_over(selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features that any model selected, with how many did and the best place."""
    return selected.groupBy(*keys, "feature").agg(F.count_distinct("model").alias("n_models"), F.min("place").alias("best_place"))


def common_to(selected: DataFrame, keys: Sequence[str], over: str = "response") -> DataFrame:
    """Features selected for every value of ``over`` that its keys have."""
    all_of = selected.groupBy(*keys).agg(F.count_distinct(over).alias("wanted"))
    have = selected.groupBy(*keys, "feature").agg(F.count_distinct(over).alias("n"))
    return have.join(all_of, list(keys)).where("n = wanted").select(*keys, "feature")


def long_importance(summary: DataFrame, value_columns: Sequence[str], p_columns: Sequence[str] = ("p", "p_acat")) -> DataFrame:
    """Summaries of any analyzer as (response, feature, importance, p): the first column that
    is there; rows without a response or feature are dropped."""
    value = F.coalesce(*(F.col(c).cast("double") for c in value_columns if c in summary.columns))
    ps = [F.col(c).cast("double") for c in p_columns if c in summary.columns]
    out = summary.withColumns({"importance": value, "p_value": F.coalesce(*ps) if ps else F.lit(None).cast("double")})
    return out.dropna(subset=["response", "feature"])


def partition_problems(groups: dict[str, Sequence[str]], everything: Sequence[str]) -> list[str]:
    """Features that are in no group or in several."""
    count: dict[str, int] = dict.fromkeys(everything, 0)
    for own in groups.values():
        for f in own:
            count[f] = count.get(f, 0) + 1
    return sorted(f for f, n in count.items() if n != 1)


def nested_groups(x: Sequence[str], y: Sequence[str], relation: Sequence[str], auxiliary: Sequence[str]) -> dict[str, list[str]]:
    """Feature sets that grow: of inputs, with the target's, with their direct relation, with
    what auxiliary models tell.  A feature in two of them is an error."""
    direct = [f for f in relation if f not in set(auxiliary)]
    aux = [f for f in relation if f in set(auxiliary)]
    parts = {"X": list(x), "+Y": list(y), "+XY": direct, "+Aux": aux}
    everything = [f for own in parts.values() for f in own]
    if twice := partition_problems(parts, everything):
        raise ValueError(f"in several groups: {', '.join(twice)}")
    out, held = {}, []
    for name, own in parts.items():
        held = [*held, *own]
        out[name] = held
    return out


def only_selected(features: DataFrame, selected: Sequence[str], column: str = "feature") -> DataFrame:
    """Rows of features that are selected, and none of a task's other features."""
    wanted = features.sparkSession.createDataFrame([(f,) for f in selected], "__f string").distinct()
    return features.join(wanted, features[column] == wanted["__f"], "left_semi")


def predictors_of(columns: Sequence[str], ids: Sequence[str], redundant: Sequence[str] = ("dim_ratio",), raw_units: Sequence[str] = ()) -> list[str]:
    """The feature columns that an analysis takes when it names none: all but keys, redundant
    ones, and those in the target's own units."""
    out = set(ids) | set(redundant) | set(raw_units)
    return [c for c in columns if c not in out]
