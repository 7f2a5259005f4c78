"""Pipelines of several operators: metrics runs, dataset analyses, comparisons, conformal runs."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ppd import quantile_grid
from ..operators import bootstrap, classification, compare, complexity, conformal, conformal_local, dataset_features, ensembles, instance_features, instance_predict, learners, mixed, regression, selection, statistics, tables, validation
from ..sources import store as files
from ..sources.store import Store

KEYS = ["task", "dataset_id", "seed", "ratio", "model"]


@dataclass(frozen=True)
class Analyzer:
    """What a dataset-level analysis runs."""

    name: str
    least: int = 4


def metrics_run(store: Store, levels: Sequence[float], alphas: Sequence[float] = regression.ALPHAS, numeric: Sequence[str] = (), categorical: Sequence[str] = (), task: str = "regression", n_classes: int = 2) -> DataFrame:
    """Metrics of all predictions of a task that have none yet, saved and returned in long form.
    Regression records without a distribution get R2 alone."""
    predictions = store.scan("predictions", task=task)
    todo = store.pending("metrics", predictions.select(*KEYS).distinct(), KEYS)
    rows = predictions.join(todo, KEYS, "left_semi")
    if task == "classification":
        wide = classification.all_metrics(rows, KEYS, n_classes)
        values = [c for c in wide.columns if c not in KEYS]
        made = wide.select(*KEYS, *(F.col(c).cast("double").alias(c) for c in values)).unpivot(KEYS, values, "metric", "value").where("value is not null").withColumn("alpha", F.lit(None).cast("double"))
    else:
        made = regression.all_metrics(rows.where("ppd is not null"), KEYS, levels, alphas, numeric, categorical)
        points = regression.point_records(rows.where("ppd is null"), KEYS).where("r2 is not null")
        made = made.unionByName(points.select(*KEYS, F.lit("r2").alias("metric"), F.col("r2").alias("value"), F.lit(None).cast("double").alias("alpha")))
    store.save(made, "metrics")
    return made


def prediction_run(store: Store, rows: DataFrame, features: Sequence[str], levels: Sequence[float], models: Sequence[str] = ("trees",), y: str = "y", **params) -> DataFrame:
    """Predictions of registered models for the test rows of every (task, dataset, seed, ratio) that
    have none yet, learned from its train rows; saved and returned."""
    cell = ["task", "dataset_id", "seed", "ratio"]
    out = None
    for name in models:
        todo = store.pending("predictions", rows.select(*cell).distinct().withColumn("model", F.lit(name)), KEYS)
        own = rows.join(todo.select(*cell), cell, "left_semi")
        keyed = {"keys": cell} if name == "trees" else {}
        made = learners.PREDICTORS[name](levels, **keyed, **params).fit_predict(own.where("split = 'train'").drop("ppd", "point_pred"), own.where("split = 'test'").drop("ppd", "point_pred"), features, y).withColumn("model", F.lit(name))
        out = made if out is None else out.unionByName(made)
    store.save(out, "predictions")
    return out


#: Groups of dataset features: name to (rows, keys, numeric, categorical, y) -> DataFrame; add to
#: it to plug one in.
FEATURE_GROUPS: dict[str, Callable[..., DataFrame]] = {
    "moments": lambda rows, keys, numeric, categorical, y: dataset_features.feature_moments(rows, keys, numeric),
    "signal": lambda rows, keys, numeric, categorical, y: dataset_features.signal_quality(rows, keys, numeric, y),
    "target": lambda rows, keys, numeric, categorical, y: dataset_features.target_distribution(rows, keys, y),
    "dimensionality": lambda rows, keys, numeric, categorical, y: dataset_features.dimensionality(rows, keys, numeric, categorical),
    "correlation": lambda rows, keys, numeric, categorical, y: dataset_features.correlation_structure(rows, keys, numeric),
    "complexity": lambda rows, keys, numeric, categorical, y: complexity.complexity(rows, keys, numeric, y),
    "shrinkage": lambda rows, keys, numeric, categorical, y: complexity.shrinkage(rows, keys, numeric, y),
    "information": lambda rows, keys, numeric, categorical, y: complexity.information(rows, keys, numeric, y),
}


def feature_run(store: Store, rows: DataFrame, columns: Sequence[str], y: str = "y", categorical: Sequence[str] = (), groups: Sequence[str] = ("moments", "signal", "target")) -> DataFrame:
    """Dataset features of every (task, dataset, seed) by group, saved and returned."""
    keys = ["task", "dataset_id", "seed"]
    out = None
    for name in groups:
        made = FEATURE_GROUPS[name](rows, keys, list(columns), list(categorical), y)
        # A feature of two groups is taken from the first.
        made = made if out is None else made.select(*keys, *(c for c in made.columns if c not in out.columns))
        out = made if out is None else out.join(made, keys, "left")
    store.save(out, "dataset_features")
    return out


def instance_analysis(rows: DataFrame, features: Sequence[str], responses: dict[str, bool], keys: Sequence[str] = ("model", "alpha"), raw_units: Sequence[str] = ()) -> dict[str, DataFrame]:
    """What features tell of each response of instances (True: a class, such as covered); columns
    in the target's own units are left out."""
    own = selection.predictors_of(features, [*keys, *responses], raw_units=raw_units)
    return {r: instance_predict.predictability(rows, keys, own, r, classes) for r, classes in responses.items()}


def instance_run(store: Store, context: DataFrame, levels: Sequence[float], columns: Sequence[str]) -> DataFrame:
    """Instance features of predictions that have metrics; others are left out."""
    done = store.scan("metrics").select(*KEYS).distinct()
    rows = store.scan("predictions").join(done, KEYS, "left_semi")
    out = instance_features.input_quality(instance_features.ppd_statistics(rows, levels), columns)
    out = instance_features.context_statistics(out, context, ["task", "dataset_id", "seed"])
    store.save(out, "instance_features")
    return out


def dataset_analysis(table: DataFrame, features: Sequence[str], responses: Sequence[str], analyzers: Sequence[Analyzer] = (Analyzer("spearman"), Analyzer("chatterjee", 10), Analyzer("lme"))) -> dict[str, DataFrame]:
    """One long summary an analyzer, over every model, response and feature at once."""
    ids = ["dataset_id", "seed", "model"]
    long_y = table.select(*ids, *(F.col(r).cast("double").alias(r) for r in responses)).unpivot(ids, list(responses), "response", "y")
    long_x = table.select(*ids, *(F.col(f).cast("double").alias(f) for f in features)).unpivot(ids, list(features), "feature", "x")
    pairs = long_y.join(long_x, ids)
    keys = ["model", "response", "seed", "feature"]
    out = {}
    for a in analyzers:
        if a.name == "spearman":
            out[a.name] = statistics.fisher_z(statistics.spearman(pairs, keys, least=a.least), ["model", "response", "feature"])
        elif a.name == "chatterjee":
            xi = statistics.chatterjee(pairs.withColumn("row_id", F.col("dataset_id")), keys, least=a.least)
            out[a.name] = statistics.mean_sd(xi, ["model", "response", "feature"], "xi")
        elif a.name == "lme":
            out[a.name] = mixed.mixed_model(long_y.join(table.select(*ids, *features), ids).withColumnRenamed("y", "value"), ["model", "response"], "value", features)
        elif a.name == "trees":
            out[a.name] = learners.tree_importance(long_y.join(table.select(*ids, *features), ids).withColumnRenamed("y", "value"), ["model", "response"], "value", features)
        else:
            raise ValueError(f"unknown analyzer {a.name}")
    return out


def feature_selection(summary: DataFrame, value: Sequence[str], how: str = "topk", k: int = 5, threshold: float = 0.0, p_max: float | None = None) -> dict[str, DataFrame]:
    """Selected features of each model, their union, and those common to all responses."""
    long = selection.long_importance(summary, value).drop("p").withColumnRenamed("p_value", "p")
    chosen = selection.select(long, ["model", "response"], how, k, threshold, p_max=p_max)
    return {"selected": chosen, "union": selection.union_over(chosen, ["response"]), "common": selection.common_to(chosen, ["model"])}


def model_comparison(table: DataFrame, metric: str, alpha: float | None = None, worst: int = 10, extreme: int = 5) -> dict[str, DataFrame]:
    return {
        "overview": compare.model_comparison(table, [metric], ["model"] if "alpha" not in table.columns else ["model", "alpha"]),
        "worst": compare.worst_datasets(table, metric, alpha, worst),
        "extremes": compare.model_extremes(table, metric, alpha, extreme),
        "wins": compare.wins(table, metric, alpha),
        "wilcoxon": compare.pairwise_wilcoxon(table, metric, alpha),
        "agreement": compare.ranking_agreement(table, metric, alpha),
    }


def pair_comparison(table: DataFrame, a: str, b: str, metrics: Sequence[str], features: Sequence[str], variants: Sequence[str] = ("standard", "robust", "binary")) -> dict[str, DataFrame]:
    """Importances of features for the change from a to b: as is, winsorised, and its sign."""
    base = tables.pair_delta(table, a, b, metrics, ["dataset_id", "seed"], features)
    out = {}
    for v in variants:
        rows = base
        for m in [m for m in metrics if m in base.columns]:
            if v == "robust":
                rows = tables.winsorise(rows, m, ["model"]).drop("clipped")
            elif v == "binary":
                rows = tables.binary_delta(rows, [m])
            out[f"{v}_{m}"] = learners.tree_importance(rows.dropna(subset=[m]), ["model"], m, features)
    return out


def conformal_run(rows: DataFrame, keys: Sequence[str], levels: Sequence[float], alphas: Sequence[float], features: Sequence[str]) -> DataFrame:
    """Bounds and scores of every method; the bundle is checked first."""
    validation.require(validation.bad_bundle_rows(rows, len(levels)), "bad prediction rows")
    validation.require(validation.shared_rows(rows, keys, "row_pos"), "rows in several roles")
    parts = [("Vanilla", conformal.vanilla(rows, levels, alphas))]
    for kind, name in (("absolute", "SCP-ABS"), ("normalised", "SCP-NORM"), ("cqr", "SCP-CQR"), ("cqr_standard", "SCP-CQR-standard"), ("pit", "SCP-PIT")):
        parts.append((name, conformal.split_conformal(rows, keys, levels, alphas, kind)))
    for a in alphas:
        parts.append(("RCP", conformal.rectified(rows, keys, levels, a, features[0])))
        parts += [(m, conformal_local.local_conformal(rows, keys, levels, a, features, m)) for m in conformal_local.METHODS]
    own = [*keys, "row_pos", "y", "alpha", "lower", "upper", "empty_set"]
    out = None
    for name, made in parts:
        each = made.select(*own).withColumn("method", F.lit(name))
        out = each if out is None else out.unionByName(each)
    return regression.score_intervals(out)


def experiment_matches(have: dict, want: dict) -> None:
    """An experiment goes on only with the options it began with."""
    changed = sorted(k for k in set(have) | set(want) if have.get(k) != want.get(k))
    if changed:
        raise ValueError(f"the experiment was begun with other {', '.join(changed)}")


def conformal_experiment(spark: SparkSession, root: str, levels: Sequence[float], alphas: Sequence[float], features: Sequence[str]) -> DataFrame:
    """Bounds of all methods for the predictions of ``root`` that have none yet; options are
    written once and compared when a run goes on."""
    store = Store(spark, [root])
    options = {"levels": list(levels), "alphas": list(alphas), "features": list(features), "methods": sorted(conformal_local.METHODS)}
    where = f"{root.rstrip('/')}/experiment.json"
    try:
        experiment_matches(json.loads(spark.read.text(where).first()[0]), json.loads(json.dumps(options)))
    except AnalysisException:
        files.write_text(spark, where, json.dumps(options))
    rows = store.scan("predictions")
    todo = store.pending("conformal", rows.select(*KEYS).distinct(), KEYS)
    made = conformal_run(rows.join(todo, KEYS, "left_semi"), KEYS, levels, alphas, features)
    store.save(made, "conformal")
    return made


def conformal_evaluation(store: Store) -> DataFrame:
    """Metrics of every method, dataset, seed and level in long form, saved and returned."""
    rows = store.scan("conformal")
    wide = conformal.interval_summary(rows, [*KEYS, "method", "alpha"])
    made = wide.select(*KEYS, "method", "alpha", *(F.col(c).cast("double").alias(c) for c in ("coverage", "avg_width", "interval_score"))).unpivot([*KEYS, "method", "alpha"], ["coverage", "avg_width", "interval_score"], "metric", "value")
    store.save(made, "conformal_metrics")
    return made


def benchmark_tables(long: DataFrame) -> dict[str, DataFrame]:
    """Dataset means, ranks and their bootstrap intervals of seed trials (metric, dataset_id,
    seed, model, value), by name."""
    means = long.groupBy("dataset_id", "model", "metric").agg(F.avg("value").alias("value"))
    placed = tables.ranks(means, ["dataset_id"])
    return {"ranks": placed, "rank_intervals": bootstrap.mean_rank_intervals(placed), "dataset_means": means}


def ensemble_tables(trials: DataFrame, seeds: int = 5) -> dict[str, DataFrame]:
    means = ensembles.dataset_means(trials, seeds)
    return {"ensemble_medians": ensembles.medians(means), "ensemble_joint_ranks": tables.joint_ranks(means, ["dataset_id"])}


def main(argv: Sequence[str] | None = None) -> int:
    """spark-submit entry; see --help for the commands.  Exits with 1 if what was asked for failed."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, alphas: bool = False, features: bool = False):
        own = commands.add_parser(name)
        for p in places:
            own.add_argument(p)
        own.add_argument("--step", type=float, default=0.005)
        if alphas:
            own.add_argument("--alphas", type=float, nargs="+", default=list(regression.ALPHAS))
        if features:
            own.add_argument("--features", nargs="+", required=True)
        return own

    own = command("metrics", "root", alphas=True)
    own.add_argument("--task", choices=("regression", "classification"), default="regression")
    own.add_argument("--classes", type=int, default=2)
    command("predict", "root", "rows", features=True).add_argument("--models", nargs="+", default=["trees"])
    own = command("features", "root", "rows", features=True)
    own.add_argument("--groups", nargs="+", default=["moments", "signal", "target"], choices=list(FEATURE_GROUPS))
    own.add_argument("--categorical", nargs="*", default=[])
    command("conformal-run", "root", alphas=True, features=True)
    command("conformal-evaluate", "root")
    command("conformal-summarize", "root", "out")
    command("benchmark-tables", "trials", "out")
    command("ensemble-tables", "trials", "out")
    command("query", "name", "sf_dir", "out")
    got = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    levels = quantile_grid(got.step)
    if got.command == "query":
        from .queries import QUERIES

        QUERIES[got.name].run(spark, got.sf_dir).write.mode("overwrite").parquet(got.out)
    elif got.command == "metrics":
        metrics_run(Store(spark, [got.root]), levels, got.alphas, task=got.task, n_classes=got.classes)
    elif got.command == "predict":
        prediction_run(Store(spark, [got.root]), spark.read.parquet(got.rows), got.features, levels, got.models)
    elif got.command == "features":
        rows = spark.read.parquet(got.rows)
        made = feature_run(Store(spark, [got.root]), rows, got.features, categorical=got.categorical, groups=got.groups)
        keys = ["task", "dataset_id", "seed"]
        if rows.select(*keys).distinct().join(made.select(*keys), keys, "left_anti").count():
            return 1
    elif got.command == "conformal-run":
        conformal_experiment(spark, got.root, levels, got.alphas, got.features)
    elif got.command == "conformal-evaluate":
        conformal_evaluation(Store(spark, [got.root]))
    elif got.command == "conformal-summarize":
        deltas = conformal.paired_deltas(Store(spark, [got.root]).scan("conformal_metrics").withColumnRenamed("model", "base_model"))
        files.write_tables({"summary": conformal.summarise(deltas)}, got.out)
    elif got.command == "benchmark-tables":
        files.write_tables(benchmark_tables(files.read_tsv(spark, got.trials)), got.out)
    else:
        files.write_tables(ensemble_tables(files.read_tsv(spark, got.trials)), got.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
