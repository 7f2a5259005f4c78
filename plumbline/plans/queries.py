"""Queries of the reliability operators on the test panels, each with its SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ppd

from ..operators import bootstrap, classification, compare, complexity, conformal, conformal_local, dataset_features, decompose, ensembles, instance_features, instance_predict, learners, mixed, preprocessing, regression, sampling, selection, statistics, tables, validation
from ..operators.registry import registry
from ..sources.panels import KEYS, LEVELS, bin_panel, clf_panel, feature_panel, reg_panel, table
from ..streaming.coverage import windowed_coverage, with_bounds
from . import sql as S


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Numbers rounded to six places, NaN as null, no negative zero."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), 6) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns))


def register(sql: str | None = None, doubles: str = ""):
    """Adds a function to the registry, under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = Query(lambda spark, sf_dir: tidy(f(spark, sf_dir)), None if sql is None else S.finished(sql, doubles))
        return f

    return add


def _scored(spark, d):
    return regression.intervals(reg_panel(spark, d), LEVELS)


def _cells(spark, d):
    return regression.interval_metrics(_scored(spark, d), KEYS)


def _points(spark, d):
    return regression.point_accuracy(reg_panel(spark, d), KEYS)


def _wide(spark, d):
    return _cells(spark, d).join(_points(spark, d), KEYS)


ALPHA_METRICS = ["interval_score", "cov_abs_dev", "cov_dev_signed", "avg_width_norm"]
FREE_METRICS = ["r2", "rmse", "mae"]


def _long(spark, d):
    free = _points(spark, d).withColumn("alpha", F.lit(None).cast("double")).unpivot([*KEYS, "alpha"], FREE_METRICS, "metric", "value")
    return free.unionByName(_cells(spark, d).unpivot([*KEYS, "alpha"], ALPHA_METRICS, "metric", "value"))


def _features_long(spark, d):
    return feature_panel(spark, d).unpivot(["dataset_id", "seed"], S.FEATURES, "feature", "value")


def _mae_panel(spark, d):
    return _points(spark, d).select(*KEYS, F.col("mae").alias("value"))


def _instances(spark, d):
    return classification.instance_columns(clf_panel(spark, d))


CKEYS = ["dataset_id", "model"]

# --------------------------------------------------------------------------- regression metrics
_IM_COLUMNS = "marginal_coverage nominal cov_dev_signed cov_abs_dev avg_length avg_width_norm interval_score pinball_lower pinball_upper pinball_mean"


@register(S.query(S.REG, S.IV, S.IM, "SELECT * FROM im"), "alpha " + _IM_COLUMNS)
def r_interval_metrics(spark, d):
    return _cells(spark, d)


_TRAPEZOID = "list_sum(list_transform(range(1, 19), lambda k: (f[k] + f[k + 1]) / 2 * 0.05::DOUBLE))"


@register(S.query(S.REG, S.PPD, f"""
c AS (SELECT dataset_id, seed, model, list_transform(range(1, 20), lambda k: CASE WHEN y >= q[k] THEN {S.LEVELS}[k] * (y - q[k]) ELSE ({S.LEVELS}[k] - 1) * (y - q[k]) END) AS f FROM ppd)""",
f"SELECT dataset_id, seed, model, avg(2 * {_TRAPEZOID}) AS crps_mean FROM c GROUP BY ALL"), "crps_mean")
def r_crps(spark, d):
    return regression.crps_metric(regression.distribution_rows(reg_panel(spark, d), LEVELS), KEYS)


_PIT = """
pit AS (
  SELECT dataset_id, seed, model, greatest(least(0.5 + (y / point_pred - 1) / spread, 0.95::DOUBLE), 0.05::DOUBLE) AS pit FROM reg_panel)"""


@register(S.query(S.REG, _PIT, """
k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, seed, model ORDER BY pit) AS i, count(*) OVER (PARTITION BY dataset_id, seed, model) AS n FROM pit)""",
"SELECT dataset_id, seed, model, max(greatest(i / n - pit, pit - (i - 1) / n)) AS pit_ks_stat FROM k GROUP BY ALL"), "pit_ks_stat")
def r_pit_ks(spark, d):
    rows = regression.distribution_rows(reg_panel(spark, d), LEVELS)
    return regression.pit_metrics(rows, KEYS, p_value=False).select(*KEYS, "pit_ks_stat")


@register(S.query(S.REG, _PIT, """
k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, seed, model ORDER BY pit) AS i, count(*) OVER (PARTITION BY dataset_id, seed, model) AS n FROM pit),
l AS (SELECT dataset_id, seed, model, sum(abs(w - q)) / {b} AS pit_ece FROM (SELECT dataset_id, seed, model, q, avg(CASE WHEN pit <= q THEN 1 ELSE 0 END) AS w FROM pit CROSS JOIN (SELECT unnest(list_transform(range(1, {b} + 1), lambda j: j / ({b} + 1.0::DOUBLE))) AS q) GROUP BY ALL) GROUP BY ALL),
h AS (SELECT dataset_id, seed, model, least(floor(pit * {b}), {b} - 1) AS bin, count(*) / max(n) AS p FROM k GROUP BY ALL),
f AS (SELECT dataset_id, seed, model, sum(abs(p - 1 / {b}.0::DOUBLE)) + ({b} - count(*)) / {b}.0::DOUBLE AS pit_hist_l1 FROM h GROUP BY ALL),
s AS (SELECT dataset_id, seed, model, max(greatest(i / n - pit, pit - (i - 1) / n)) AS pit_ks_stat FROM k GROUP BY ALL)""".replace("{b}", str(regression.PIT_BINS)),
"SELECT * FROM s JOIN l USING (dataset_id, seed, model) JOIN f USING (dataset_id, seed, model)"), "pit_ks_stat pit_ece pit_hist_l1")
def r_pit_calibration(spark, d):
    rows = regression.distribution_rows(reg_panel(spark, d), LEVELS)
    return regression.pit_metrics(rows, KEYS, p_value=False)


@register()
def r_pit_all(spark, d):
    return regression.pit_metrics(regression.distribution_rows(reg_panel(spark, d), LEVELS), KEYS)


@register(S.query(S.REG, S.PA, "SELECT * FROM pa"), "r2 rmse mae")
def r_point_accuracy(spark, d):
    return _points(spark, d)


@register(S.query(S.REG, S.IV, """
e AS (SELECT dataset_id, seed, model, alpha, [quantile_cont(x_qty, 0.2), quantile_cont(x_qty, 0.4), quantile_cont(x_qty, 0.6), quantile_cont(x_qty, 0.8)] AS edges FROM iv WHERE NOT eval_half GROUP BY ALL),
b AS (SELECT iv.*, len(list_filter(edges, lambda e: e < x_qty)) AS bin FROM iv JOIN e USING (dataset_id, seed, model, alpha)),
s AS (SELECT dataset_id, seed, model, alpha, bin::INT AS bin, avg(CASE WHEN NOT eval_half THEN covered END) AS seen, avg(CASE WHEN eval_half THEN covered END) AS worst_slab_coverage FROM b GROUP BY ALL)""",
"SELECT dataset_id, seed, model, alpha, bin, worst_slab_coverage FROM s QUALIFY row_number() OVER (PARTITION BY dataset_id, seed, model, alpha ORDER BY seen NULLS LAST, bin) = 1"), "alpha worst_slab_coverage")
def r_worst_bin(spark, d):
    return regression.worst_bin(_scored(spark, d), KEYS, "x_qty")


@register()
def r_worst_slab(spark, d):
    slabs = regression.worst_slab(_scored(spark, d), KEYS, ["x_disc", "x_tax", "x_qty"], ["c_status"])
    return regression.total_deviation(_cells(spark, d).select(*KEYS, "alpha", "cov_abs_dev"), slabs, KEYS)


@register(S.query(S.REG, S.IV, S.IM, S.PA, f"""
a AS (SELECT dataset_id, seed, model, alpha, unnest({_IM_COLUMNS.split()}) AS metric, unnest([{", ".join(_IM_COLUMNS.split())}]) AS value FROM im)""",
"SELECT dataset_id, seed, model, alpha, metric, value FROM a UNION ALL SELECT dataset_id, seed, model, NULL, unnest(['r2', 'rmse', 'mae']), unnest([r2, rmse, mae]) FROM pa"), "alpha value")
def r_metrics_long(spark, d):
    made = regression.all_metrics(reg_panel(spark, d), KEYS, LEVELS)
    return made.where("metric <> 'crps_mean' and metric not like 'pit%'").select(*KEYS, "alpha", "metric", "value")


@register(S.query(S.REG, S.PA, "SELECT dataset_id, seed, model, r2, 'not_requested' AS distribution_status, CASE WHEN r2 IS NULL THEN 'undefined' ELSE 'ok' END AS metric_status FROM pa"), "r2")
def r_point_records(spark, d):
    return regression.point_records(reg_panel(spark, d).drop("ppd"), KEYS)


@register()
def r_all_metrics(spark, d):
    return regression.all_metrics(reg_panel(spark, d), KEYS, LEVELS, numeric=["x_disc", "x_tax", "x_qty"], categorical=["c_status"])


@register(S.query(S.REG, S.PPD, f"""
m AS (SELECT dataset_id, seed, model, row_pos, q, list_transform(q, lambda v: v) AS f FROM ppd)""",
f"SELECT dataset_id, seed, model, avg({_TRAPEZOID} + 0.05::DOUBLE * (f[1] + f[19])) AS mean_ppd FROM m GROUP BY ALL"), "mean_ppd")
def f_grid_mean(spark, d):
    return reg_panel(spark, d).groupBy(*KEYS).agg(F.avg(ppd.mean(F.col("ppd"), LEVELS)).alias("mean_ppd"))


# --------------------------------------------------------------------------- classification metrics
@register(S.query(S.CLF, S.binned("ci", "dataset_id, model", "confidence", "hit", "b"), "acc AS (SELECT dataset_id, model, avg(hit) AS accuracy FROM ci GROUP BY ALL)",
"SELECT dataset_id, model, accuracy, w.ece AS confidence_ece_ew, w.mce AS confidence_mce_ew, m.ece AS confidence_ece_em, m.mce AS confidence_mce_em FROM acc JOIN b_ew w USING (dataset_id, model) JOIN b_em m USING (dataset_id, model)"),
"accuracy confidence_ece_ew confidence_mce_ew confidence_ece_em confidence_mce_em")
def c_top_label(spark, d):
    return classification.top_label(_instances(spark, d), CKEYS)


_CLASSES = "pc AS (SELECT dataset_id, model, k - 1 AS k, p[k] AS p, CASE WHEN k - 1 = y_idx THEN 1 ELSE 0 END AS is_k FROM ci CROSS JOIN (SELECT unnest(range(1, 11)) AS k))"


@register(S.query(S.CLF, _CLASSES, S.binned("pc", "dataset_id, model, k", "p", "is_k", "b"),
"SELECT dataset_id, model, avg(w.ece) AS classwise_ece_ew, max(w.mce) AS classwise_mce_ew, avg(m.ece) AS classwise_ece_em, max(m.mce) AS classwise_mce_em FROM b_ew w JOIN b_em m USING (dataset_id, model, k) GROUP BY ALL"),
"classwise_ece_ew classwise_mce_ew classwise_ece_em classwise_mce_em")
def c_classwise(spark, d):
    return classification.classwise(_instances(spark, d), CKEYS)


@register(S.query(S.CLF, """
o AS (SELECT vec_id, dataset_id, model, y_idx, k - 1 AS k, p[k] AS p FROM ci CROSS JOIN (SELECT unnest(range(1, 11)) AS k)),
n AS (SELECT dataset_id, model, round(sum(p) OVER w, 10) AS mass, max(CASE WHEN k = y_idx THEN 1 ELSE 0 END) OVER w AS inside FROM o
      WINDOW w AS (PARTITION BY vec_id, model ORDER BY p DESC, k ROWS UNBOUNDED PRECEDING))""", S.binned("n", "dataset_id, model", "mass", "inside", "b"),
"SELECT dataset_id, model, w.ece AS cmce_ew, m.ece AS cmce_em FROM b_ew w JOIN b_em m USING (dataset_id, model)"), "cmce_ew cmce_em")
def c_cumulative_mass(spark, d):
    return classification.cumulative_mass(_instances(spark, d), CKEYS)


@register(S.query(S.CLF,
"SELECT dataset_id, model, avg(list_sum(list_transform(range(1, 11), lambda k: (p[k] - CASE WHEN k - 1 = y_idx THEN 1 ELSE 0 END) ** 2))) AS brier_score, avg(-ln(least(greatest(p_true, 1e-12), 1 - 1e-12))) AS log_loss FROM ci GROUP BY ALL"),
"brier_score log_loss")
def c_proper_scores(spark, d):
    return classification.proper_scores(_instances(spark, d), CKEYS)


@register(S.query(S.CLF, _CLASSES, """
r AS (SELECT *, rank() OVER (PARTITION BY dataset_id, model, k ORDER BY p) + (count(*) OVER (PARTITION BY dataset_id, model, k, p) - 1) / 2 AS r FROM pc),
u AS (SELECT dataset_id, model, k, (sum(CASE WHEN is_k = 1 THEN r END) - sum(is_k) * (sum(is_k) + 1) / 2) / nullif(sum(is_k) * (count(*) - sum(is_k)), 0) AS auc FROM r GROUP BY ALL)""",
"SELECT dataset_id, model, CASE WHEN count(auc) = count(*) THEN avg(auc) END AS roc_auc_ovr_macro FROM u GROUP BY ALL"), "roc_auc_ovr_macro")
def c_auc(spark, d):
    return classification.auc_macro(_instances(spark, d), CKEYS, 10)


@register(S.query(S.CLF, """
c AS (SELECT dataset_id, model, unnest(range(0, 10)) AS c FROM (SELECT DISTINCT dataset_id, model FROM ci)),
f AS (SELECT c.dataset_id, c.model, c.c, count(*) FILTER (y_idx = c.c) AS t, count(*) FILTER (pred = c.c) AS s, count(*) FILTER (pred = c.c AND y_idx = c.c) AS h FROM c JOIN ci USING (dataset_id, model) GROUP BY ALL)""",
"SELECT dataset_id, model, avg(2.0::DOUBLE * h / (t + s)) AS macro_f1 FROM f WHERE t + s > 0 GROUP BY ALL"), "macro_f1")
def c_macro_f1(spark, d):
    return classification.macro_f1(_instances(spark, d), CKEYS)


@register("SELECT * FROM " + " JOIN ".join(f"({QUERIES[n].sql})" + (f" q{k} USING (dataset_id, model)" if k else " q0") for k, n in enumerate(("c_top_label", "c_classwise", "c_cumulative_mass", "c_proper_scores", "c_auc", "c_macro_f1"))))
def c_metrics_wide(spark, d):
    return classification.all_metrics(clf_panel(spark, d), CKEYS, 10)


@register()
def c_all_metrics(spark, d):
    return classification.all_metrics(clf_panel(spark, d), CKEYS, 10)


@register("""
WITH b AS (SELECT lang, quality AS y, n_chars / (n_chars + 1000.0::DOUBLE) AS s FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2 AS r FROM b)
SELECT lang, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM r GROUP BY lang""", "auc")
def c_binary_auc(spark, d):
    return classification.auc(bin_panel(spark, d), ["lang"], "score", "y")


@register("""
WITH x AS (SELECT vec_id % 5 AS dataset_id, CASE WHEN vec_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, label FROM embeddings),
f AS (SELECT dataset_id, split, unnest(range(0, 10))::INT AS y_idx FROM (SELECT DISTINCT dataset_id, split FROM x))
SELECT dataset_id, split, y_idx, count(label) AS n FROM f LEFT JOIN x ON x.dataset_id = f.dataset_id AND x.split = f.split AND x.label = f.y_idx GROUP BY ALL""".replace("SELECT dataset_id, split, y_idx, count", "SELECT f.dataset_id, f.split, f.y_idx, count"))
def a_class_counts(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 5).alias("dataset_id"), F.when(F.col("vec_id") % 2 == 0, "train").otherwise("test").alias("split"), F.col("label").alias("y_idx"))
    return classification.class_counts(rows, ["dataset_id"], "split", 10)


# --------------------------------------------------------------------------- tables
_TRIALS = """
trials AS (SELECT 'regression' AS task, dataset_id, model, seed, 8 AS ensemble,
  CASE WHEN alpha IS NULL THEN 'alpha_free' ELSE 'alpha_dependent.' || CAST(alpha AS VARCHAR) END || '.per_dataset.' || metric AS metric, value FROM long)"""
_L = (S.REG, S.IV, S.IM, S.PA, S.LONG)


@register(S.query(*_L, _TRIALS, "SELECT task, dataset_id, model, ensemble, metric, avg(value) AS mean_across_five_splits, count(value) AS n_seeds FROM trials GROUP BY ALL"), "mean_across_five_splits")
def a_trial_means(spark, d):
    return tables.aggregate_trials(tables.trials(_long(spark, d), "regression"))


@register(S.query(S.REG, S.FEAT, S.FLONG, "SELECT 'regression' AS task, dataset_id, feature, avg(value) AS mean_across_five_splits, count(value) AS n_seeds FROM flong GROUP BY ALL"), "mean_across_five_splits")
def a_feature_means(spark, d):
    return tables.feature_means(_features_long(spark, d), "regression")


@register(S.query(*_L, S.WIDE, "SELECT dataset_id, model, seed, mae, r2, rmse, alpha, avg_width_norm, cov_abs_dev, interval_score, 1 - alpha AS nominal_coverage FROM wide"), "mae r2 rmse alpha avg_width_norm cov_abs_dev interval_score nominal_coverage")
def t_metrics_table(spark, d):
    return tables.metrics_table(_long(spark, d), ["mae", "r2", "rmse"], ["avg_width_norm", "cov_abs_dev", "interval_score"])


def _eval(spark, d):
    return tables.eval_table(_wide(spark, d), feature_panel(spark, d))


@register(S.query(*_L, S.WIDE, S.FEAT, "SELECT dataset_id, seed, model, alpha, mae, f_disc_mean, f_y_sd, feat.dataset_id IS NULL AS features_missing, n_context / n_features AS context_to_feature_ratio FROM wide LEFT JOIN feat USING (dataset_id, seed)"), "alpha mae f_disc_mean f_y_sd context_to_feature_ratio")
def t_eval_table(spark, d):
    return _eval(spark, d).select(*KEYS, "alpha", "mae", "f_disc_mean", "f_y_sd", "features_missing", "context_to_feature_ratio")


@register(S.query(*_L, S.WIDE, S.FEAT, "SELECT dataset_id, model, alpha, avg(mae) AS mae, avg(interval_score) AS interval_score, avg(f_y_sd) AS f_y_sd, arg_min(n_context, seed) AS n_context FROM wide JOIN feat USING (dataset_id, seed) GROUP BY ALL"), "alpha mae interval_score f_y_sd")
def t_average_table(spark, d):
    return tables.average_table(_eval(spark, d), ["mae", "interval_score", "f_y_sd"], ["dataset_id", "model", "alpha"], first=["n_context"])


@register(S.query(*_L, S.WIDE, "SELECT dataset_id, seed, model, alpha, mae FROM wide WHERE alpha = 0.1::DOUBLE"), "alpha mae")
def p_slice_alpha(spark, d):
    return tables.slice_alpha(_wide(spark, d), None, once_at=0.1).select(*KEYS, "alpha", "mae")


_AR = "rank() OVER (PARTITION BY {p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {p}, {x}) - 1) / 2"


@register(S.query(*_L, "g AS (SELECT dataset_id, model, metric, avg(value) AS value FROM long WHERE alpha IS NULL GROUP BY ALL), h AS (SELECT *, CASE WHEN metric = 'r2' THEN -value ELSE value END AS s FROM g)",
f"SELECT dataset_id, model, metric, value, {_AR.format(p='dataset_id, metric', x='s')} AS rank FROM h"), "value rank")
def w_ranks(spark, d):
    means = _long(spark, d).where("alpha is null").groupBy("dataset_id", "model", "metric").agg(F.avg("value").alias("value"))
    return tables.ranks(means, ["dataset_id"])


_ENS = "ens AS (SELECT 'mae' AS metric, dataset_id, model, e AS ensemble, avg(mae) * (1 + 0.1::DOUBLE / e * (dataset_id % 3)) AS value FROM pa CROSS JOIN (SELECT unnest([1, 4, 8]) AS e) GROUP BY dataset_id, model, e)"


def _ensembles(spark, d):
    means = _points(spark, d).groupBy("dataset_id", "model").agg(F.avg("mae").alias("mae"))
    return means.select(F.lit("mae").alias("metric"), "dataset_id", "model", F.explode(F.array(*(F.lit(e) for e in (1, 4, 8)))).alias("ensemble"), "mae").withColumn("value", F.col("mae") * (1 + F.lit(0.1) / F.col("ensemble") * (F.col("dataset_id") % 3))).drop("mae")


@register(S.query(S.REG, S.PA, _ENS, f"r AS (SELECT *, {_AR.format(p='metric, dataset_id', x='value')} AS r, count(*) OVER (PARTITION BY metric, dataset_id) AS n FROM ens), m AS (SELECT metric, model, ensemble, avg(r) AS r, max(n) AS n FROM r GROUP BY ALL)",
"SELECT metric, ensemble, avg((r - 1) / (n - 1)) AS normalised_rank FROM m GROUP BY ALL"), "normalised_rank")
def w_joint_ranks(spark, d):
    return tables.joint_ranks(_ensembles(spark, d), ["dataset_id"])


_Z = "({m} - avg({m}) OVER k) / nullif(stddev_pop({m}) OVER k, 0)"


@register(S.query(*_L, S.WIDE, f"SELECT dataset_id, seed, model, alpha, {_Z.format(m='mae')} * -1 AS mae, {_Z.format(m='r2')} AS r2, {_Z.format(m='cov_abs_dev')} * -1 AS cov_abs_dev FROM wide WINDOW k AS (PARTITION BY dataset_id, seed, alpha)"), "alpha mae r2 cov_abs_dev")
def w_peer_z(spark, d):
    rows = _wide(spark, d).select(*KEYS, "alpha", "mae", "r2", "cov_abs_dev", "cov_dev_signed")
    return tables.peer_z(rows, ["mae", "r2", "cov_abs_dev", "cov_dev_signed"], ["dataset_id", "seed", "alpha"])


@register(S.query(*_L, S.WIDE, "a AS (SELECT dataset_id, model, alpha, avg(cov_dev_signed) AS cov_dev_signed FROM wide GROUP BY ALL)", f"SELECT dataset_id, model, alpha, {_Z.format(m='cov_dev_signed')} AS cov_dev_signed FROM a WINDOW k AS (PARTITION BY dataset_id, alpha)"), "alpha cov_dev_signed")
def w_peer_bias(spark, d):
    means = tables.average_table(_wide(spark, d), ["cov_dev_signed"], ["dataset_id", "model", "alpha"])
    return tables.peer_z(means, ["cov_dev_signed"], ["dataset_id", "alpha"], bias=True)


_PD = S.query(*_L, S.WIDE, "SELECT dataset_id, seed, alpha, 'A_vs_N' AS model, b.r2 - a.r2 AS r2, -(b.mae - a.mae) / nullif(a.mae, 0) AS mae, -(b.interval_score - a.interval_score) / nullif(a.interval_score, 0) AS interval_score FROM (SELECT * FROM wide WHERE model = 'A') a JOIN (SELECT * FROM wide WHERE model = 'N') b USING (dataset_id, seed, alpha)")


def _delta(spark, d):
    return tables.pair_delta(_wide(spark, d), "A", "N", ["r2", "mae", "interval_score", "cov_abs_dev"], ["dataset_id", "seed", "alpha"])


@register(_PD, "alpha r2 mae interval_score")
def t_pair_delta(spark, d):
    return _delta(spark, d)


@register(f"SELECT dataset_id, seed, alpha, model, CASE WHEN mae > 0 THEN 1 ELSE 0 END AS mae FROM ({_PD})", "alpha")
def p_binary_delta(spark, d):
    return tables.binary_delta(_delta(spark, d).select("dataset_id", "seed", "alpha", "model", "mae"), ["mae"])


@register(f"WITH p AS ({_PD}), e AS (SELECT alpha, quantile_cont(mae, 0.05) AS lo, quantile_cont(mae, 0.95) AS hi FROM p GROUP BY alpha) SELECT alpha, dataset_id, seed, least(greatest(mae, lo), hi) AS mae, least(greatest(mae, lo), hi) <> mae AS clipped FROM p JOIN e USING (alpha)", "alpha mae")
def p_winsorised(spark, d):
    return tables.winsorise(_delta(spark, d).select("alpha", "dataset_id", "seed", "mae"), "mae", ["alpha"])


@register(S.query(S.REG, "SELECT 'regression' AS task, dataset_id, seed, count(*) AS n_train, stddev_pop(y) AS training_response_std FROM reg_panel WHERE row_pos < floor(n_test / 2) GROUP BY ALL"), "training_response_std")
def a_training_scale(spark, d):
    return tables.training_scale(reg_panel(spark, d).where(~regression.in_second_half()), "regression")


@register(S.query(*_L, _TRIALS, "s AS (SELECT dataset_id, seed, stddev_pop(y) AS sd FROM reg_panel GROUP BY ALL), one AS (SELECT * FROM trials WHERE metric = 'alpha_free.per_dataset.mae')",
"SELECT * FROM one UNION ALL SELECT task, dataset_id, model, seed, ensemble, 'alpha_free.per_dataset.mae_norm', value / greatest(sd, 1e-10) FROM one JOIN s USING (dataset_id, seed)"), "value")
def a_normalised_metric(spark, d):
    trial = tables.trials(_long(spark, d), "regression").where("metric = 'alpha_free.per_dataset.mae'")
    renamed = trial.withColumn("metric", F.lit("alpha_free.per_dataset.crps_mean"))
    out = tables.normalised_crps(renamed, tables.training_scale(reg_panel(spark, d), "regression"))
    return out.withColumn("metric", F.when(F.col("metric").endswith("normalized_crps"), "alpha_free.per_dataset.mae_norm").otherwise("alpha_free.per_dataset.mae"))


@register(S.query(S.REG, S.IV, "o AS (SELECT dataset_id, seed, model, row_pos, covered FROM iv WHERE alpha = 0.1::DOUBLE)", "SELECT dataset_id, seed, model, sum(1 - covered)::BIGINT AS n_missed, count(*) AS n_rows FROM o GROUP BY ALL"))
def t_instance_table(spark, d):
    rows = _scored(spark, d).where(F.col("alpha") == 0.1)
    joined = tables.instance_table(reg_panel(spark, d).select(*KEYS, "row_pos", "x_qty"), rows.select(*KEYS, "row_pos", "covered"), KEYS)
    return joined.groupBy(*KEYS).agg(F.sum("miscovered").alias("n_missed"), F.count(F.lit(1)).alias("n_rows"))


_KNOWN = ", ".join(f"('{m}')" for m in "r2 rmse mae crps_mean pit_ece pit_hist_l1 pit_ks_stat cov_dev_signed wsc_dev_signed cov_abs_dev wsc_abs_dev total_abs_dev avg_length avg_width_norm interval_score pinball_lower pinball_mean pinball_upper accuracy macro_f1 roc_auc_ovr_macro brier_score log_loss confidence_ece_em confidence_ece_ew confidence_mce_em confidence_mce_ew classwise_ece_em classwise_ece_ew classwise_mce_em classwise_mce_ew cmce_em cmce_ew".split())


@register(f"""
WITH m(metric) AS (VALUES {_KNOWN}),
k AS (SELECT *, metric LIKE '%_dev%' OR metric LIKE 'avg_%' AS trade_off, metric LIKE '%dev_signed' AS signed, metric LIKE '%abs_dev' OR metric = 'avg_width_norm' AS axis,
  metric IN ('r2', 'accuracy', 'macro_f1', 'roc_auc_ovr_macro') AS higher FROM m)
SELECT metric, (CASE WHEN trade_off THEN 0 WHEN higher THEN 1 ELSE -1 END)::INT AS direction,
  CASE WHEN higher OR metric IN ('rmse', 'mae') THEN 'prediction' WHEN metric IN ('crps_mean', 'interval_score', 'brier_score', 'log_loss') OR metric LIKE 'pinball%' THEN 'proper_score' ELSE 'calibration' END AS category,
  CASE WHEN metric IN ('rmse', 'mae', 'crps_mean', 'interval_score', 'avg_length', 'brier_score', 'log_loss') OR metric LIKE 'pinball%' THEN 'scale_dependent' ELSE 'scale_free' END AS scale,
  trade_off, axis, signed, higher OR metric = 'brier_score' AS absolute_delta FROM k""")
def d_registry(spark, d):
    return registry(spark)


# --------------------------------------------------------------------------- comparisons
@register(S.query(*_L, S.WIDE, "SELECT model, alpha, round(avg(mae), 4) AS mae_mean, round(median(mae), 4) AS mae_median, round(stddev_samp(mae), 4) AS mae_std, round(avg(interval_score), 4) AS interval_score_mean, round(median(interval_score), 4) AS interval_score_median, round(stddev_samp(interval_score), 4) AS interval_score_std FROM wide GROUP BY ALL"), "alpha mae_mean mae_median mae_std interval_score_mean interval_score_median interval_score_std")
def a_model_comparison(spark, d):
    return compare.model_comparison(_wide(spark, d), ["mae", "interval_score"])


@register(S.query(*_L, S.WIDE, "m AS (SELECT model, alpha, dataset_id, avg(cov_dev_signed) AS dev FROM wide GROUP BY ALL)", "SELECT model, alpha, avg(CASE WHEN dev > 0 THEN 1 ELSE 0 END) AS frac_over, avg(CASE WHEN dev < 0 THEN 1 ELSE 0 END) AS frac_under, avg(dev) AS mean_signed_dev FROM m GROUP BY ALL"), "alpha frac_over frac_under mean_signed_dev")
def a_coverage_bias(spark, d):
    return compare.coverage_bias(_wide(spark, d))


@register(S.query(*_L, "SELECT alpha, model, avg(avg_width_norm) AS avg_width_norm_mean, median(avg_width_norm) AS avg_width_norm_median, avg(interval_score) AS interval_score_mean, median(interval_score) AS interval_score_median FROM im GROUP BY ALL"), "alpha avg_width_norm_mean avg_width_norm_median interval_score_mean interval_score_median")
def a_interval_efficiency(spark, d):
    return compare.interval_efficiency(_cells(spark, d))


_DM = "dm AS (SELECT dataset_id, model, avg(interval_score) AS value FROM im WHERE alpha = 0.1::DOUBLE GROUP BY ALL)"


@register(S.query(*_L, _DM, "SELECT * FROM dm ORDER BY value DESC, dataset_id, model LIMIT 10"), "value")
def o_worst_datasets(spark, d):
    return compare.worst_datasets(_cells(spark, d), "interval_score", 0.1)


@register(S.query(*_L, _DM, "p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY value, dataset_id) AS b, row_number() OVER (PARTITION BY model ORDER BY value DESC, dataset_id) AS w FROM dm)",
"SELECT model, 'best' AS kind, b::INT AS place, dataset_id, value FROM p WHERE b <= 5 UNION ALL SELECT model, 'worst', w::INT, dataset_id, value FROM p WHERE w <= 5"), "value")
def o_model_extremes(spark, d):
    return compare.model_extremes(_cells(spark, d), "interval_score", 0.1)


@register(S.query(*_L, _DM, "SELECT model, count(*) AS wins FROM (SELECT * FROM dm QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY value, model) = 1) GROUP BY model"))
def t_model_wins(spark, d):
    return compare.wins(_cells(spark, d), "interval_score", 0.1)


_PAIRS = "pr AS (SELECT a.dataset_id, a.model AS model_a, b.model AS model_b, a.value AS va, b.value AS vb FROM dm a JOIN dm b ON a.dataset_id = b.dataset_id AND a.model < b.model)"


@register(S.query(*_L, _DM, _PAIRS, f"g AS (SELECT *, va - vb AS gap, abs(va - vb) AS size FROM pr), r AS (SELECT *, {_AR.format(p='model_a, model_b', x='size')} AS r FROM g WHERE gap <> 0)",
"SELECT model_a, model_b, count(*) AS n, coalesce(sum(CASE WHEN gap > 0 THEN r END), 0) AS w_plus, least(coalesce(sum(CASE WHEN gap > 0 THEN r END), 0), coalesce(sum(CASE WHEN gap < 0 THEN r END), 0)) AS statistic FROM r GROUP BY ALL"), "w_plus statistic")
def q_wilcoxon(spark, d):
    return compare.pairwise_wilcoxon(_cells(spark, d), "interval_score", 0.1).drop("p")


@register()
def q_wilcoxon_p(spark, d):
    return compare.pairwise_wilcoxon(_cells(spark, d), "interval_score", 0.1)


@register(S.query(*_L, _DM, _PAIRS, f"r AS (SELECT *, {_AR.format(p='model_a, model_b', x='va')} AS ra, {_AR.format(p='model_a, model_b', x='vb')} AS rb FROM pr)", "SELECT model_a, model_b, count(*) AS n, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS rho FROM r GROUP BY ALL HAVING count(*) >= 5"), "rho")
def q_ranking_agreement(spark, d):
    return compare.ranking_agreement(_cells(spark, d), "interval_score", 0.1)


# --------------------------------------------------------------------------- decomposition
_MP = "mp AS (SELECT dataset_id, model, avg(mae) AS value FROM pa GROUP BY ALL)"
_CENTRED = "(SELECT *, avg(value) OVER ({g}) AS g, avg(value) OVER ({d}) AS a, avg(value) OVER ({m}) AS b FROM {t})"


def _share(t: str, g: str, dd: str, m: str, by: str = "") -> str:
    return f"SELECT {by} sum((a - g) ** 2) / sum((value - g) ** 2) AS dataset_share, sum((b - g) ** 2) / sum((value - g) ** 2) AS model_share, sum((value - a - b + g) ** 2) / sum((value - g) ** 2) AS interaction_share FROM {_CENTRED.format(g=g, d=dd, m=m, t=t)} {'GROUP BY ALL' if by else ''}"


@register(S.query(S.REG, S.PA, _MP, _share("mp", "", "PARTITION BY dataset_id", "PARTITION BY model")), "dataset_share model_share interaction_share")
def t_variance_shares(spark, d):
    means = _mae_panel(spark, d).groupBy("dataset_id", "model").agg(F.avg("value").alias("value"))
    return decompose.shares(decompose.complete(means))


@register(S.query(S.REG, S.PA, "sp AS (SELECT dataset_id, seed, model, mae AS value FROM pa)", _share("sp", "PARTITION BY seed", "PARTITION BY seed, dataset_id", "PARTITION BY seed, model", "seed,")), "dataset_share model_share interaction_share")
def t_split_shares(spark, d):
    return decompose.shares(decompose.complete(_mae_panel(spark, d), ["seed"]), ["seed"])


@register(S.query(S.REG, S.PA, f"c AS (SELECT seed, dataset_id, model, value - a - b + g AS i FROM {_CENTRED.format(g='PARTITION BY seed', d='PARTITION BY seed, dataset_id', m='PARTITION BY seed, model', t='(SELECT dataset_id, seed, model, mae AS value FROM pa)')})",
"SELECT x.seed AS seed_a, y.seed AS seed_b, covar_pop(x.i, y.i) / nullif(stddev_pop(x.i) * stddev_pop(y.i), 0) AS r, count(DISTINCT x.dataset_id) AS n_datasets FROM c x JOIN c y ON x.dataset_id = y.dataset_id AND x.model = y.model AND x.seed < y.seed GROUP BY ALL"), "r")
def t_split_stability(spark, d):
    return decompose.split_stability(_mae_panel(spark, d))


@register(S.query(S.REG, S.PA, _MP, "g AS (SELECT a.model AS model_a, b.model AS model_b, a.value - b.value AS gap FROM mp a JOIN mp b ON a.dataset_id = b.dataset_id AND a.model < b.model), s AS (SELECT model_a, model_b, avg(gap) AS mean_gap, stddev_samp(gap) AS sd_gap, count(*) AS n, avg(CASE WHEN gap > 0 THEN 1 ELSE 0 END) AS frac_positive, avg(CASE WHEN gap < 0 THEN 1 ELSE 0 END) AS frac_negative, avg(CASE WHEN gap = 0 THEN 1 ELSE 0 END) AS frac_tie FROM g GROUP BY ALL)",
"SELECT *, CASE WHEN mean_gap > 0 THEN frac_positive WHEN mean_gap < 0 THEN frac_negative ELSE frac_tie END AS direction_agreement FROM s"), "mean_gap sd_gap frac_positive frac_negative frac_tie direction_agreement")
def a_model_gaps(spark, d):
    return decompose.gaps(_mae_panel(spark, d))


@register(S.query(*_L, "SELECT metric, model, median(value) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM (SELECT dataset_id, model, metric, avg(value) AS value FROM long WHERE alpha IS NULL GROUP BY ALL) GROUP BY ALL"), "median q1 q3")
def a_profiles(spark, d):
    return decompose.profiles(_long(spark, d).where("alpha is null").groupBy("dataset_id", "model", "metric").agg(F.avg("value").alias("value")))


# --------------------------------------------------------------------------- statistics
_XY = "xy AS (SELECT model, seed, feature, dataset_id, flong.value AS x, mae AS y FROM pa JOIN flong USING (dataset_id, seed))"
_SP = f"sr AS (SELECT *, {_AR.format(p='model, seed, feature', x='x')} AS rx, {_AR.format(p='model, seed, feature', x='y')} AS ry FROM xy), sp AS (SELECT model, seed, feature, count(*) AS n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS r FROM sr GROUP BY ALL)"
_SKEYS = ["model", "seed", "feature"]


def _xy(spark, d):
    return _points(spark, d).join(_features_long(spark, d), ["dataset_id", "seed"]).select(*_SKEYS, "dataset_id", F.col("value").alias("x"), F.col("mae").alias("y"))


@register(S.query(S.REG, S.PA, S.FEAT, S.FLONG, _XY, _SP, "SELECT model, seed, feature, n, r FROM sp"), "r")
def q_spearman(spark, d):
    return statistics.spearman(_xy(spark, d), _SKEYS, p_value=False)


@register()
def q_spearman_p(spark, d):
    return statistics.spearman(_xy(spark, d), _SKEYS)


_XI = """
xi AS (
  SELECT dataset_id, seed, model, row_pos AS row_id, x_qty AS x, abs(y - point_pred) AS y FROM reg_panel),
u AS (SELECT *, count(*) OVER (PARTITION BY dataset_id, seed, model ORDER BY y RANGE UNBOUNDED PRECEDING) AS up, count(*) OVER (PARTITION BY dataset_id, seed, model ORDER BY y DESC RANGE UNBOUNDED PRECEDING) AS down FROM xi),
s AS (SELECT *, abs(up - lag(up) OVER (PARTITION BY dataset_id, seed, model ORDER BY x, row_id)) AS step FROM u)"""


@register(S.query(S.REG, _XI, "SELECT dataset_id, seed, model, count(*) AS n, CASE WHEN count(*) >= 10 AND stddev_pop(x) >= 1e-12 AND stddev_pop(y) >= 1e-12 THEN 1 - count(*) * sum(step) / nullif(2 * sum(down * (c - down)), 0) END AS xi FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id, seed, model) AS c FROM s) GROUP BY ALL"), "xi")
def q_chatterjee(spark, d):
    rows = reg_panel(spark, d).select(*KEYS, F.col("row_pos").alias("row_id"), F.col("x_qty").alias("x"), F.abs(F.col("y") - F.col("point_pred")).alias("y"))
    return statistics.chatterjee(rows, KEYS)


_RB = "rb AS (SELECT dataset_id, model, count(*) AS k, avg(mae) AS est, avg(v) AS w, coalesce(var_samp(mae), 0) AS b FROM (SELECT dataset_id, seed, model, avg(abs(y - point_pred)) AS mae, var_samp(abs(y - point_pred)) / count(*) AS v FROM reg_panel GROUP BY ALL) GROUP BY ALL), t AS (SELECT *, w + (1 + 1 / k) * b AS tot, (1 + 1 / k) * b / (w + (1 + 1 / k) * b) AS sh FROM rb)"


def _seed_estimates(spark, d):
    e = F.abs(F.col("y") - F.col("point_pred"))
    return reg_panel(spark, d).groupBy(*KEYS).agg(F.avg(e).alias("mae"), (F.var_samp(e) / F.count(F.lit(1))).alias("v"))


@register(S.query(S.REG, _RB, "SELECT dataset_id, model, est, sqrt(tot) AS se, est / sqrt(tot) AS t, CASE WHEN sh > 0 AND k > 1 THEN (k - 1) / sh ** 2 ELSE 1e9 END AS df, k AS n_seeds, w AS within_var, b AS between_var FROM t"), "est se t df within_var between_var")
def q_rubin(spark, d):
    return statistics.rubin(_seed_estimates(spark, d), ["dataset_id", "model"], "mae", "v", p_value=False)


@register()
def q_rubin_p(spark, d):
    return statistics.rubin(_seed_estimates(spark, d), ["dataset_id", "model"], "mae", "v")


_FZ = "fz AS (SELECT model, feature, atanh(least(greatest(r, -1 + 1e-12), 1 - 1e-12)) AS z, 1 / (n - 3) AS v FROM sp WHERE n >= 4 AND r IS NOT NULL), fk AS (SELECT model, feature, count(*) AS k, avg(z) AS est, avg(v) AS w, coalesce(var_samp(z), 0) AS b FROM fz GROUP BY ALL), ft AS (SELECT *, (1 + 1 / k) * b / (w + (1 + 1 / k) * b) AS sh FROM fk)"


@register(S.query(S.REG, S.PA, S.FEAT, S.FLONG, _XY, _SP, _FZ, "SELECT model, feature, tanh(est) AS r, CASE WHEN sh > 0 AND k > 1 THEN (k - 1) / sh ** 2 ELSE 1e9 END AS df, k AS n_seeds, w AS within_var, b AS between_var FROM ft"), "r df within_var between_var")
def q_fisher_z(spark, d):
    return statistics.fisher_z(statistics.spearman(_xy(spark, d), _SKEYS, p_value=False), ["model", "feature"], p_value=False)


@register(S.query(S.REG, S.PA, "SELECT dataset_id, model, avg(mae) AS mean, stddev_samp(mae) / sqrt(count(mae)) AS se, count(mae) AS n_seeds FROM pa GROUP BY ALL"), "mean se")
def q_mean_sd(spark, d):
    return statistics.mean_sd(_points(spark, d), ["dataset_id", "model"], "mae", interval=False)


_P = "pv AS (SELECT dataset_id, seed, model, r2, ((dataset_id * 7 + seed * 3 + ascii(model)) % 97 + 1) / 100.0::DOUBLE AS p FROM pa)"


def _p_values(spark, d):
    return _points(spark, d).select(*KEYS, ((F.col("dataset_id") * 7 + F.col("seed") * 3 + F.ascii("model")) % 97 + 1).alias("h")).select(*KEYS, (F.col("h") / 100.0).alias("p"))


@register(S.query(S.REG, S.PA, _P, "SELECT dataset_id, 0.5 - atan(avg(tan((0.5 - least(greatest(p, 1e-15), 1 - 1e-15)) * pi()))) / pi() AS p_acat, count(p) AS n_p FROM pv GROUP BY dataset_id"), "p_acat")
def q_acat(spark, d):
    return statistics.acat(_p_values(spark, d), ["dataset_id"])


@register(S.query(S.REG, S.PA, _P, "b AS (SELECT *, p * count(*) OVER (PARTITION BY model) / row_number() OVER (PARTITION BY model ORDER BY p) AS s FROM pv)", "SELECT dataset_id, seed, model, p, least(1.0::DOUBLE, min(s) OVER (PARTITION BY model ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM b"), "p q")
def q_benjamini_hochberg(spark, d):
    return statistics.benjamini_hochberg(_p_values(spark, d), ["model"])


def _outcomes(spark, d):
    """More datasets than the panel has: one a (dataset, seed) cell."""
    return _long(spark, d).where("alpha is null").select("metric", "model", (F.col("dataset_id") * 5 + F.col("seed")).alias("dataset_id"), "value")


def _cell_features(spark, d):
    return _features_long(spark, d).select((F.col("dataset_id") * 5 + F.col("seed")).alias("dataset_id"), "feature", "value")


@register()
def q_pooled_spearman(spark, d):
    return statistics.pooled_spearman(_outcomes(spark, d), _cell_features(spark, d), "regression")


@register(S.query(*_L, S.FEAT, S.FLONG, f"""
po AS (SELECT metric, dataset_id * 5 + seed AS dataset_id, median(value) AS y FROM long WHERE alpha IS NULL GROUP BY ALL),
pxy AS (SELECT metric, feature, y, value AS x FROM po JOIN (SELECT dataset_id * 5 + seed AS dataset_id, feature, value FROM flong) USING (dataset_id)),
pr AS (SELECT *, {_AR.format(p='metric, feature', x='x')} AS rx, {_AR.format(p='metric, feature', x='y')} AS ry FROM pxy),
pc AS (SELECT metric, feature, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 9) AS r FROM pr GROUP BY ALL),
pk AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(r) DESC, feature) AS place FROM pc WHERE r IS NOT NULL)""",
"SELECT feature, min(place)::INT AS best_place, count(*) AS n_metrics FROM pk WHERE place <= 5 GROUP BY feature"))
def o_strongest_features(spark, d):
    pooled = statistics.pooled_spearman(_outcomes(spark, d), _cell_features(spark, d), "regression", p_value=False).where("tier = 'pooled'")
    return statistics.strongest(pooled.withColumn("r", F.round("r", 9)))


# --------------------------------------------------------------------------- conformal
def _roles(spark, d):
    return conformal.quarter_roles(reg_panel(spark, d), KEYS)


_ROLES = """
cf AS (SELECT *, CASE WHEN row_pos < n_test / 4 THEN 'train' WHEN row_pos < n_test / 2 THEN 'cal' ELSE 'test' END AS role,
  point_pred AS mu, point_pred * (1 + (0.05::DOUBLE - 0.5) * spread) AS lo, point_pred * (1 + (0.95::DOUBLE - 0.5) * spread) AS hi,
  point_pred * spread AS width1 FROM reg_panel)"""


def _scp(score: str, low: str, high: str, roles: str = "('train', 'cal')") -> str:
    return S.query(S.REG, _ROLES, f"""
sc AS (SELECT *, {score} AS score FROM cf),
th AS (SELECT dataset_id, seed, model, coalesce(max(CASE WHEN place = k THEN score END), 'infinity'::DOUBLE) AS t FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, seed, model ORDER BY score) AS place, ceil((count(*) OVER (PARTITION BY dataset_id, seed, model) + 1) * 0.9::DOUBLE - 1e-9) AS k FROM sc WHERE role IN {roles}) GROUP BY ALL),
te AS (SELECT sc.*, {low} AS l, {high} AS u FROM sc JOIN th USING (dataset_id, seed, model) WHERE role = 'test')""",
"SELECT dataset_id, seed, model, avg(CASE WHEN y >= l AND y <= u THEN 1 ELSE 0 END) AS coverage, count(*) FILTER (l > u) AS n_empty, count(*) FILTER (isinf(l)) AS n_infinite, count(*) AS n FROM te GROUP BY ALL")


def _summary(bounds: DataFrame) -> DataFrame:
    return conformal.interval_summary(regression.score_intervals(bounds), KEYS).select(*KEYS, "coverage", "n_empty", "n_infinite", "n")


# The grid's mean of symmetric quantiles is the point prediction itself, and its variance a multiple of the squared width.
_VAR = sum(w * (q - 0.5) ** 2 for w, q in zip([0.075, *[0.05] * 17, 0.075], LEVELS, strict=True))


@register(_scp("abs(y - mu)", "mu - greatest(t, 0)", "mu + greatest(t, 0)"), "coverage")
def n_split_absolute(spark, d):
    return _summary(conformal.split_conformal(_roles(spark, d), KEYS, LEVELS, [0.1], "absolute"))


_SD = f"greatest(sqrt({_VAR!r}::DOUBLE) * width1, 1e-8)"


@register(_scp(f"abs(y - mu) / {_SD}", f"mu - greatest(t, 0) * {_SD} - 1e-9", f"mu + greatest(t, 0) * {_SD} + 1e-9"), "coverage")
def n_split_normalised(spark, d):
    # Scores repeat exactly in this panel, so bounds are widened by what rounding may move them.
    made = conformal.split_conformal(_roles(spark, d), KEYS, LEVELS, [0.1], "normalised")
    return _summary(made.withColumns({"lower": F.col("lower") - 1e-9, "upper": F.col("upper") + 1e-9}))


@register(_scp("greatest(lo - y, y - hi, 0)", "lo - greatest(t, 0)", "hi + greatest(t, 0)"), "coverage")
def n_split_cqr(spark, d):
    return _summary(conformal.split_conformal(_roles(spark, d), KEYS, LEVELS, [0.1], "cqr"))


@register(_scp("greatest(lo - y, y - hi)", "lo - t", "hi + t", "('cal')"), "coverage")
def n_split_cqr_standard(spark, d):
    return _summary(conformal.split_conformal(_roles(spark, d), KEYS, LEVELS, [0.1], "cqr_standard", pooled=False))


_U = "greatest(least(0.5 + (y / point_pred - 1) / spread, 0.95::DOUBLE), 0.05::DOUBLE)"


@register(_scp(f"greatest({_U}, 1 - {_U})", "point_pred * (1 + (greatest(1 - t, 0.05::DOUBLE) - 0.5) * spread) - 1e-9", "point_pred * (1 + (least(t, 0.95::DOUBLE) - 0.5) * spread) + 1e-9"), "coverage")
def n_split_pit(spark, d):
    # As with the normalised score, bounds are widened by what rounding may move them.
    made = conformal.split_conformal(_roles(spark, d), KEYS, LEVELS, [0.1], "pit")
    return _summary(made.withColumns({"lower": F.col("lower") - 1e-9, "upper": F.col("upper") + 1e-9}))


@register(S.query(S.REG, _ROLES, "SELECT dataset_id, seed, model, avg(CASE WHEN y >= lo AND y <= hi THEN 1 ELSE 0 END) AS coverage, count(*) FILTER (lo > hi) AS n_empty, 0::BIGINT AS n_infinite, count(*) AS n FROM cf WHERE role = 'test' GROUP BY ALL"), "coverage")
def n_vanilla(spark, d):
    return _summary(conformal.vanilla(_roles(spark, d), LEVELS, [0.1]))


@register(S.query(S.REG, _ROLES, """
sc AS (SELECT *, abs(y - mu) AS score FROM cf),
ed AS (SELECT dataset_id, seed, model, [quantile_cont(x_qty, 0.25), quantile_cont(x_qty, 0.5), quantile_cont(x_qty, 0.75)] AS edges, quantile_cont(score, 0.9) AS tau0 FROM sc WHERE role = 'train' GROUP BY ALL),
bn AS (SELECT sc.*, tau0, len(list_filter(edges, lambda e: e < x_qty)) AS bin FROM sc JOIN ed USING (dataset_id, seed, model)),
ta AS (SELECT dataset_id, seed, model, bin, quantile_cont(score, 0.9) AS tau1 FROM bn WHERE role = 'train' GROUP BY ALL),
fu AS (SELECT bn.*, greatest(coalesce(tau1, tau0), 1e-8) AS tau FROM bn LEFT JOIN ta USING (dataset_id, seed, model, bin)),
th AS (SELECT dataset_id, seed, model, coalesce(max(CASE WHEN place = k THEN fixed END), 'infinity'::DOUBLE) AS t FROM (
  SELECT *, score - tau AS fixed, row_number() OVER (PARTITION BY dataset_id, seed, model ORDER BY score - tau) AS place, ceil((count(*) OVER (PARTITION BY dataset_id, seed, model) + 1) * 0.9::DOUBLE - 1e-9) AS k FROM fu WHERE role = 'cal') GROUP BY ALL),
te AS (SELECT fu.*, mu - greatest(tau + t, 0) AS l, mu + greatest(tau + t, 0) AS u FROM fu JOIN th USING (dataset_id, seed, model) WHERE role = 'test')""",
"SELECT dataset_id, seed, model, avg(CASE WHEN y >= l AND y <= u THEN 1 ELSE 0 END) AS coverage, count(*) FILTER (l > u) AS n_empty, count(*) FILTER (isinf(l)) AS n_infinite, count(*) AS n FROM te GROUP BY ALL"), "coverage")
def n_rectified(spark, d):
    return _summary(conformal.rectified(_roles(spark, d), KEYS, LEVELS, 0.1, "x_qty"))


def _local(method: str):
    def run(spark, d):
        return _summary(conformal_local.local_conformal(_roles(spark, d), KEYS, LEVELS, 0.1, ["x_disc", "x_tax", "x_qty"], method))

    run.__name__ = f"n_{method.lower()}"
    register()(run)


for _m in conformal_local.METHODS:
    _local(_m)


def _method_metrics(spark, d):
    """Coverage and width of two methods and the baseline in long form."""
    rows = _roles(spark, d)
    parts = []
    for name, made in (("Vanilla", conformal.vanilla(rows, LEVELS, [0.1])), ("SCP-ABS", conformal.split_conformal(rows, KEYS, LEVELS, [0.1])), ("SCP-CQR", conformal.split_conformal(rows, KEYS, LEVELS, [0.1], "cqr"))):
        own = conformal.interval_summary(regression.score_intervals(made), [*KEYS, "alpha"])
        parts.append(own.select("dataset_id", "seed", F.col("model").alias("base_model"), "alpha", F.lit(name).alias("method"), "coverage", "avg_width"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.unpivot(["dataset_id", "seed", "base_model", "alpha", "method"], ["coverage", "avg_width"], "metric", "value")


def _mm_sql() -> str:
    one = lambda name, score, low, high: f"""
SELECT dataset_id, seed, model AS base_model, 0.1::DOUBLE AS alpha, '{name}' AS method, avg(CASE WHEN y >= l AND y <= u THEN 1 ELSE 0 END) AS coverage, avg(u - l) AS avg_width FROM (
  SELECT cf.*, {low} AS l, {high} AS u FROM cf JOIN (
    SELECT dataset_id, seed, model, coalesce(max(CASE WHEN place = k THEN score END), 'infinity'::DOUBLE) AS t FROM (
      SELECT *, {score} AS score, row_number() OVER (PARTITION BY dataset_id, seed, model ORDER BY {score}) AS place, ceil((count(*) OVER (PARTITION BY dataset_id, seed, model) + 1) * 0.9::DOUBLE - 1e-9) AS k FROM cf WHERE role IN ('train', 'cal')) GROUP BY ALL) USING (dataset_id, seed, model) WHERE role = 'test') GROUP BY ALL"""  # noqa: E731
    return f"mw AS ({one('Vanilla', 'abs(y - mu)', 'lo', 'hi')} UNION ALL {one('SCP-ABS', 'abs(y - mu)', 'mu - greatest(t, 0)', 'mu + greatest(t, 0)')} UNION ALL {one('SCP-CQR', 'greatest(lo - y, y - hi, 0)', 'lo - greatest(t, 0)', 'hi + greatest(t, 0)')}), mm AS (SELECT dataset_id, seed, base_model, alpha, method, unnest(['coverage', 'avg_width']) AS metric, unnest([coverage, avg_width]) AS value FROM mw)"


_DELTAS = "dl AS (SELECT m.*, m.value - b.value AS delta, (m.value - b.value) / nullif(abs(b.value), 0) AS rel FROM mm m JOIN (SELECT * FROM mm WHERE method = 'Vanilla') b USING (dataset_id, seed, base_model, alpha, metric) WHERE m.method <> 'Vanilla'), ds AS (SELECT method, base_model, alpha, metric, dataset_id, CASE WHEN count(delta) = count(*) THEN avg(delta) END AS delta, CASE WHEN count(rel) = count(*) THEN avg(rel) END AS rel FROM dl GROUP BY ALL)"


@register(S.query(S.REG, _ROLES, _mm_sql(), _DELTAS, "SELECT method, base_model, alpha, metric, CASE WHEN count(delta) = count(*) THEN avg(delta) END AS mean_delta, median(rel) AS median_relative_delta, avg(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS frac_negative, count(*) AS n_datasets FROM ds GROUP BY ALL"), "alpha mean_delta median_relative_delta frac_negative")
def a_conformal_summary(spark, d):
    return conformal.summarise(conformal.paired_deltas(_method_metrics(spark, d)))


@register(S.query(S.REG, _ROLES, _mm_sql(), "wd AS (SELECT method, base_model, alpha, dataset_id, CASE WHEN count(value) = count(*) THEN avg(value) END AS v FROM mm WHERE metric = 'avg_width' GROUP BY ALL), ch AS (SELECT w.method, w.base_model, w.alpha, 100 * (w.v - b.v) / nullif(b.v, 0) AS c FROM wd w JOIN (SELECT * FROM wd WHERE method = 'Vanilla') b USING (base_model, alpha, dataset_id) WHERE w.method <> 'Vanilla')",
"SELECT method, base_model, alpha, median(CASE WHEN NOT isinf(c) THEN c END) AS median_width_change, count(CASE WHEN NOT isinf(c) THEN c END) AS n_datasets FROM ch GROUP BY ALL"), "alpha median_width_change")
def t_relative_width(spark, d):
    return conformal.relative_width(_method_metrics(spark, d))


@register(S.query(S.REG, _ROLES, "SELECT dataset_id, seed, model, CASE WHEN role = 'train' THEN 'cal' ELSE role END AS role, count(*) AS n_rows, sum(h::HUGEINT)::VARCHAR || '-' || bit_xor(h)::VARCHAR AS fingerprint FROM (SELECT *, CAST('0x' || substr(md5(CAST(row_pos AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM cf) GROUP BY ALL"))
def n_data_usage(spark, d):
    return conformal.data_usage(_roles(spark, d), KEYS, True)


@register(S.query(S.REG, "h AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, seed, model ORDER BY md5('20260929:' || dataset_id || ':' || seed || ':' || model || ':' || row_pos), row_pos) - 1 AS k, count(*) OVER (PARTITION BY dataset_id, seed, model) // 4 AS q FROM reg_panel), r AS (SELECT *, CASE WHEN k < q THEN 'train' WHEN k < 2 * q THEN 'cal' ELSE 'test' END AS role FROM h WHERE q >= 10)",
"SELECT dataset_id, seed, model, role, count(*) AS n, sum(row_pos)::BIGINT AS rows, min(row_pos) AS first FROM r GROUP BY ALL"))
def n_hashed_roles(spark, d):
    made = conformal.hashed_roles(reg_panel(spark, d), KEYS, "row_pos")
    return made.groupBy(*KEYS, "role").agg(F.count(F.lit(1)).alias("n"), F.sum("row_pos").alias("rows"), F.min("row_pos").alias("first"))


# --------------------------------------------------------------------------- dataset features
@register(S.query(S.REG, """
m AS (SELECT dataset_id, avg(y) AS mu, stddev_pop(y) AS sd, min(y) AS lo, max(y) AS hi, count(*) AS n FROM reg_panel GROUP BY ALL),
z AS (SELECT r.dataset_id, (y - mu) / sd AS z, least(floor((y - lo) * 10 / nullif(hi - lo, 0)), 9) AS bin, n, mu, sd FROM reg_panel r JOIN m USING (dataset_id)),
e AS (SELECT dataset_id, -sum(p * ln(p)) AS h FROM (SELECT dataset_id, bin, count(*) / max(n) AS p FROM z GROUP BY ALL) GROUP BY ALL),
a AS (SELECT dataset_id, avg(z ** 3) AS s, avg(z ** 4) - 3 AS k, avg(CASE WHEN abs(z) > 2 THEN 1 ELSE 0 END) AS o2, avg(CASE WHEN abs(z) > 3 THEN 1 ELSE 0 END) AS o3, max(sd) / nullif(abs(max(mu)), 0) AS cv FROM z GROUP BY ALL)""",
"SELECT dataset_id, s AS y_skew, k AS y_kurtosis, cv AS y_cv, (s * s + 1) / (k + 3) AS y_bimodality, o2 AS outlier_frac_2sigma, o3 AS outlier_frac_3sigma, h AS y_entropy FROM a JOIN e USING (dataset_id)"), "y_skew y_kurtosis y_cv y_bimodality outlier_frac_2sigma outlier_frac_3sigma y_entropy")
def x_target_distribution(spark, d):
    return dataset_features.target_distribution(reg_panel(spark, d), ["dataset_id"]).drop("y_ks_normal")


@register()
def x_target_normality(spark, d):
    return dataset_features.target_distribution(reg_panel(spark, d), ["dataset_id"]).select("dataset_id", "y_ks_normal")


_COLS = ["x_disc", "x_tax", "x_qty"]
_LN = "ln_ AS (SELECT dataset_id, y, unnest(['x_disc', 'x_tax', 'x_qty']) AS feature, unnest([x_disc, x_tax, x_qty]) AS v FROM reg_panel)"


@register(S.query(S.REG, _LN, """
b AS (SELECT dataset_id, feature, avg(v) AS mu, stddev_pop(v) AS sd, median(v) AS med, count(*) AS n FROM ln_ GROUP BY ALL),
md AS (SELECT dataset_id, feature, max(c) AS mode FROM (SELECT dataset_id, feature, v, count(*) AS c FROM ln_ GROUP BY ALL) GROUP BY ALL),
s AS (SELECT l.dataset_id, l.feature, avg(((v - mu) / sd) ** 3) AS sk, avg(((v - mu) / sd) ** 4) - 3 AS ku, median(abs(v - med)) AS mad, avg(CASE WHEN abs(v - mu) > 3 * sd THEN 1 ELSE 0 END) AS o FROM ln_ l JOIN b USING (dataset_id, feature) GROUP BY ALL)""",
"SELECT dataset_id, avg(abs(sk)) AS mean_abs_skew, max(abs(sk)) AS max_abs_skew, avg(ku) AS mean_kurtosis, avg(o) AS mean_outlier_frac, avg((sk * sk + 1) / (ku + 3)) AS mean_bimodality, avg(mode / n) AS mean_mode_share, avg(mad / nullif(sd, 0)) AS mean_mad_over_sd, stddev_pop(log10(sd)) AS scale_dispersion, count(*) AS n_numeric FROM b JOIN md USING (dataset_id, feature) JOIN s USING (dataset_id, feature) GROUP BY ALL"),
"mean_abs_skew max_abs_skew mean_kurtosis mean_outlier_frac mean_bimodality mean_mode_share mean_mad_over_sd scale_dispersion")
def x_feature_moments(spark, d):
    return dataset_features.feature_moments(reg_panel(spark, d), ["dataset_id"], _COLS)


@register("""
WITH l AS (SELECT c_nationkey AS dataset_id, unnest(['c_mktsegment', 'c_name']) AS feature, unnest([c_mktsegment, c_name]) AS v FROM customer),
c AS (SELECT *, sum(c) OVER (PARTITION BY dataset_id, feature) AS n FROM (SELECT dataset_id, feature, v, count(*) AS c FROM l GROUP BY ALL)),
e AS (SELECT dataset_id, feature, count(*) AS card, max(n) AS n, -sum(c / n * ln(c / n)) AS h, max(c / n) AS mode, sum(CASE WHEN c / n < 0.01 THEN c / n ELSE 0 END) AS rare FROM c GROUP BY ALL)
SELECT dataset_id, avg(card) AS cardinality_mean, max(card) AS cardinality_max, var_pop(card) AS cardinality_var, avg(CASE WHEN card >= 0.9 * n AND n >= 20 THEN 1 ELSE 0 END) AS id_like_frac, avg(CASE WHEN card > 1 THEN h / ln(card) ELSE 0 END) AS entropy_mean, avg(mode) AS mode_frac_mean, avg(rare) AS rare_mass_mean, count(*) AS n_categorical FROM e GROUP BY ALL""",
"cardinality_mean cardinality_var id_like_frac entropy_mean mode_frac_mean rare_mass_mean")
def x_categorical_features(spark, d):
    rows = table(spark, d, "customer").withColumnRenamed("c_nationkey", "dataset_id")
    return dataset_features.categorical_features(rows, ["dataset_id"], ["c_mktsegment", "c_name"])


@register("""
WITH c AS (SELECT vec_id % 5 AS dataset_id, label, count(*) AS c FROM embeddings GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY dataset_id) AS p FROM c)
SELECT dataset_id, count(*) AS n_classes, -sum(p * ln(p)) AS class_entropy, max(p) AS majority_frac, min(p) AS minority_frac, max(c) / min(c) AS imbalance_ratio, 1 - sum(p * p) AS gini_impurity, stddev_pop(p) AS class_share_sd, -sum(p * ln(p)) / ln(count(*)) AS class_entropy_norm FROM p GROUP BY ALL""",
"class_entropy majority_frac minority_frac imbalance_ratio gini_impurity class_share_sd class_entropy_norm")
def x_class_distribution(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 5).alias("dataset_id"), F.col("label").alias("y_idx"))
    return dataset_features.class_distribution(rows, ["dataset_id"])


@register(S.query(S.REG, _LN, f"r AS (SELECT *, {_AR.format(p='dataset_id, feature', x='v')} AS rx, {_AR.format(p='dataset_id, feature', x='y')} AS ry FROM ln_), e AS (SELECT dataset_id, feature, abs(covar_pop(v, y) / nullif(stddev_pop(v) * stddev_pop(y), 0)) AS p, abs(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0)) AS s, stddev_pop(v) AS sd FROM r GROUP BY ALL)",
"SELECT dataset_id, max(p) AS max_abs_pearson, avg(p) AS mean_abs_pearson, max(s) AS max_abs_spearman, avg(s - p) AS nonlinearity_gap, avg(CASE WHEN sd < 1e-8 THEN 1 ELSE 0 END) AS near_constant_frac FROM e GROUP BY ALL"), "max_abs_pearson mean_abs_pearson max_abs_spearman nonlinearity_gap near_constant_frac")
def x_signal_quality(spark, d):
    return dataset_features.signal_quality(reg_panel(spark, d), ["dataset_id"], _COLS)


@register("""
WITH l AS (SELECT c_nationkey AS dataset_id, c_mktsegment AS v, CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS y FROM customer), j AS (SELECT dataset_id, v, y, count(*) AS c FROM l GROUP BY ALL),
m AS (SELECT *, sum(c) OVER (PARTITION BY dataset_id) AS n, sum(c) OVER (PARTITION BY dataset_id, v) AS cx, sum(c) OVER (PARTITION BY dataset_id, y) AS cy FROM j)
SELECT dataset_id, 'c_mktsegment' AS feature, greatest(sum(c / n * ln(c * n / (cx * cy))), 0) AS mi FROM m GROUP BY ALL""", "mi")
def x_mutual_information(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("dataset_id"), "c_mktsegment", (F.col("c_acctbal") > 0).cast("int").alias("y"))
    return dataset_features.plug_in_mi(rows, ["dataset_id"], ["c_mktsegment"], "y")


_EMB = "em AS (SELECT vec_id, vec_id % 5 AS dataset_id, label, CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2, CAST(embedding[3] AS DOUBLE) AS e3 FROM embeddings), el AS (SELECT dataset_id, label, unnest(['e1', 'e2', 'e3']) AS feature, unnest([e1, e2, e3]) AS v FROM em)"


def _emb(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_pos"), (F.col("vec_id") % 5).alias("dataset_id"), F.col("label").alias("y_idx"), *(F.col("embedding")[k].cast("double").alias(f"e{k + 1}") for k in range(3)))


_ECOLS = ["e1", "e2", "e3"]


@register(S.query(_EMB, "g AS (SELECT dataset_id, feature, label, count(*) AS c, avg(v) AS m, var_pop(v) * count(*) AS w FROM el GROUP BY ALL), h AS (SELECT *, sum(c * m) OVER (PARTITION BY dataset_id, feature) / sum(c) OVER (PARTITION BY dataset_id, feature) AS gm FROM g), e AS (SELECT dataset_id, feature, sum(c * (m - gm) ** 2) AS b, sum(w) AS w, sum(c) AS n, count(*) AS k FROM h GROUP BY ALL)",
"SELECT dataset_id, max(b * (n - k) / (w * (k - 1))) AS anova_f_max, avg(b * (n - k) / (w * (k - 1))) AS anova_f_mean, max(b / (b + w)) AS eta2_max, avg(b / (b + w)) AS eta2_mean FROM e GROUP BY ALL"), "anova_f_max anova_f_mean eta2_max eta2_mean")
def x_class_signal(spark, d):
    return dataset_features.class_signal(_emb(spark, d), ["dataset_id"], _ECOLS)


@register(S.query(S.REG, "u AS (SELECT dataset_id, count(*) AS n, [count(DISTINCT x_disc), count(DISTINCT x_tax), count(DISTINCT x_qty)] AS u FROM reg_panel GROUP BY ALL)",
"SELECT dataset_id, n, 4 AS d, 4.0::DOUBLE / n AS d_over_n, len(list_filter(u, lambda x: x <= 10)) / 3.0::DOUBLE AS discrete_frac, len(list_filter(u, lambda x: x = 2)) / 3.0::DOUBLE AS binary_frac, 0.0::DOUBLE AS missing_frac, 0.0::DOUBLE AS missing_row_frac FROM u"), "d_over_n discrete_frac binary_frac missing_frac missing_row_frac")
def x_dimensionality(spark, d):
    return dataset_features.dimensionality(reg_panel(spark, d), ["dataset_id"], _COLS, ["c_status"])


@register(S.query(S.REG, "c AS (SELECT dataset_id, [abs(covar_pop(x_disc, x_tax) / nullif(stddev_pop(x_disc) * stddev_pop(x_tax), 0)), abs(covar_pop(x_disc, x_qty) / nullif(stddev_pop(x_disc) * stddev_pop(x_qty), 0)), abs(covar_pop(x_tax, x_qty) / nullif(stddev_pop(x_tax) * stddev_pop(x_qty), 0))] AS r FROM reg_panel GROUP BY ALL)", "SELECT dataset_id, list_avg(r) AS mean_abs_corr, list_max(r) AS max_abs_corr FROM c"), "mean_abs_corr max_abs_corr")
def x_correlation_structure(spark, d):
    return dataset_features.correlation_structure(reg_panel(spark, d), ["dataset_id"], _COLS)


@register(S.query(S.REG, "e AS (SELECT dataset_id, [quantile_cont(x_qty, 0.2), quantile_cont(x_qty, 0.4), quantile_cont(x_qty, 0.6), quantile_cont(x_qty, 0.8)] AS edges FROM reg_panel GROUP BY ALL), b AS (SELECT dataset_id, len(list_filter(edges, lambda e: e < x_qty)) AS bin, stddev_pop(y) AS sd, count(*) AS n FROM reg_panel JOIN e USING (dataset_id) GROUP BY ALL)", "SELECT dataset_id, max(sd) / nullif(min(sd), 0) AS within_bin_sd_ratio, count(*) AS n_bins FROM b WHERE n > 1 GROUP BY ALL"), "within_bin_sd_ratio")
def x_spread_ratio(spark, d):
    return dataset_features.spread_ratio(reg_panel(spark, d), ["dataset_id"], "x_qty")


@register(S.query(_EMB, """
q AS (SELECT dataset_id, feature, label, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM el GROUP BY ALL),
p AS (SELECT a.dataset_id, a.feature, a.label AS a, b.label AS b, greatest(a.lo, b.lo) AS l, least(a.hi, b.hi) AS h, greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0) / nullif(greatest(a.hi, b.hi) - least(a.lo, b.lo), 0) AS ov FROM q a JOIN q b ON a.dataset_id = b.dataset_id AND a.feature = b.feature AND a.label < b.label),
o AS (SELECT p.dataset_id, p.feature, a, b, avg(CASE WHEN v < l OR v > h THEN 1 ELSE 0 END) AS outside FROM p JOIN el e ON e.dataset_id = p.dataset_id AND e.feature = p.feature AND (e.label = a OR e.label = b) GROUP BY ALL),
x AS (SELECT dataset_id, a, b, exp(sum(ln(greatest(ov, 1e-12)))) AS f2, max(outside) AS f3 FROM p JOIN o USING (dataset_id, feature, a, b) GROUP BY ALL)""", "SELECT dataset_id, avg(f2) AS f2_mean, avg(f3) AS f3_mean FROM x GROUP BY ALL"), "f2_mean f3_mean")
def x_class_overlap(spark, d):
    return dataset_features.class_overlap(_emb(spark, d), ["dataset_id"], _ECOLS)


@register(S.query(_EMB, """
s AS (SELECT dataset_id, label, (e1 - avg(e1) OVER k) / stddev_pop(e1) OVER k AS e1, (e2 - avg(e2) OVER k) / stddev_pop(e2) OVER k AS e2, (e3 - avg(e3) OVER k) / stddev_pop(e3) OVER k AS e3 FROM em WINDOW k AS (PARTITION BY dataset_id)),
c AS (SELECT dataset_id, label, count(*) AS m, avg(e1) AS c1, avg(e2) AS c2, avg(e3) AS c3 FROM s GROUP BY ALL),
w AS (SELECT dataset_id, label, sum((e1 - c1) ** 2 + (e2 - c2) ** 2 + (e3 - c3) ** 2) AS w, avg(sqrt((e1 - c1) ** 2 + (e2 - c2) ** 2 + (e3 - c3) ** 2)) AS s FROM s JOIN c USING (dataset_id, label) GROUP BY ALL),
j AS (SELECT * FROM c JOIN w USING (dataset_id, label)),
h AS (SELECT dataset_id, sum(m * (c1 ** 2 + c2 ** 2 + c3 ** 2)) AS b, sum(w) AS w, sum(m) AS n, count(*) AS k FROM j GROUP BY ALL),
d AS (SELECT a.dataset_id, a.label, max((a.s + b.s) / nullif(sqrt((a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2 + (a.c3 - b.c3) ** 2), 0)) AS r FROM j a JOIN j b ON a.dataset_id = b.dataset_id AND a.label <> b.label GROUP BY ALL)""",
"SELECT dataset_id, b * (n - k) / (w * (k - 1)) AS calinski_harabasz, w / (b + w) AS centroid_ratio, davies_bouldin FROM h JOIN (SELECT dataset_id, avg(r) AS davies_bouldin FROM d GROUP BY ALL) USING (dataset_id)"), "calinski_harabasz centroid_ratio davies_bouldin")
def x_cluster_structure(spark, d):
    return dataset_features.cluster_structure(_emb(spark, d), ["dataset_id"], _ECOLS)


@register()
def x_matrix_features(spark, d):
    return dataset_features.matrix_features(reg_panel(spark, d), ["dataset_id", "seed"], _COLS)


@register(S.query(_EMB, """
z AS (SELECT dataset_id, vec_id, label, (e1 - avg(e1) OVER k) / stddev_pop(e1) OVER k AS a, (e2 - avg(e2) OVER k) / stddev_pop(e2) OVER k AS b, (e3 - avg(e3) OVER k) / stddev_pop(e3) OVER k AS c FROM em WINDOW k AS (PARTITION BY dataset_id)),
d AS (SELECT x.dataset_id, x.vec_id, x.label, y.label AS l2, y.vec_id AS v2, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2) AS d FROM z x JOIN z y ON x.dataset_id = y.dataset_id AND x.vec_id <> y.vec_id),
n AS (SELECT dataset_id, vec_id, avg(CASE WHEN label <> l2 THEN 1 ELSE 0 END) AS u, max(CASE WHEN label <> l2 THEN 1 ELSE 0 END) AS b FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, v2) <= 5) GROUP BY ALL),
m AS (SELECT dataset_id, vec_id, label, l2, avg(d) AS m, min(d) AS lo FROM d GROUP BY ALL),
s AS (SELECT dataset_id, vec_id, max(CASE WHEN label = l2 THEN m END) AS i, min(CASE WHEN label <> l2 THEN m END) AS o, min(CASE WHEN label = l2 THEN lo END) AS w, min(CASE WHEN label <> l2 THEN lo END) AS e FROM m GROUP BY ALL)""",
"SELECT dataset_id, avg(u) AS knn_disagreement, avg(b) AS boundary_frac, sum(w) FILTER (e IS NOT NULL) / sum(e) FILTER (w IS NOT NULL) AS n2, avg(coalesce((o - i) / greatest(o, i), 0)) AS silhouette FROM n JOIN s USING (dataset_id, vec_id) GROUP BY ALL"),
"knn_disagreement boundary_frac n2 silhouette")
def x_class_neighbours(spark, d):
    return dataset_features.class_neighbours(_emb(spark, d), ["dataset_id"], _ECOLS)


# --------------------------------------------------------------------------- instance features
@register(S.query(S.REG, "SELECT dataset_id, seed, model, avg(point_pred) AS median, avg(point_pred * spread * 0.5::DOUBLE) AS iqr, avg(0 * spread) AS bowley, avg(point_pred * spread * 0.9::DOUBLE) AS width FROM reg_panel GROUP BY ALL"), "median iqr bowley width")
def i_ppd_statistics(spark, d):
    rows = instance_features.ppd_statistics(reg_panel(spark, d), LEVELS)
    return rows.groupBy(*KEYS).agg(F.avg("ppd_median").alias("median"), F.avg("ppd_iqr").alias("iqr"), F.avg("ppd_bowley").alias("bowley"), F.avg("interval_width").alias("width"))


@register(S.query(S.REG, "c AS (SELECT dataset_id, seed, model, count(*) AS ctx_n, avg(y) AS mu, stddev_pop(y) AS sd FROM reg_panel WHERE row_pos < floor(n_test / 2) GROUP BY ALL)", "SELECT r.dataset_id, r.seed, r.model, max(ctx_n) AS ctx_n, max(ln(1 + ctx_n)) AS ctx_log_n, avg((point_pred - mu) / nullif(sd, 0)) AS pred_standardised FROM reg_panel r JOIN c USING (dataset_id, seed, model) WHERE row_pos >= floor(n_test / 2) GROUP BY ALL"), "ctx_log_n pred_standardised")
def i_context_statistics(spark, d):
    rows = reg_panel(spark, d)
    out = instance_features.context_statistics(rows.where(regression.in_second_half()), rows.where(~regression.in_second_half()), KEYS)
    return out.groupBy(*KEYS).agg(F.max("ctx_n").alias("ctx_n"), F.max("ctx_log_n").alias("ctx_log_n"), F.avg("pred_standardised").alias("pred_standardised"))


@register(S.query(S.REG, "SELECT dataset_id, seed, model, sum(CASE WHEN x_disc = 0 THEN 1 ELSE 0 END)::BIGINT AS n_missing, avg((CASE WHEN x_disc = 0 THEN 1 ELSE 0 END) / 4) AS missing_frac FROM reg_panel GROUP BY ALL"), "missing_frac")
def i_input_quality(spark, d):
    rows = reg_panel(spark, d).withColumn("x_disc", F.when(F.col("x_disc") != 0, F.col("x_disc")))
    return instance_features.input_quality(rows, [*_COLS, "c_status"]).groupBy(*KEYS).agg(F.sum("n_missing").alias("n_missing"), F.avg("missing_frac").alias("missing_frac"))


@register(S.query(_EMB, "SELECT a.dataset_id, a.vec_id AS q_pos, row_number() OVER (PARTITION BY a.dataset_id, a.vec_id ORDER BY (a.e1 - b.e1) ** 2 + (a.e2 - b.e2) ** 2 + (a.e3 - b.e3) ** 2, b.vec_id)::INT AS place, b.vec_id AS c_pos, sqrt((a.e1 - b.e1) ** 2 + (a.e2 - b.e2) ** 2 + (a.e3 - b.e3) ** 2) AS distance FROM em a JOIN em b ON a.dataset_id = b.dataset_id WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY place <= 5"), "distance")
def j_neighbours(spark, d):
    rows = _emb(spark, d)
    return instance_features.neighbour_join(rows.where("row_pos % 100 = 0"), rows, ["dataset_id"], _ECOLS, 5, own=True)


@register()
def i_distance_features(spark, d):
    rows = reg_panel(spark, d)
    return instance_features.distance_features(rows.where(regression.in_second_half()), rows.where(~regression.in_second_half()), KEYS, _COLS)


# --------------------------------------------------------------------------- preparation, validation, selection
@register("SELECT c_nationkey, c_mktsegment, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment)::INT - 1 AS y_idx, c_custkey FROM customer QUALIFY max(c_mktsegment) OVER (PARTITION BY c_nationkey) <> min(c_mktsegment) OVER (PARTITION BY c_nationkey)")
def p_label_codes(spark, d):
    return preprocessing.label_codes(table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey"], "c_mktsegment")


@register("WITH c AS (SELECT c_custkey, c_mktsegment, c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING' AS in_context FROM customer), v AS (SELECT DISTINCT c_mktsegment FROM c WHERE in_context), k AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment)::INT - 1 AS code FROM v) SELECT c_custkey, coalesce(code, -1)::INT AS c_mktsegment FROM c LEFT JOIN k USING (c_mktsegment)")
def f_ordinal_encode(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment").withColumn("in_context", (F.col("c_custkey") % 2 == 0) & (F.col("c_mktsegment") != "BUILDING"))
    return preprocessing.ordinal(rows, ["c_mktsegment"]).drop("in_context")


@register(S.query(S.REG, "x AS (SELECT dataset_id, seed, model, row_pos, CASE WHEN x_disc <> 0 THEN x_disc END AS v FROM reg_panel), m AS (SELECT dataset_id, median(v) AS m FROM x WHERE row_pos % 2 = 0 GROUP BY ALL)", "SELECT dataset_id, seed, model, row_pos, coalesce(v, m, 0) AS x_disc FROM x LEFT JOIN m USING (dataset_id)"), "x_disc")
def f_impute_median(spark, d):
    rows = reg_panel(spark, d).select(*KEYS, "row_pos", F.when(F.col("x_disc") != 0, F.col("x_disc")).alias("x_disc"), (F.col("row_pos") % 2 == 0).alias("in_context"))
    return preprocessing.impute_median(rows, ["dataset_id"], ["x_disc"]).drop("in_context")


@register("SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value)::INT - 1 AS code FROM (SELECT DISTINCT unnest(['c_mktsegment']) AS feature, unnest([c_mktsegment]) AS value FROM customer)")
def f_vocabulary(spark, d):
    return preprocessing.vocabulary(table(spark, d, "customer").select("c_mktsegment"), ["c_mktsegment"])


@register("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def v_duplicates(spark, d):
    return validation.duplicates(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@register("SELECT s.c_mktsegment, p.o_orderpriority FROM (SELECT DISTINCT c_mktsegment FROM customer) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM orders o JOIN customer c ON o_custkey = c_custkey WHERE c.c_mktsegment = s.c_mktsegment AND o.o_orderpriority = p.o_orderpriority AND o.o_totalprice > 450000)")
def j_missing_configurations(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    present = o.where("o_totalprice > 450000").join(c, o["o_custkey"] == c["c_custkey"]).select("c_mktsegment", "o_orderpriority")
    return validation.missing_configurations(present, [c.select("c_mktsegment").distinct(), o.select("o_orderpriority").distinct()])


@register(S.query(*_L, "SELECT dataset_id, model, metric, count(value) AS n_finite FROM long WHERE alpha IS NULL GROUP BY ALL HAVING count(value) <> 5"))
def v_incomplete(spark, d):
    return validation.incomplete(_long(spark, d).where("alpha is null"), ["dataset_id", "model", "metric"], 5)


@register(S.query(S.REG, S.IV, S.IM, "SELECT dataset_id, seed, model, alpha FROM im WHERE abs(interval_score * alpha / 4 - pinball_mean) > 1e-9 * greatest(1, abs(pinball_mean))"), "alpha")
def v_score_identity(spark, d):
    return validation.broken_identity(_cells(spark, d), F.col("interval_score") * F.col("alpha") / 4.0, F.col("pinball_mean")).select(*KEYS, "alpha")


_IMP = "ip AS (SELECT model, feature, 'mae' AS response, avg(r) AS importance FROM sp GROUP BY ALL)"


def _importance(spark, d):
    r = statistics.spearman(_xy(spark, d), _SKEYS, p_value=False)
    return r.groupBy("model", "feature").agg(F.round(F.avg("r"), 9).alias("importance")).withColumn("response", F.lit("mae"))


_SELECT = S.query(S.REG, S.PA, S.FEAT, S.FLONG, _XY, _SP, _IMP, "SELECT model, response, feature, round(importance, 9) AS importance, row_number() OVER (PARTITION BY model, response ORDER BY abs(round(importance, 9)) DESC, feature)::INT AS place FROM ip WHERE importance IS NOT NULL QUALIFY place <= 3")


@register(_SELECT, "importance")
def q_select_topk(spark, d):
    return selection.select(_importance(spark, d), ["model", "response"], k=3)


@register(f"SELECT response, feature, count(DISTINCT model) AS n_models, min(place) AS best_place FROM ({_SELECT}) GROUP BY ALL")
def u_feature_union(spark, d):
    return selection.union_over(selection.select(_importance(spark, d), ["model", "response"], k=3), ["response"])


@register(f"WITH s AS ({_SELECT}) SELECT response, feature FROM s GROUP BY ALL HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM s)")
def u_feature_intersection(spark, d):
    return selection.common_to(selection.select(_importance(spark, d), ["model", "response"], k=3), ["response"], over="model")


# --------------------------------------------------------------------------- sampling, draws, models
@register(S.query(S.REG, "h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY dataset_id, seed, model ORDER BY md5('1:' || row_pos), row_pos) <= n_test // 2 THEN 'train' ELSE 'test' END AS split FROM reg_panel)",
"SELECT dataset_id, seed, model, split, count(*) AS n, sum(row_pos)::BIGINT AS rows FROM h GROUP BY ALL"))
def l_halves(spark, d):
    return sampling.halves(reg_panel(spark, d), KEYS, "row_pos").groupBy(*KEYS, "split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_pos").alias("rows"))


@register("""
WITH c AS (SELECT label, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS want FROM embeddings GROUP BY label),
q AS (SELECT *, floor(want) + CASE WHEN row_number() OVER (ORDER BY want - floor(want) DESC, CAST(label AS VARCHAR)) <= 100 - sum(floor(want)) OVER () THEN 1 ELSE 0 END AS quota FROM c)
SELECT vec_id, label FROM embeddings JOIN q USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) <= quota""")
def l_stratified(spark, d):
    return sampling.stratified(table(spark, d, "embeddings").select("vec_id", "label"), "label", 100, "vec_id")


@register("SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) - 1) % 5)::INT AS fold FROM embeddings")
def l_folds(spark, d):
    return sampling.folds(table(spark, d, "embeddings").select("vec_id", "label"), [], "vec_id", y="label")


@register("SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('0:' || (l_orderkey * 8 + l_linenumber)), l_orderkey * 8 + l_linenumber) <= 1000")
def l_capped(spark, d):
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber").withColumn("row_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return sampling.capped(lines, ["l_returnflag"], "row_id").drop("row_id")


@register()
def t_rank_bootstrap(spark, d):
    means = _long(spark, d).where("alpha is null").groupBy("dataset_id", "model", "metric").agg(F.avg("value").alias("value"))
    return bootstrap.mean_rank_intervals(tables.ranks(means, ["dataset_id"]))


@register()
def t_contrast_bootstrap(spark, d):
    deltas = conformal.paired_deltas(_method_metrics(spark, d)).groupBy("method", "base_model", "metric", "dataset_id").agg(F.avg("delta").alias("delta"))
    return bootstrap.contrast_intervals(deltas, ["method", "base_model", "metric"])


@register()
def t_transitions(spark, d):
    return bootstrap.transition_summary(bootstrap.transitions(_ensembles(spark, d)))


def _lme_table(spark, d):
    return _points(spark, d).join(feature_panel(spark, d), ["dataset_id", "seed"]).withColumn("dataset_id", F.col("dataset_id") * 5 + F.col("seed"))


@register()
def q_mixed_model(spark, d):
    # The three models of a dataset and seed are its repeats.
    rows = _lme_table(spark, d).withColumn("response", F.lit("mae"))
    return mixed.mixed_model(rows, ["response"], "mae", ["f_disc_mean", "f_y_sd"])


@register()
def q_cross_model(spark, d):
    return mixed.cross_model(_lme_table(spark, d).withColumn("response", F.lit("mae")), ["response"], "mae", "f_y_sd")


@register()
def q_tree_importance(spark, d):
    return learners.tree_importance(_lme_table(spark, d), ["model"], "mae", ["f_disc_mean", "f_y_sd", "f_qty_mean"])


@register()
def q_univariate_forest(spark, d):
    return learners.univariate_forest(_lme_table(spark, d), ["model"], "mae", ["f_disc_mean", "f_y_sd"])


def _component_rows(spark, d):
    rows = _lme_table(spark, d).select("dataset_id", "model", F.col("mae").alias("value"))
    features = feature_panel(spark, d).withColumn("dataset_id", F.col("dataset_id") * 5 + F.col("seed"))
    return learners.component_prediction(rows, features, ["f_disc_mean", "f_y_sd", "f_qty_mean"])


@register()
def q_component_losses(spark, d):
    return _component_rows(spark, d)


@register()
def q_components(spark, d):
    return learners.component_summary(learners.component_gains(_component_rows(spark, d)))


@register()
def l_tree_predictor(spark, d):
    rows = reg_panel(spark, d).drop("ppd", "point_pred")
    made = learners.PREDICTORS["trees"](LEVELS, keys=KEYS).fit_predict(rows.where("row_pos % 2 = 0"), rows.where("row_pos % 2 = 1"), _COLS, "y")
    return regression.crps_metric(regression.distribution_rows(made, LEVELS), KEYS)


def _instance_outcomes(spark, d):
    return _scored(spark, d).where("alpha = 0.1").withColumn("width_norm", F.col("width") / F.col("spread"))


@register()
def q_instance_coverage(spark, d):
    return instance_predict.predictability(_instance_outcomes(spark, d), ["model"], _COLS, "covered", True, most=50)


@register()
def q_instance_width(spark, d):
    return instance_predict.predictability(_instance_outcomes(spark, d), ["model"], _COLS, "width_norm", False, most=50)


@register()
def x_complexity(spark, d):
    return complexity.complexity(reg_panel(spark, d), ["dataset_id", "seed"], _COLS, most_rows=10_000)


@register()
def x_class_complexity(spark, d):
    return complexity.complexity(_emb(spark, d), ["dataset_id"], _ECOLS, "y_idx", classes=True, most_rows=10_000)


@register()
def x_shrunken_trees(spark, d):
    return complexity.shrinkage(_emb(spark, d), ["dataset_id"], _ECOLS, "y_idx", classes=True, most_rows=10_000)


@register()
def x_target_information(spark, d):
    return complexity.information(reg_panel(spark, d), ["dataset_id", "seed"], _COLS, most_rows=10_000)


@register()
def x_class_information(spark, d):
    return complexity.information(_emb(spark, d), ["dataset_id"], _ECOLS, "y_idx", classes=True, most_rows=10_000)


def _trials(spark, d):
    own = _points(spark, d).select("dataset_id", "seed", "model", "mae", "rmse")
    long = own.unpivot(["dataset_id", "seed", "model"], ["mae", "rmse"], "metric", "value")
    return long.withColumn("ensemble", F.explode(F.array(*(F.lit(e) for e in (1, 4, 8))))).withColumn("value", F.col("value") * (1 + F.lit(0.1) / F.col("ensemble") * (F.col("dataset_id") % 3)))


_TR = """
tr AS (SELECT dataset_id, seed, model, metric, e AS ensemble, v * (1 + 0.1::DOUBLE / e * (dataset_id % 3)) AS value
  FROM (SELECT dataset_id, seed, model, unnest(['mae', 'rmse']) AS metric, unnest([mae, rmse]) AS v FROM pa) CROSS JOIN (SELECT unnest([1, 4, 8]) AS e)),
dm AS (SELECT metric, model, ensemble, dataset_id, avg(value) AS value FROM tr GROUP BY ALL)"""


@register(S.query(S.REG, S.PA, _TR, "SELECT metric, model, ensemble, median(value) AS median_metric, count(DISTINCT dataset_id) AS n_datasets FROM dm GROUP BY ALL"), "median_metric")
def a_ensemble_medians(spark, d):
    return ensembles.medians(ensembles.dataset_means(_trials(spark, d)))


@register(S.query(S.REG, S.PA, _TR, "SELECT ensemble, model, 'mae' AS coverage_type, median(CASE WHEN metric = 'mae' THEN value END) AS coverage, median(CASE WHEN metric = 'rmse' THEN value END) AS width, count(*) FILTER (metric = 'mae') AS n_datasets FROM dm GROUP BY ALL"), "coverage width")
def a_interval_medians(spark, d):
    return ensembles.interval_medians(ensembles.dataset_means(_trials(spark, d)), ["mae"], "rmse")


@register(S.query(S.REG, S.PA, "SELECT dataset_id, model, avg(mae) AS mean_mae, stddev_samp(mae) AS sd_mae, arg_min(rmse, seed) AS rmse FROM pa GROUP BY ALL"), "mean_mae sd_mae rmse")
def a_repeat_summary(spark, d):
    return ensembles.panel_summary(_points(spark, d).withColumnRenamed("seed", "repeat"), ["dataset_id", "model"], "mae", ["rmse"])


@register(S.query(S.REG, S.FEAT, S.FLONG, "SELECT * FROM flong WHERE feature IN ('f_disc_mean', 'f_y_sd')"), "value")
def p_selected_features(spark, d):
    return selection.only_selected(_features_long(spark, d), ["f_disc_mean", "f_y_sd", "f_absent"])


@register("SELECT unnest(['c_name', 'c_mktsegment', 'o_orderstatus', 'o_orderpriority']) AS name")
def u_text_columns(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return spark.createDataFrame([(x,) for x in preprocessing.text_columns(c, o, c)], "name string")


# --------------------------------------------------------------------------- extension
@register("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, avg(CASE WHEN value >= 5 AND value <= 50 THEN 1 ELSE 0 END) AS coverage FROM events GROUP BY ALL", "coverage")
def ext_windowed_coverage(spark, d):
    return windowed_coverage(with_bounds(table(spark, d, "events"), 5.0, 50.0))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in QUERIES.items() if q.sql is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, width and interval score of every cell and level."""
    return QUERIES["r_interval_metrics"].run(spark, sf_dir)


