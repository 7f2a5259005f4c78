"""What is known of each metric: direction, category, scale, and its use in comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They must agree with published tables.  True: lower is better; None: no
# direction, since the metric shows one side of the coverage-width trade-off.
LOWER_IS_BETTER: dict[str, bool | None] = {
    "r2": False, "rmse": True, "mae": True, "crps_mean": True,
    "pit_ece": True, "pit_hist_l1": True, "pit_ks_stat": True,
    "cov_dev_signed": None, "wsc_dev_signed": None, "cov_abs_dev": None, "wsc_abs_dev": None, "total_abs_dev": None,
    "avg_length": None, "avg_width_norm": None,
    "interval_score": True, "pinball_lower": True, "pinball_mean": True, "pinball_upper": True,
    "accuracy": False, "macro_f1": False, "roc_auc_ovr_macro": False, "brier_score": True, "log_loss": True,
    "confidence_ece_em": True, "confidence_ece_ew": True, "confidence_mce_em": True, "confidence_mce_ew": True,
    "classwise_ece_em": True, "classwise_ece_ew": True, "classwise_mce_em": True, "classwise_mce_ew": True,
    "cmce_em": True, "cmce_ew": True,
}
ABSOLUTE_DELTA = {"r2", "accuracy", "macro_f1", "roc_auc_ovr_macro", "brier_score"}
AXIS = {"cov_abs_dev", "wsc_abs_dev", "total_abs_dev", "avg_width_norm"}
SIGNED = {"cov_dev_signed", "wsc_dev_signed"}
SCALE_DEPENDENT = {"rmse", "mae", "crps_mean", "interval_score", "pinball_lower", "pinball_mean", "pinball_upper", "avg_length", "brier_score", "log_loss"}
PREDICTION = {"r2", "rmse", "mae", "accuracy", "macro_f1", "roc_auc_ovr_macro"}
PROPER = {"crps_mean", "interval_score", "pinball_lower", "pinball_mean", "pinball_upper", "brier_score", "log_loss"}
#: Responses of an analysis that names none (fixed values).
DEFAULT_RESPONSES = {
    "regression": ("r2", "rmse", "mae", "crps_mean", "pit_ece", "pit_hist_l1", "pit_ks_stat", "cov_dev_signed", "wsc_dev_signed", "cov_abs_dev", "wsc_abs_dev", "total_abs_dev", "interval_score", "pinball_lower", "pinball_mean", "pinball_upper", "avg_width_norm"),
    "classification": ("log_loss", "brier_score", "accuracy", "macro_f1", "roc_auc_ovr_macro", "confidence_ece_em", "classwise_ece_em", "cmce_em"),
}
#: Levels that a feature selection must have for each category.
REQUIRED_ALPHAS = (0.05, 0.2)

TRADE_OFF = {m for m, lower in LOWER_IS_BETTER.items() if lower is None}


def direction(metric: str) -> int:
    """+1 if higher is better, -1 if lower is, 0 without direction or unknown."""
    lower = LOWER_IS_BETTER.get(metric)
    return 0 if lower is None else -1 if lower else 1


def ascending(metric: str) -> bool:
    """Whether better comes first in ascending order; an error for metrics without direction."""
    lower = LOWER_IS_BETTER[metric]
    if lower is None:
        raise ValueError(f"{metric} has no direction")
    return lower


#: Metrics of which more is better.
HIGHER_IS_BETTER = tuple(m for m, lower in LOWER_IS_BETTER.items() if lower is False)


def signed(metric: Column, value: Column) -> Column:
    """``value`` so that less is better; long names count by their last part, and metrics
    without direction as if lower were better."""
    last = F.element_at(F.split(metric, r"\."), -1)
    return F.when(last.isin(*HIGHER_IS_BETTER), -value).otherwise(value)


def axis_direction(metric: str, bias: bool = False) -> int | None:
    """The sign of a peer-relative value: +1 for biases; the direction, or -1 on an axis; else None."""
    if bias:
        return 1 if metric in SIGNED else None
    return direction(metric) or (-1 if metric in AXIS else None)


def category(metric: str) -> str:
    if metric not in LOWER_IS_BETTER:
        return "other"
    return "prediction" if metric in PREDICTION else "proper_score" if metric in PROPER else "calibration"


def scale(metric: str) -> str:
    return "scale_dependent" if metric in SCALE_DEPENDENT else "scale_free"


def registry(spark: SparkSession) -> DataFrame:
    """One row a metric, for joins."""
    schema = T.StructType([T.StructField("metric", T.StringType()), T.StructField("direction", T.IntegerType()), T.StructField("category", T.StringType()), T.StructField("scale", T.StringType()), T.StructField("trade_off", T.BooleanType()), T.StructField("axis", T.BooleanType()), T.StructField("signed", T.BooleanType()), T.StructField("absolute_delta", T.BooleanType())])
    return spark.createDataFrame([(m, direction(m), category(m), scale(m), m in TRADE_OFF, m in AXIS, m in SIGNED, m in ABSOLUTE_DELTA) for m in LOWER_IS_BETTER], schema)
