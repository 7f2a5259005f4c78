"""Encodings fitted on context rows and applied to all."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import finite, ratio


class Strategy(Enum):
    PASSTHROUGH = "passthrough"
    ORDINAL = "ordinal"
    ONE_HOT = "one_hot"
    STRING = "string"
    NUMERIC_ARRAY = "numeric_array"


MISSING = "__MISSING__"


def task_of(schema: T.StructType, target: str) -> str:
    """Booleans and everything that is not a number are classes."""
    kind = schema[target].dataType
    return "regression" if isinstance(kind, T.NumericType) else "classification"


def column_kinds(schema: T.StructType, skip: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns."""
    own = [f for f in schema if f.name not in skip]
    return [f.name for f in own if isinstance(f.dataType, T.NumericType)], [f.name for f in own if not isinstance(f.dataType, T.NumericType)]


def usable(rows: DataFrame, target: str) -> DataFrame:
    """Rows whose target is there and, for numbers, finite."""
    x = F.col(target)
    return rows.where(finite(x).isNotNull() if task_of(rows.schema, target) == "regression" else x.isNotNull())


def label_codes(rows: DataFrame, keys: Sequence[str], label: str, out: str = "y_idx") -> DataFrame:
    """0-based codes of labels in sorted order within keys; keys with one class are left out."""
    classes = rows.where(F.col(label).isNotNull()).select(*keys, label).distinct()
    own = Window.partitionBy(*keys)
    coded = classes.withColumns({out: F.row_number().over(own.orderBy(label)) - 1, "__n": F.count(F.lit(1)).over(own)}).where("__n >= 2").drop("__n")
    return rows.join(coded, [*keys, label])


def ordinal(rows: DataFrame, columns: Sequence[str], context: str = "in_context") -> DataFrame:
    """Codes by sorted context values; -1 for values the context lacks, null stays null."""
    out = rows
    for c in columns:
        seen = rows.where(F.col(context) & F.col(c).isNotNull()).select(F.col(c).alias("__v")).distinct()
        codes = seen.withColumn("__code", F.row_number().over(Window.orderBy("__v")) - 1)
        out = out.join(codes, out[c] == codes["__v"], "left").withColumn(c, F.when(F.col(c).isNull(), None).otherwise(F.coalesce("__code", F.lit(-1)))).drop("__v", "__code")
    return out


def one_hot(rows: DataFrame, column: str, values: Sequence[str], weight: bool = True) -> DataFrame:
    """An array column of indicators; unknown values give zeros.  With ``weight`` a column's
    indicators add up to what one numeric column would."""
    scale = (1.0 / len(values)) ** 0.5 if weight and values else 1.0
    return rows.withColumn(f"{column}_hot", F.array(*(F.when(F.col(column) == v, scale).otherwise(0.0) for v in values)))


def impute_median(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], context: str = "in_context") -> DataFrame:
    """Missing numbers become the context's median, 0 where it has none."""
    mid = rows.where(context).groupBy(*keys).agg(*(F.percentile(finite(F.col(c)), 0.5).alias(f"m_{c}") for c in columns))
    out = rows.join(mid, list(keys), "left")
    return out.withColumns({c: F.coalesce(finite(F.col(c)), F.col(f"m_{c}"), F.lit(0.0)) for c in columns}).drop(*(f"m_{c}" for c in columns))


def stringified(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns})


def vocabulary(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, code): shared codes over context and test rows."""
    long = stringified(rows, columns).unpivot([], list(columns), "feature", "value").distinct() if columns else rows.limit(0)
    return long.withColumn("code", F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1)


def fill_empty_columns(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], context: str = "in_context") -> DataFrame:
    """Columns that the context lacks everywhere become 0 in every row of the key."""
    have = rows.where(context).groupBy(*keys).agg(*(F.count(finite(F.col(c))).alias(f"n_{c}") for c in columns))
    out = rows.join(have, list(keys), "left")
    return out.withColumns({c: F.when(F.coalesce(f"n_{c}", F.lit(0)) == 0, 0.0).otherwise(F.col(c)) for c in columns}).drop(*(f"n_{c}" for c in columns))


def quantile_transform(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], train: str = "in_context", grid: int = 20) -> DataFrame:
    """Median fill and indicators, then the empirical quantile on train rows, standardised."""
    flags = rows.withColumns({f"{c}_missing": finite(F.col(c)).isNull().cast("double") for c in columns})
    filled = impute_median(flags, keys, columns, train)
    points = [k / grid for k in range(grid + 1)]
    edges = filled.where(train).groupBy(*keys).agg(*(F.percentile(c, F.array(*(F.lit(p) for p in points))).alias(f"e_{c}") for c in columns))
    out = filled.join(edges, list(keys))
    place = {c: (F.size(F.filter(f"e_{c}", lambda e, c=c: e < F.col(c))) + F.size(F.filter(f"e_{c}", lambda e, c=c: e <= F.col(c)))) / (2.0 * (grid + 1)) for c in columns}
    out = out.withColumns(place).drop(*(f"e_{c}" for c in columns))
    stats = out.where(train).groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = out.join(stats, list(keys))
    return out.withColumns({c: F.coalesce(ratio(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)) for c in columns}).drop(*(f"{n}_{c}" for c in columns for n in ("m", "s")))


def apply(rows: DataFrame, strategy: Strategy, numeric: Sequence[str], categorical: Sequence[str], context: str = "in_context") -> DataFrame:
    if strategy is Strategy.PASSTHROUGH:
        return rows
    if strategy is Strategy.STRING:
        return stringified(rows, categorical)
    coded = ordinal(rows, categorical, context)
    if strategy is Strategy.NUMERIC_ARRAY:
        return coded.withColumn("features", F.array(*(F.col(c).cast("double") for c in (*numeric, *categorical))))
    if strategy is Strategy.ONE_HOT:
        for c in categorical:
            values = [r[0] for r in rows.where(F.col(context) & F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(1000).collect()]
            rows = one_hot(rows, c, values)
        return rows
    return coded


def text_columns(*frames: DataFrame) -> list[str]:
    """Columns that are no number in any of several frames, in the order they come."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    found = {c: None for df in frames for c, kind in df.dtypes if kind not in numeric and not kind.startswith("decimal")}
    return list(found)
