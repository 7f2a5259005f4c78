"""Quality rules: base counts, and robust multivariate outliers for each language and source.

The statistic vectors of a group have a minimum-covariance-determinant estimate.  Each of
three starts (medians and quartiles; the plain mean and covariance; medians and the
covariance of directions) goes through concentration steps: the three quarters of the rows
nearest to the present estimate give the next one, until no determinant changes.  The
start that ends with the smallest determinant is taken and reweighted.  Rows whose
squared Mahalanobis distance passes a chi-square bound are rejected.

Covariances have the squares of FLOORS added to their variances, before determinants are
compared and inverses taken: most texts have no symbols and no repeats at all, and the
three quarters nearest to them would have no spread.

A step is one pass over the whole table for all starts, which sums moments by group,
start and distance bin before the shuffle; the nearest three quarters are then the lowest bins.  No
group is gathered, however large.

Rules: null text counts as empty; a null language or source is a value of its own.
Groups under MIN_GROUP rows are pooled by language, then all together; a pool that is
still smaller rejects nothing beyond the base rules.  An empty table gives an empty
result.  Extra columns are ignored; repeated rows each get a row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of, staged
from .text_stats import Counts

MIN_WORDS, MOST_REPEATED = 10, 20
MIN_GROUP, SHARE = 60, 0.75
#: Concentration steps at most; they end when no log-determinant changes by more.
MOST_STEPS, SETTLED = 12, 1e-4
#: Spread below which a statistic's variation is no outlier; it also keeps covariances regular.
FLOORS = (0.08, 0.5, 0.5, 0.6)
#: Chance that a regular row is rejected, if its vector were normal.
TAIL = 1e-5
#: Group tables up to so many rows are broadcast (0.3 kB a row); larger ones are joined by shuffle.
MOST_BROADCAST_GROUPS = 50_000
_BINS = 24  # distance bins for each doubling
P = len(FLOORS)


def chi2_cdf(x: float, dof: int) -> float:
    """The chi-square distribution for even degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return low


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal rows is multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(batches):
    for batch in batches:
        for a, b, texts in pieces_of(batch.column(3)):
            c = Counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in range(3)] + [pa.array(getattr(c, k).astype(np.int64)) for k in _COUNTS], names=["doc_id", "lang", "source", *_COUNTS])


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_count, "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in _COUNTS))


def vectors(counted: DataFrame) -> DataFrame:
    """The transformed statistics x0 to x3, beside the columns of ``counted``."""
    n = F.col("n_words").cast("double")
    rate = lambda k: F.log1p(100.0 * F.col(k) / (n + 1.0))
    return counted.withColumns({"x0": F.log((F.col("word_chars") + 40.0) / (n + 8.0)), "x1": rate("n_symbols"), "x2": rate("n_dup_lines"), "x3": rate("n_repeat_words")})


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``g``, the group whose estimate holds for them; and (g, size)."""
    name = lambda k: F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("-"))
    rows = rows.withColumns({"g_lang": name("lang"), "g_source": name("source")})
    sizes = rows.groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("size"))
    small = F.col("size") < MIN_GROUP
    pooled = F.sum(F.when(small, F.col("size")).otherwise(0)).over(Window.partitionBy("g_lang"))
    to = F.when(~small, F.to_json(F.array("g_lang", "g_source"))).when(F.col("pool") >= MIN_GROUP, F.to_json(F.array("g_lang"))).otherwise("[]")
    mapped = staged(sizes.withColumn("pool", pooled).withColumn("g", to), "groups")
    joined = _with(rows, mapped.select("g_lang", "g_source", "g"), ["g_lang", "g_source"], mapped.count())
    return joined.drop("g_lang", "g_source"), mapped.groupBy("g").agg(F.sum("size").alias("size"))


def _with(rows: DataFrame, small: DataFrame, keys: list[str], groups: int) -> DataFrame:
    return rows.join(F.broadcast(small) if groups <= MOST_BROADCAST_GROUPS else small, keys)


def _invert(frames):
    """Moments of each group and start to centre, inverse covariance and log-determinant, with
    the squares of FLOORS added."""
    for x in frames:
        out = []
        for row in x.itertuples(index=False):
            mean = np.array(row.sums) / row.n
            cov = (np.array(row.products).reshape(P, P) / row.n - np.outer(mean, mean)) * row.factor
            out.append((row.g, row.start, *_estimate(mean, cov)))
        yield pd.DataFrame(out, columns=_MODEL_NAMES)


def _estimate(mean: np.ndarray, cov: np.ndarray) -> tuple[list, list, float]:
    cov = (cov + cov.T) / 2 + np.diag(np.square(FLOORS))
    return mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _begin(frames):
    """The starts of each group from its quartiles, moments and sums of directions."""
    for x in frames:
        out = []
        for row in x.itertuples(index=False):
            quartiles, n = np.array([list(q) for q in row.quartiles]), row.n
            middle, spread = quartiles[:, 1], np.array(row.spread)
            mean = np.array(row.sums) / n
            plain = np.array(row.products).reshape(P, P) / n - np.outer(mean, mean)
            turned = np.array(row.turned).reshape(P, P) / n * P * np.outer(spread, spread)
            for start, (at, cov) in enumerate(((middle, np.diag(spread**2)), (mean, plain), (middle, turned))):
                out.append((row.g, start, *_estimate(at, cov)))
        yield pd.DataFrame(out, columns=_MODEL_NAMES)


_MODEL = "g string, start int, m array<double>, w array<double>, logdet double"
_MODEL_NAMES = [x.split()[0] for x in _MODEL.split(", ")]


def _distance() -> F.Column:
    """The squared Mahalanobis distance of x0.. to the joined m and w."""
    d = [F.col(f"x{i}") - F.col("m")[i] for i in range(P)]
    terms = [d[i] * d[j] * F.col("w")[i * P + j] * (1.0 if i == j else 2.0) for i in range(P) for j in range(i, P)]
    return sum(terms[1:], terms[0])


def _sums(prefix: str, x: list) -> list:
    """Sums of the x and of their products, as columns named by ``prefix``."""
    return [F.sum(x[i]).alias(f"{prefix}s{i}") for i in range(P)] + [F.sum(x[i] * x[j]).alias(f"{prefix}p{i}{j}") for i in range(P) for j in range(i, P)]


_X = [f"x{i}" for i in range(P)]


def _full(prefix: str) -> F.Column:
    """The whole matrix of summed products as an array."""
    return F.array(*(F.col(f"{prefix}p{min(i, j)}{max(i, j)}") for i in range(P) for j in range(P)))


def _starts(rows: DataFrame, groups: int) -> DataFrame:
    quartiles = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"q{i}") for i, x in enumerate(_X)]
    found = rows.groupBy("g").agg(*quartiles)
    spread = [F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOORS[i] ** 2) for i in range(P)]
    found = staged(found.select("g", F.array(*(f"q{i}" for i in range(P))).alias("quartiles"), F.array(*spread).alias("spread")), "quartiles")
    near = _with(rows, found, ["g"], groups)
    u = [(F.col(x) - F.col("quartiles")[i][1]) / F.col("spread")[i] for i, x in enumerate(_X)]
    norm = F.sqrt(sum((x * x for x in u[1:]), u[0] * u[0]))
    direction = [F.when(norm > 0, x / norm).otherwise(0.0) for x in u]
    summed = near.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *_sums("", [F.col(x) for x in _X]), *_sums("u", direction))
    one = summed.select("g", "n", F.array(*(f"s{i}" for i in range(P))).alias("sums"), _full("").alias("products"), _full("u").alias("turned"))
    return one.join(found, "g").select("g", "n", "quartiles", "spread", "sums", "products", "turned").mapInPandas(_begin, _MODEL)


def _model(moments: DataFrame, factor: float) -> DataFrame:
    """Summed moments of each g and start to its model."""
    names = [f"s{i}" for i in range(P)] + [f"p{i}{j}" for i in range(P) for j in range(i, P)]
    summed = moments.groupBy("g", "start").agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in names))
    return summed.select("g", "start", "n", F.array(*(f"s{i}" for i in range(P))).alias("sums"), _full("").alias("products"), F.lit(float(factor)).alias("factor")).mapInPandas(_invert, _MODEL)


def robust_model(rows: DataFrame, sizes: DataFrame, groups: int) -> DataFrame:
    """(g, start, m, w, logdet): the reweighted minimum-covariance-determinant estimate of each
    group, and the start it comes from."""
    model = staged(_starts(rows, groups), "starts")
    near = Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    own = [F.col(x) for x in _X]
    for _ in range(MOST_STEPS):
        far = _with(rows, model, ["g"], groups).withColumn("bin", F.floor(F.log2(F.greatest(_distance(), F.lit(1e-6))) * _BINS).cast("int"))
        binned = far.groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *_sums("", own))
        before = F.coalesce(F.sum("n").over(near), F.lit(0))
        inner = binned.withColumn("before", before).join(sizes, "g").where(F.col("before") < F.ceil(F.col("size") * SHARE))
        then, model = model, staged(_model(inner, consistency(SHARE)), "model")
        change = model.join(then.select("g", "start", F.col("logdet").alias("was")), ["g", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        if change is None or change < SETTLED:
            break
    least = Window.partitionBy("g").orderBy("logdet", "start")
    model = staged(model.withColumn("k", F.row_number().over(least)).where("k = 1").drop("k"), "least")
    regular = _with(rows, model, ["g"], groups).where(_distance() <= chi2_quantile(0.975, P))
    return _model(regular.groupBy("g", "start").agg(F.count(F.lit(1)).alias("n"), *_sums("", own)), consistency(0.975))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and distance of every row of ``docs``.

    ``base_failed``: under 10 words, or over a fifth of the words in repeated windows of
    five.  ``kept``: neither that nor an outlier of its language and source.
    """
    rows, sizes = _grouped(vectors(staged(counts(docs), "counts")))
    rows = staged(rows, "vectors")
    sizes = staged(sizes, "sizes")
    groups = sizes.count()
    model = staged(robust_model(rows, sizes, groups), "model").join(sizes, "g")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    bound = chi2_quantile(1 - TAIL, P)
    far = _with(rows, model, ["g"], groups).withColumns({"base_failed": base, "distance": _distance()})
    outlier = (F.col("size") >= MIN_GROUP) & (F.col("distance") > bound)
    return far.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & ~outlier).alias("kept"), "distance")
