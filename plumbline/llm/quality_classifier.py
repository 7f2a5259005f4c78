"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins.  Cyclic boosting visits feature after
feature; each visit fits a shallow tree to that feature's bins and adds it to the
feature's lookup table.  The pairs that explain most of what is left get tables of
their own.  A score is a sum of bin entries through the logistic function.

Rules: null text counts as empty; texts without words get a score like others.  Labels
that are null, or whose doc_id is null, are not learned from; several labels of a
document count as one, their mean, and of several rows of a labelled doc_id the one with
the smallest feature vector is learned from.  With no labels of both classes all scores are the
share of positive ones (0.5 without labels).  Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of
from .text_stats import Counts

#: Labelled documents learned from at most: those of the smallest hashes of their doc_id.
MOST_LABELLED = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, LEAVES, RIDGE = 32, 8, 6, 120, 0.15, 4, 2.0

FEATURES = ("length", "word_length", "symbols", "repeats", "dup_lines", "upper", "loud", "stops", "commas", "digits", "distinct", "doubled", "line_words", "other")


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each whole text."""
    c = Counts(texts, more=True)
    n = c.n_words.astype(float)
    per = lambda x: x / (n + 1.0)
    chars = np.maximum(c.word_chars, 1)
    letters = np.maximum(c.upper + c.lower, 1)
    other = c.word_chars - c.upper - c.lower - c.digits - c.stops - c.louds - c.commas - c.n_symbols
    return np.column_stack((np.log1p(n), c.word_chars / np.maximum(n, 1), per(c.n_symbols), per(c.n_repeat_words), c.n_dup_lines / np.maximum(c.n_lines, 1), c.upper / letters, per(c.louds), per(c.stops), per(c.commas), c.digits / chars, c.distinct_words / np.maximum(n, 1) ** 0.75, per(c.doubled), np.log1p(n / np.maximum(c.n_lines, 1)), other / chars))


class AdditiveModel:
    """Bin edges, a table for each feature, and tables for some pairs."""

    def __init__(self, base: float):
        self.base, self.edges, self.tables, self.pairs = base, [], [], []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), np.int64)

    def coarse(self, bins: np.ndarray, j: int) -> np.ndarray:
        return bins[:, j] * PAIR_BINS // (len(self.edges[j]) + 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.bins(x), np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        for a, b, t in self.pairs:
            out += t[self.coarse(bins, a) * PAIR_BINS + self.coarse(bins, b)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x).clip(-30, 30)))


def _shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Bin values of a tree of a few leaves, each split the one that gains most."""
    out = np.zeros(len(g))
    leaves = [(0, len(g))]
    gain = lambda a, b: a * a / (b + RIDGE)
    while len(leaves) < LEAVES:
        best = (1e-9, None, 0)
        for leaf in leaves:
            a, b = leaf
            if b - a > 1:
                cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
                left = gain(cg[:-1], ch[:-1]) + gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - gain(cg[-1], ch[-1])
                k = int(np.argmax(left))
                if left[k] > best[0]:
                    best = (left[k], leaf, a + k + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """The model of features ``x`` and labels ``y`` between 0 and 1."""
    share = float(y.mean()) if len(y) else 0.5
    model = AdditiveModel(float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    if not len(y) or share in (0.0, 1.0):
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-margin.clip(-30, 30)))
            step = RATE * _shallow(np.bincount(bins[:, j], y - p, len(t)), np.bincount(bins[:, j], p * (1 - p), len(t)))
            t += step
            margin += step[bins[:, j]]
    # Pairs by what a table of residuals would gain.
    p = 1 / (1 + np.exp(-margin.clip(-30, 30)))
    coarse = [model.coarse(bins, j) for j in range(len(model.edges))]
    cells = PAIR_BINS * PAIR_BINS
    gains = []
    for a in range(len(coarse)):
        for b in range(a + 1, len(coarse)):
            at = coarse[a] * PAIR_BINS + coarse[b]
            gains.append((float((np.bincount(at, y - p, cells) ** 2 / (np.bincount(at, p * (1 - p), cells) + RIDGE)).sum()), a, b))
    model.pairs = [(a, b, np.zeros(cells)) for _, a, b in sorted(gains, key=lambda z: (-z[0], z[1], z[2]))[:PAIRS]]
    for _ in range(ROUNDS // 4):
        for a, b, t in model.pairs:
            at = coarse[a] * PAIR_BINS + coarse[b]
            p = 1 / (1 + np.exp(-margin.clip(-30, 30)))
            step = RATE * np.bincount(at, y - p, cells) / (np.bincount(at, p * (1 - p), cells) + RIDGE)
            t += step
            margin += step[at]
    return model


def _held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def _featurise(batches):
    for batch in batches:
        for a, b, texts in pieces_of(batch.column(1)):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> AdditiveModel:
    """A model of ``label``, from rows that are not held out and MOST_LABELLED of them at most."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null").where(~_held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.avg("y").alias("y"))
    # MOST_LABELLED rows of two numbers at most go to the texts, which stay where they are.
    chosen = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = own.join(chosen, "doc_id").select(F.struct("doc_id", "y").alias("y"), "text")
    learned = rows.mapInArrow(_featurise, "y struct<doc_id: long, y: double>, x array<double>")
    got = learned.groupBy("y").agg(F.min("x").alias("x")).orderBy("y.doc_id").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(got["x"].to_numpy()), np.array([r["y"] for r in got["y"]]))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""

    def run(batches):
        for batch in batches:
            for a, b, texts in pieces_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(features(texts)))], names=["doc_id", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = own.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filtered(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, all columns as they were, without a shuffle."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for a, b, texts in pieces_of(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(model.score(features(texts)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
