"""Quality rules and the classifier against brute force and held-out labels."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality_classifier as Q
from plumbline.llm import quality_rules as R
from tests.oracle import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, covered = {}, set()
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    for at in seen.values():
        if len(at) > 1:
            for k in at:
                covered.update(range(k, k + 5))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts(hard, nothing):
    got = R.quality_rules(hard).toPandas()
    rows = hard.toPandas()
    mine = sorted(map(str, zip(*(got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), strict=True)))
    want = [_counts(t) for t in rows["text"]]
    assert mine == sorted(str((*c, c[0] < 10 or 100 * c[4] > 20 * c[0])) for c in want)
    assert not (got.kept & got.base_failed).any()
    assert R.quality_rules(nothing).count() == 0


def test_outliers(spark):
    """Planted outliers of a group go, its regular rows stay, whatever share they are of."""
    rng = np.random.default_rng(0)
    words = ["w" * k for k in range(2, 9)]
    text = lambda n: " ".join(f"{words[rng.integers(0, 7)]}{rng.integers(0, 999)}" for _ in range(n))
    rows = [(i, text(int(rng.integers(60, 300))), "en", "a", True) for i in range(200)]
    rows += [(1000 + i, text(150).replace(" ", "$$$ "), "en", "a", False) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, clean boolean")
    got = R.quality_rules(df).join(df.select("doc_id", "clean"), "doc_id").toPandas()
    assert got[got.clean].kept.mean() > 0.98 and not got[~got.clean].kept.any()


def test_robust_model_matches_numpy(spark):
    """The concentration steps find what numpy finds on one group."""
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.multivariate_normal(np.zeros(4), np.diag([1, 2, 0.5, 1.5]), 900), rng.normal(8, 1, (100, 4))))
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, x0 double, x1 double, x2 double, x3 double")
    row = R.robust_model(df, df.groupBy("g").agg(F.count(F.lit(1)).alias("size")), 1).first()
    assert np.abs(np.array(row["m"])).max() < 0.2
    cov = np.linalg.inv(np.array(row["w"]).reshape(4, 4))
    np.testing.assert_allclose(np.diag(cov), np.array([1, 2, 0.5, 1.5]) + np.square(R.FLOORS), rtol=0.25)


def _least_determinant(x, share=R.SHARE, tries=60):
    """(determinant, centre, inverse) by exact concentration steps from random starts."""
    rng, floors, h = np.random.default_rng(0), np.diag(np.square(R.FLOORS)), int(np.ceil(len(x) * share))

    def estimate(own, factor):
        return own.mean(0), np.cov(own.T, bias=True) * factor + floors

    def far(m, cov):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)

    best = None
    for _ in range(tries):
        m, cov = estimate(x[rng.choice(len(x), 6, replace=False)], 1.0)
        for _ in range(60):
            m, new = estimate(x[np.argsort(far(m, cov), kind="stable")[:h]], R.consistency(share))
            if np.allclose(new, cov, rtol=1e-10):
                break
            cov = new
        if best is None or np.linalg.det(cov) < best[0]:
            best = np.linalg.det(cov), m, cov
    _, m, cov = best
    m, cov = estimate(x[far(m, cov) <= R.chi2_quantile(0.975, 4)], R.consistency(0.975))
    return best[0], far(m, cov)


def test_kept_by_brute_force(spark):
    """Verdicts of two groups against exact steps from random starts; one group has a block of
    planted outliers that would pull a plain covariance."""
    rng = np.random.default_rng(5)
    text = lambda n, k: " ".join("x" * int(v) for v in rng.integers(2, 2 + k, n))
    rows = [(i, text(int(rng.integers(40, 200)), 8), "en", "a") for i in range(220)]
    rows += [(300 + i, text(90, 8).replace(" ", " #$% ", int(rng.integers(10, 80))), "en", "a") for i in range(60)]
    rows += [(400 + i, text(int(rng.integers(40, 300)), 12) + (" $" * int(rng.integers(0, 4))), "fr", "b") for i in range(150)]
    rows += [(600 + i, text(100, 60), "fr", "b") for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = R.quality_rules(df).join(df.select("doc_id", "lang"), "doc_id").toPandas().set_index("doc_id").sort_index()
    vectors = R.vectors(R.counts(df)).toPandas().set_index("doc_id").sort_index()
    bound = R.chi2_quantile(1 - R.TAIL, 4)
    for lang in ("en", "fr"):
        own = got[got.lang == lang]
        _, far = _least_determinant(vectors.loc[own.index, ["x0", "x1", "x2", "x3"]].to_numpy())
        clear = np.abs(np.log(far / bound)) > 0.1
        assert clear.mean() > 0.95 and (~own.kept).sum() >= 20
        np.testing.assert_array_equal(own.kept[clear], (~own.base_failed[clear]) & (far[clear] <= bound))
        np.testing.assert_allclose(own.distance[far > 1], far[far > 1], rtol=0.1)


def test_starts_compete(spark):
    """A third of a group in one far cluster: the start of least determinant leaves it out."""
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(0, 1, (750, 4)) @ np.array([[1, 0.9, 0, 0], [0, 0.4, 0, 0], [0, 0, 1, 0.8], [0, 0, 0, 0.5]]), rng.normal(7, 0.2, (240, 4))))
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, x0 double, x1 double, x2 double, x3 double")
    row = R.robust_model(df, df.groupBy("g").agg(F.count(F.lit(1)).alias("size")), 1).first()
    _, far = _least_determinant(x)
    d = x - np.array(row["m"])
    np.testing.assert_allclose(np.einsum("ij,jk,ik->i", d, np.array(row["w"]).reshape(4, 4), d), far, rtol=0.1)


def test_chi_square():
    assert R.chi2_quantile(0.95, 4) == pytest.approx(9.487729, abs=1e-5)
    assert R.chi2_cdf(5.0, 6) == pytest.approx(0.456187, abs=1e-5)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.score(docs, Q.train(docs, labels)).join(labels, "doc_id").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(got.doc_id, got.held_out, strict=True))
    out = got[got.held_out]
    assert (out.predicted == out.quality).mean() > 0.95 and (out[out.quality == 0].predicted == 0).mean() > 0.8


def test_held_out_labels_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (Q.train(docs, x) for x in (labels, flipped))
    assert all((s == t).all() for s, t in zip(a.tables, b.tables, strict=True))


def test_classifier_hard_cases(spark, hard, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (18, 0, 0), (None, 1, 0), (3, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(hard, labels)
    assert Q.score(hard, model).where("score between 0 and 1").count() == hard.count()
    assert Q.score(nothing, model).count() == 0 and Q.filtered(nothing, model).columns == nothing.columns
    none = Q.train(hard, labels.where(F.lit(False)))
    assert {r["score"] for r in Q.score(hard, none).collect()} == {0.5}


def test_pairs_are_learned():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = Q.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean() > 0.9 and {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
