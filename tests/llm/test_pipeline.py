"""The pipeline against plain code, stage after stage, and on hard, empty and clashing tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import packing
from plumbline.llm import quality_classifier as Q

from .conftest import prose
from .test_dedup import _near, _sentences
from .test_tokens import plainly  # noqa: F401

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _documents():
    """Prose, junk, exact and near copies, shared passages, nulls and empty texts."""
    passage = prose(900, 70)
    rows = {k: prose(k, 80 + 7 * (k % 30)) for k in range(40)}
    rows |= {100 + k: "!!! ### $$$ BUY " * (5 + k % 9) + f"NOW{k}" for k in range(25)}
    rows |= {200 + k: rows[k] for k in range(0, 12, 2)}
    for k in range(1, 10, 2):
        words = rows[k].split()
        words[len(words) // 2] = "changed"
        rows[300 + k] = " ".join(words)
    rows |= {400 + k: f"{prose(500 + k, 60)} {passage} {prose(600 + k, 45)}" for k in range(6)}
    rows |= {501: None, 502: "", 503: prose(77, 3000), 504: prose(78, 26) + "\n\n" + passage}
    labels = {i: int("BUY" not in (t or "")) for i, t in rows.items() if i % 3 != 2 and i < 500}
    return rows, labels


def _without_repeats(rows):
    """Whole runs to a closing sentence, the shortest from each start and to each end."""
    first, found, parts = {}, [], {}
    for i, text in sorted(rows):
        own = parts[i] = _sentences(text)
        n = [len(w) for _, _, w in own]
        fits = lambda a, b, n=n: sum(n[a:b]) >= 25 and (b - a > 1 or n[a] >= 50)
        spans = {(a, next((b for b in range(a + 1, len(n) + 1) if fits(a, b)), None)) for a in range(len(n))}
        spans |= {(next((a for a in range(b - 1, -1, -1) if fits(a, b)), None), b) for b in range(1, len(n) + 1)}
        for a, b in spans:
            if a is not None and b is not None:
                key = tuple(w for s in own[a:b] for w in s[2])
                first[key] = min(first.get(key, (i, a)), (i, a))
                found.append((key, i, a, b))
    gone = {}
    for key, i, a, b in found:
        if (i, a) != first[key]:
            gone.setdefault(i, set()).update(range(a, b))
    out = []
    for i, text in rows:
        if drop := gone.get(i):
            own = parts[i]
            text = text[: own[0][0]] + "".join(text[s:e] for k, (s, e, _) in enumerate(own) if k not in drop) if len(drop) < len(own) else ""
        out.append((i, text))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, labels = _documents()
    frame = spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in rows.items()], COLUMNS)
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_run_equals_plain_code(spark, tables, plainly):  # noqa: F811
    rows, labels = _documents()
    # Quality: the same model of the same labels.
    learned = sorted(i for i in labels if not Q.held_out(i))
    model = Q.fit(Q.features([(rows[i] or "").encode() for i in learned]), np.array([float(labels[i]) for i in learned]))
    score = model.score(Q.features([(t or "").encode() for t in rows.values()]))
    kept = {i: t or "" for (i, t), s in zip(rows.items(), score, strict=True) if s >= 0.5}
    assert not any("BUY" in t for t in kept.values()) and len(kept) > 50
    # Exact copies: the largest id of each text.
    largest = {t: max(i for i in kept if kept[i] == t) for t in kept.values()}
    kept = {i: t for i, t in kept.items() if largest[t] == i}
    assert {200, 202, 204} <= set(kept) and not {0, 2, 4} & set(kept)
    # Near copies: the smallest id of each component.
    kept = {i: kept[i] for i, _, c in _near(sorted(kept.items())) if i == c}
    assert {1, 3, 5} <= set(kept) and not {301, 303, 305} & set(kept)
    # Repeated passages.
    cut = dict(_without_repeats(sorted(kept.items())))
    assert sum(cut[i] != kept[i] for i in kept) >= 6
    got = corpus_pipeline.run(spark, tables).collect()
    assert {r["doc_id"] for r in got} == set(cut)
    taken = {}
    for i, text in cut.items():
        ids = plainly(text) + [2]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))] and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in taken.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= packing.SEQUENCE
    assert len(taken) == len({r["sequence_id"] for r in got})


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_hard_tables(spark, tables, hard, nothing, stage):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns, an empty table."""
    name, run = corpus_pipeline.STAGES[stage]
    docs = hard.withColumnRenamed("bucket", "gone").withColumn("carry_0", F.lit(1))
    got = run(spark, docs, tables)
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in got.select("doc_id").collect()} <= ids, name
    if stage < 4:
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        assert got.count() <= docs.count() and run(spark, nothing, tables).columns == nothing.columns
    assert run(spark, nothing, tables).count() == 0
