"""The registered queries over a whole small table, against the public libraries and plain code."""

import zlib

import numpy as np
import pytest

from plumbline.llm import near_dedup, packing, queries
from plumbline.llm import quality_classifier as Q

from .test_pipeline import _without_repeats
from .test_quality import _counts
from .test_tokens import piece, plainly, public  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op1(spark, texts, piece):  # noqa: F811
    got = {r["doc_id"]: r for r in queries.op1_sentencepiece(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        assert got[i]["ids"] == piece.encode(text) and got[i]["n_ids"] == len(got[i]["ids"]) and got[i]["round_trip"]


def test_op4(spark, texts):
    got = {r["doc_id"]: r for r in queries.op4_substring_dedup(spark, SF).collect()}
    want = dict(_without_repeats(sorted(texts.items())))
    assert {i: r["text"] for i, r in got.items()} == want
    assert all((r["n_removed"] > 0) == (want[i] != texts[i]) for i, r in got.items()) and any(r["n_removed"] for r in got.values())


def test_op5(spark, texts):
    got = {r["doc_id"]: r for r in queries.op5_quality_rules(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n = _counts(text)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert got[i]["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (got[i]["kept"] and got[i]["base_failed"])


def test_op6(spark, texts):
    got = {r["doc_id"]: r for r in queries.op6_quality_classifier(spark, SF).collect()}
    assert got.keys() == texts.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learned = sorted(i for i in labels if not got[i]["held_out"])
    model = Q.fit(Q.features([texts[i].encode() for i in learned]), np.array([float(labels[i]) for i in learned]))
    np.testing.assert_allclose([got[i]["score"] for i in texts], model.score(Q.features([t.encode() for t in texts.values()])), atol=1e-9)


def test_op7(spark, texts, plainly):  # noqa: F811
    by_doc, by_sequence = {}, {}
    for r in queries.op7_packing(spark, SF).collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    total = 0
    for i, text in texts.items():
        ids, own = plainly(text) + [2], sorted(by_doc[i], key=lambda r: r["piece"])
        total += len(ids)
        assert [r["piece"] for r in own] == list(range(len(own))) and (len(own) == 1 or len(ids) > 1024) and all(r["length"] == 1024 for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert len(by_sequence) <= 1.03 * -(-total // packing.SEQUENCE)


def test_op10(spark, texts, public):  # noqa: F811
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op10_token_counts(spark, SF).collect()}
    assert got == {i: len(public(t)) for i, t in texts.items()}


@pytest.mark.parametrize("union", [4, 8, 20, 40, 200, 1000])
def test_recall_of_bands_by_size(union):
    """Of pairs just similar enough, small sets with borrowed registers included, all share a band."""
    rng, pairs = np.random.default_rng(union), 500
    shared, sides = union * 3 // 4, ([], [])
    for _ in range(pairs):
        v = rng.integers(0, 2**64, union, dtype=np.uint64)
        cut = shared + int(rng.integers(0, union - shared + 1))
        sides[0].append(v[:cut])
        sides[1].append(np.concatenate((v[:shared], v[cut:])))
    keys = [near_dedup.bands(near_dedup.registers(pairs, np.repeat(np.arange(pairs), [len(x) for x in own]), np.concatenate(own))) for own in sides]
    assert (keys[0] == keys[1]).any(1).all()
