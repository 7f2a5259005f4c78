"""Tokenizers against the public libraries; counts and packing against brute force."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import packing, sentencepiece_viterbi, token_counts
from plumbline.llm.tokens import byte_bpe, default_vocabulary

TEXTS = st.text(alphabet=st.sampled_from("ab etionréç\n\t  漢😀the.,<s>▁\x00\xa0'12|"), max_size=120)


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_byte_bpe(public, text):
    assert np.frombuffer(byte_bpe(*default_vocabulary()).encode(text), "<u4").tolist() == public(text)


SPECIALS = st.lists(TEXTS | st.just("<|endoftext|>") | st.just("<|endoftext|"), max_size=6).map("".join)


@pytest.fixture(scope="module")
def plainly():
    """Run as the contract of op7 says: special tokens in a text are read."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@given(SPECIALS)
@settings(max_examples=300, deadline=None)
def test_byte_bpe_special(plainly, text):
    assert np.frombuffer(byte_bpe(*default_vocabulary()).encode_special(text), "<u4").tolist() == plainly(text)


@pytest.fixture(scope="module")
def piece():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_pieces(piece, text):
    model = sentencepiece_viterbi.piece_model(sentencepiece_viterbi.default_model())
    ids = np.frombuffer(model.encode(text), "<i4").tolist()
    assert ids == piece.encode(text)
    assert model.decode(ids) == piece.decode(ids)


@given(st.lists(st.integers(3, 31_999) | st.integers(3, 258) | st.just(35), max_size=30))
@settings(max_examples=200, deadline=None)
def test_decode_anything(piece, ids):
    assert sentencepiece_viterbi.piece_model(sentencepiece_viterbi.default_model()).decode(ids) == piece.decode(ids)


@pytest.mark.parametrize("text", ["abcdetionrs" * 3000, "x" * 5000, "ananas" * 500, "漢字😀" * 300, "the" * 2000])
def test_stream_commits(piece, text):
    """A text without blanks goes through a window of the longest piece, whatever its length,
    and ids are committed on the way."""
    model = sentencepiece_viterbi.PieceModel(sentencepiece_viterbi.default_model())
    committed = []

    class Seen(list):
        def __iadd__(self, more):
            committed.append(list(more))
            return super().__iadd__(committed[-1])

    window, out = [[0, "", None, 0.0]], Seen()
    model._run(text, window, out)
    assert len(window) <= model.widest <= model.longest
    pending = len(text) - sum(map(len, out))
    assert len(committed) > len(text) / 100 and pending < 10 * model.longest
    assert "".join(model.stream(text)) == text
    assert np.frombuffer(model.encode(text), "<i4").tolist() == piece.encode(text)


def test_query_goes_through_the_window(piece):
    """Every stretch of every text runs through the pass; texts of all lengths alike."""
    import pyarrow.parquet as pq

    model = sentencepiece_viterbi.PieceModel(sentencepiece_viterbi.default_model())
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    raw = model.encode_many(texts)
    assert model.ran == len(model.stretches) > 1000 and 0 < model.widest <= model.longest
    assert [np.frombuffer(x, "<i4").tolist() for x in raw] == piece.encode(texts)
    again = model.ran
    assert model.encode_many(texts) == raw and model.ran == again


def test_memory_bound(piece, monkeypatch):
    """What does not fit is encoded each time, with the same ids."""
    monkeypatch.setattr(sentencepiece_viterbi, "MEMORY", 20_000)
    model = sentencepiece_viterbi.PieceModel(sentencepiece_viterbi.default_model())
    texts = [f"word{k} other{k % 7} and a third, {k * 7919}" for k in range(300)]
    for _ in range(2):
        assert [np.frombuffer(x, "<i4").tolist() for x in model.encode_many(texts)] == piece.encode(texts)
    assert model.held <= 20_000 + 200 and len(model.stretches) < 100


def test_unigram_stream():
    """The best path of a small unigram model, against all segmentations."""
    import itertools

    model = sentencepiece_viterbi.PieceModel(sentencepiece_viterbi.default_model())
    model.kind = 1
    model.score = {"a": -1.0, "b": -1.2, "ab": -1.9, "ba": -2.5, "aba": -2.6, "bb": -3.0}
    model.suffixes = {p[k:]: False for p in model.score for k in range(1, len(p))} | model.score
    model.prefixes = {p[:k] for p in model.score for k in range(1, len(p))}
    model.longest, model.floor = 3, -20.0
    for word in map("".join, itertools.product("ab", repeat=9)):
        best = None
        for cut in range(1 << 8):
            parts, at = [], 0
            for k in range(1, 10):
                if k == 9 or cut >> (k - 1) & 1:
                    parts.append(word[at:k])
                    at = k
            if all(p in model.score for p in parts):
                best = max(best or -1e9, sum(model.score[p] for p in parts))
        assert sum(model.score[p] for p in model.stream(word)) == pytest.approx(best)


def test_encode_frames(spark, hard, nothing):
    both = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(hard))
    bad = both.where((F.col("decoded") != F.coalesce("text", F.lit(""))) & ~F.col("text").contains("▁"))
    assert both.count() == hard.count() and bad.count() == 0
    # Columns that have the results' names already are replaced.
    clash = hard.withColumnsRenamed({"kept": "ids", "bucket": "Decoded"})
    both = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(clash, check_col="ok"))
    assert both.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "ok", "decoded"]
    assert both.where("ok <> (decoded = coalesce(text, ''))").count() == 0 and both.where("not ok and text not like '%▁%'").count() == 0
    assert sentencepiece_viterbi.encode(nothing).count() == 0


def _sizes(hard, public):
    return {(r["doc_id"], r["text"]): len(public(r["text"] or "")) for r in hard.collect()}


def test_token_counts(spark, hard, nothing, public):
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.token_counts(hard).collect())
    assert got == sorted((r["doc_id"] or -1, len(public(r["text"] or ""))) for r in hard.collect())
    assert token_counts.token_counts(nothing).count() == 0


def test_scan_stitches(spark, tmp_path, monkeypatch):
    """Documents across many blocks and groups of blocks, empty ones, an open end; two files."""
    monkeypatch.setattr(token_counts, "GROUP", 16)
    rng = np.random.default_rng(0)
    want = {}
    for name, kind in (("a", 0), ("b", 7)):
        tokens = rng.integers(0, 5, 2000 + kind)
        tokens[-3:] = 1
        tokens[100:700] = 2
        tokens.astype("<u2").tofile(tmp_path / f"{name}.tokens")
        ends = np.flatnonzero(tokens == 0)
        want |= {(f"{name}.tokens", k): (int(n), True) for k, n in enumerate(np.diff(ends, prepend=-1) - 1)}
        want[f"{name}.tokens", len(ends)] = (len(tokens) - int(ends[-1]) - 1, False)
    got = token_counts.scan(token_counts.ranges(spark, str(tmp_path), block_tokens=3), end=0).collect()
    assert {(r["file"], r["doc_index"]): (r["n_tokens"], r["closed"]) for r in got} == want


def test_flat_files(spark, tmp_path):
    """Bytes are ids end to end; widths; files that end inside a token; ids that do not fit."""
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "<|endoftext|>")], "doc_id long, text string").coalesce(1)
    for width in (2, 4):
        folder = tmp_path / str(width)
        folder.mkdir()
        order = token_counts.write_flat(docs, str(folder), width=width).collect()
        assert [(r["doc_index"], r["doc_id"]) for r in order] == [(0, 1), (1, 2), (2, 3)]
        (file,) = folder.iterdir()
        tokens = np.fromfile(file, f"<u{width}").tolist()
        assert tokens[:4] == [64, 275, 50256, 50256] and tokens.count(50256) == 3 and tokens[-1] == 50256
        got = token_counts.scan(token_counts.ranges(spark, str(folder), width, block_tokens=2), width=width).collect()
        assert sorted((r["doc_index"], r["n_tokens"]) for r in got) == [(0, 2), (1, 0), (2, 7)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x").write_bytes(b"123")
    with pytest.raises(Exception, match="inside a token"):
        token_counts.scan(token_counts.ranges(spark, str(tmp_path / "bad"))).collect()
    with pytest.raises(ValueError, match="does not fit"):
        token_counts.as_width(np.array([70_000], "<u4").tobytes(), 2)


@pytest.mark.parametrize("path", ["/a/b", "file:/a/b", "file:///a/b"])
def test_stores(path):
    from pyarrow import fs

    store, at = token_counts._store(path)
    assert isinstance(store, fs.LocalFileSystem) and at == "/a/b"


def test_packing(spark, hard, nothing, plainly):
    got = packing.pack(hard, with_ids=True).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    own = got.sort_values(["sequence_id", "offset"])
    assert (own.groupby("sequence_id").length.cumsum() - own.length == own.offset).all()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got.itertuples())
    want = {i: plainly(t or "") + [2] for (i, t) in {(r["doc_id"], r["text"]) for r in hard.collect()} if i is not None}
    for i, ids in want.items():
        mine = got[got.doc_id == i].sort_values("piece")
        if i != 2:  # a repeated row is packed twice
            assert [x for r in mine.ids for x in r] == ids and mine.start.tolist() == np.concatenate(([0], np.cumsum(mine.length)[:-1])).tolist()
            assert (mine.length.iloc[1:] == 1024).all() and (len(ids) > 1024 or len(mine) == 1)
    assert packing.pack(nothing).count() == 0


@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
@settings(max_examples=80, deadline=None)
def test_plan_is_exact(lengths):
    size = 64
    histogram = np.bincount(lengths, minlength=size + 1)
    plan = packing.Plan(histogram, size)
    assert (plan.used == histogram).all()
    rank = np.concatenate([np.arange(n) for n in histogram])
    length = np.repeat(np.arange(size + 1), histogram)
    sequence, offset = plan.place(length, rank)
    filled = [sorted(zip(offset[sequence == s], length[sequence == s], strict=True)) for s in range(plan.sequences)]
    assert all(own and own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[-1][0] + own[-1][1] <= size for own in filled)


def test_plan_is_tight():
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(1, 1025, 20_000), minlength=1025)
    plan = packing.Plan(histogram)
    # Uniform lengths: about as many are over half a sequence as sequences are needed.
    assert plan.sequences <= -(-int((np.arange(1025) * histogram).sum()) // 1024) * 1.006


def test_patterns_place_most():
    """Patterns place most pieces of a large histogram, and cost no sequence."""
    rng = np.random.default_rng(2)
    histogram = np.bincount(np.minimum(rng.geometric(1 / 300, 200_000), 1024), minlength=1025)
    plan = packing.Plan(histogram)
    short = histogram.copy()
    short[1024] = 0
    assert plan.by_pattern > 0.3 * short.sum()
    assert plan.sequences <= histogram[1024] + sum(n for _, n in packing.best_fit(short, 1024))


def test_fit_is_least_squares():
    """No feasible direction is left: the gradient is nil where a count is positive and not
    positive elsewhere."""
    rng = np.random.default_rng(3)
    histogram = np.bincount(rng.integers(1, 32, 5_000), minlength=33)
    rows = packing.patterns(np.flatnonzero(histogram), 32)
    x = packing.fit_counts(rows, histogram)
    use = rows > 0
    residual = histogram - np.bincount(rows.ravel(), (x[:, None] * use).ravel(), 33)
    gradient = (residual[rows] * use).sum(1)
    assert (x >= 0).all() and abs(gradient[x > 0]).max() < 1e-3 and gradient[x == 0].max() < 1.0
