"""Hashes of words, lines and runs: no collisions by structure; staged tables go to a shared folder."""

import random

import numpy as np
import pytest

from plumbline.llm import common
from plumbline.llm.near_dedup import shingle_sets
from plumbline.llm.text_stats import Counts


def thue_morse(n, letters=b"ab"):
    return bytes(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [8, 16, 64, 128, 1024, 4096])
def test_structured_words_differ(n):
    """Polynomials modulo a power of two are equal on these for every base."""
    x, y = thue_morse(n), thue_morse(n, b"ba")
    for lane in (0, 1):
        a, b, c = common.Words([x + b" " + y + b" " + x]).hashes(lane)
        assert a == c and a != b
    assert Counts([x + b"\n" + y]).n_dup_lines.tolist() == [0]
    assert Counts([x + b"\n" + y + b"\n" + x]).n_dup_lines.tolist() == [1]
    _, shingles = shingle_sets([x, y, x])
    assert shingles[0] == shingles[2] != shingles[1]


def test_spans_by_bytes():
    """Spans are equal when their bytes are, wherever they lie and however long they are."""
    rng = random.Random(1)
    words = [bytes(rng.choice(b"ab\x00") for _ in range(n)) for n in (*range(1, 20), 63, 64, 65, 66, 200) for _ in range(6)]
    text = [words[rng.randrange(len(words))] for _ in range(3000)]
    for lane in (0, 1):
        hashed = common.Words([b" ".join(text)]).hashes(lane)
        assert len(set(hashed.tolist())) == len(set(text)) == len(set(zip(text, hashed.tolist())))
    assert len(common.Words([b"", b" \n"]).hashes()) == 0


def test_runs_modulo_a_prime():
    rng = random.Random(2)
    a, b = ([rng.randrange(common.PRIME) for _ in range(500)] + [common.PRIME - 1, 0] for _ in range(2))
    assert common.mul_prime(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % common.PRIME for x, y in zip(a, b)]
    bits = np.array(list(thue_morse(1024) + thue_morse(1024, b"ba") + thue_morse(1024)), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.array([0, 1024, 2048])
    for lane in (0, 1):
        x, y, z = common.run_hashes(bits, at, at + 1024, lane)
        assert x == z != y


def test_shared_folder(spark, monkeypatch):
    """Staged tables go where spark.checkpoint.dir says; a cluster must name a folder."""
    from types import SimpleNamespace

    nowhere = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nowhere)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)
    session.conf.get = lambda key, default: "/shared/x/"
    assert common.shared_dir(session) == "/shared/x"


def test_release(spark):
    """Only what was staged between two marks goes."""
    first = common.staged(spark.range(3), "a")
    at = common.mark()
    second = common.staged(spark.range(4), "b")
    until = common.mark()
    third = common.staged(spark.range(5), "c")
    paths = [x.inputFiles()[0] for x in (first, second, third)]
    common.release(spark, at, until)
    import os

    assert [os.path.exists(p.removeprefix("file://")) for p in paths] == [True, False, True]
