"""Repeated passages are removed up to their last sentence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import substring_dedup


def _sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n - 1)) + " end."


@pytest.mark.parametrize("sizes", [(20, 20, 8, 7), (12, 12, 12, 12, 3, 4, 5), (60, 9, 8), (60, 40), (30, 20)])
def test_closing_sentences(spark, sizes):
    """Short ones after the last whole run, or after one that is a run alone; what surrounds
    the passage stays, and so does its first copy."""
    rng = random.Random(str(sizes))
    passage = " ".join(_sentence(rng, n) for n in sizes)
    rows = [(k, f"{_sentence(rng, 30)} {_sentence(rng, 14)} {passage} {_sentence(rng, 11)} {_sentence(rng, 40)}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(docs, closing=True).collect()}
    for k, text in rows:
        assert got[k] == (text if k == 0 else text.replace(passage + " ", ""))


def test_tails_by_hand(spark):
    """Every shortest run to a closing sentence is a run or a run's tail."""
    rng = random.Random(5)
    sizes = [[rng.choice([1, 3, 8, 12, 26, 30, 49, 50, 70]) for _ in range(40)] for _ in range(20)]
    docs = spark.createDataFrame([(k, " ".join(_sentence(rng, n) for n in own)) for k, own in enumerate(sizes)], "doc_id long, text string")
    made = set()
    for r in substring_dedup.spans(docs, closing=True).collect():
        seen, more = np.frombuffer(r["runs"], substring_dedup._OCCURRENCE), np.frombuffer(r["tails"], substring_dedup._TAIL)
        made |= {tuple(x) for x in seen.tolist()} | {(*seen[k].tolist()[:2], longer) for k, longer, _ in more.tolist()}
    want = set()
    for k, own in enumerate(sizes):
        fits = lambda a, b, own=own: sum(own[a:b]) >= 25 and (b - a > 1 or own[a] >= 50)
        for i in range(len(own)):
            want |= {(k, i, b - i) for b in range(i + 1, len(own) + 1) if fits(i, b) and not any(fits(i, c) for c in range(i + 1, b))}
            want |= {(k, a, i + 1 - a) for a in range(i + 1) if fits(a, i + 1) and not any(fits(c, i + 1) for c in range(a + 1, i + 1))}
    assert made == want
    assert substring_dedup.spans(docs.where(F.lit(False)), closing=True).count() == 0


def test_many_copies_of_a_passage(spark, monkeypatch):
    """One passage in hundreds of documents of many blocks: it stays in the first alone, and
    what is joined grows with the blocks that have it, not with its copies."""
    rng = random.Random(3)
    passage = " ".join(_sentence(rng, n) for n in (9, 12, 8, 20, 6, 30, 4))
    rows = [(k, f"{_sentence(rng, 30)} {passage} {_sentence(rng, 28)}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(docs, closing=True).collect()}
    assert got == {k: text if k == 0 else text.replace(passage + " ", "") for k, text in rows}
    found = substring_dedup.spans(docs, closing=True)
    blocks = found.select("block").distinct().count()
    most = found.groupBy("h1", "h2").count().agg(F.max("count")).first()[0]
    assert blocks < 10 and most <= blocks


def test_structured_passages_differ(spark):
    """Two runs of two words, in the order of a Thue-Morse word and of its complement."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(k, f"{_sentence(random.Random(k), 30)} {' '.join(('ab', 'ba')[b ^ k] for b in bits)}. End of it all.") for k in (0, 1)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), closing=True).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == rows
