"""Deduplication against brute force, on hard and on planted cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components, exact_dedup, near_dedup, substring_dedup

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mph_is_minimal_and_perfect():
    for n in (1, 2, 3, 17, 500, 5000):
        d = np.frombuffer(b"".join(hashlib.sha256(bytes([k % 256, k // 256, n % 251])).digest() for k in range(n)), np.uint64).reshape(-1, 4)
        slots = exact_dedup.mph_slots(exact_dedup.build_mph(d), n, d)
        assert sorted(slots.tolist()) == list(range(n))


def _exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_exact(hard, nothing):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    want = _exact(rows)
    got = sorted(map(str, ((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.exact_dedup(hard).collect())))
    assert got == sorted(str((i, *want[t or ""], hashlib.sha256((t or "").encode()).hexdigest())) for i, t in rows)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_history(spark):
    """A kept index over several loads: members, nonmembers, winners of either side."""
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, index = exact_dedup.load(frame([(5, "a"), (6, "a"), (1, "b"), (None, "n")]))
    assert first.count() == 4
    second, index = exact_dedup.load(frame([(2, "a"), (9, "b"), (3, "c"), (4, "c"), (7, "n")]), index)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in second.collect()}
    assert got == {2: (6, 3, False), 9: (9, 2, True), 3: (4, 2, False), 4: (4, 2, True), 7: (7, 2, True)}
    third, index = exact_dedup.load(frame([(-(2**63), "low"), (8, "c")]), index)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in third.collect()} == {-(2**63): (-(2**63), 1), 8: (8, 3)}


def test_history_of_many_loads(spark, monkeypatch):
    """Generations are merged and buckets dealt anew; winners and copies stay right."""
    monkeypatch.setattr(exact_dedup, "BUCKET_DIGESTS", 2)
    monkeypatch.setattr(exact_dedup, "bucket_count", lambda rows: max(3, rows // 2))
    docs = [(k * 37 % 1000, f"text {k * k % 211}") for k in range(240)]
    index, seen = None, []
    for part in range(0, 240, 80):
        rows = docs[part : part + 80]
        seen += rows
        result, index = exact_dedup.load(spark.createDataFrame(rows, "doc_id long, text string"), index)
        want = _exact(seen)
        assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in result.collect()} == {i: want[t] for i, t in rows}
    held = index.agg({"n": "sum", "buckets": "max", "generation": "max"}).first().asDict()
    assert held["sum(n)"] == len({t for _, t in docs}) and held["max(buckets)"] > 3


def test_generations_merge():
    """A bucket of more loads than MOST_GENERATIONS has one generation again."""
    import pandas as pd

    index = pd.DataFrame(columns=exact_dedup._INDEX_NAMES)
    for k in range(exact_dedup.MOST_GENERATIONS + 1):
        digests = [hashlib.sha256(f"{k} {j}".encode()).digest() for j in range(5)] + [hashlib.sha256(b"in all").digest()]
        rows = pd.DataFrame({"digest": digests, "winner": pd.Series([k] * 6, dtype="Int64"), "copies": 1, "buckets": 1, "bucket": 0})
        index = exact_dedup._extend(rows, index)
        assert len(index) == (k + 1 if k < exact_dedup.MOST_GENERATIONS else 1)
    got = exact_dedup._look_up(rows, index).set_index("digest")
    assert got.loc[digests[-1], "keep_id"] == k and got.loc[digests[-1], "group_size"] == k + 1 and index["n"].sum() == 5 * (k + 1) + 1


def _shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _near(rows):
    sets = [(i, _shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x[1] and y[1] and (x[0] == y[0] is not None or 100 * len(x[1] & y[1]) >= 75 * len(x[1] | y[1])):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def test_near(hard, nothing):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in near_dedup.near_components(hard).collect())
    assert got == sorted(map(str, _near(rows)))
    assert near_dedup.near_components(nothing).count() == 0


def test_near_large_family(spark):
    """A family of edited copies, some linked only through others, some with none."""
    rng = np.random.default_rng(2)
    base, rows = prose(11, 150).split(), []
    for i in range(300):
        w = list(base)
        for p in rng.choice(len(w), rng.integers(0, 12), replace=False):
            w[p] = f"edit{rng.integers(0, 40)}"
        rows.append((int(i), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(df).collect())
    assert got == sorted(_near(rows))


def test_estimate_is_corrected():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.75, 1.0):
        n = 3000
        both = int(2 * n * share / (1 + share))
        common = rng.integers(0, 2**64, both, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((common, rng.integers(0, 2**64, n - both, dtype=np.uint64)))) for _ in range(2))
        regs = [near_dedup.registers(1, np.zeros(len(x), np.int64), x) for x in (a, b)]
        guess = near_dedup.estimate(*regs, np.array([n]), np.array([n]))[0]
        assert guess == pytest.approx(both / (2 * n - both), abs=0.16)


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 400)] + [(1000, 1001), (1002, 1001), (7, 7), (5000, 5000)]
    df = spark.createDataFrame(chain, "u long, v long").repartition(3)
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert all(got[k] == 0 for k in range(401)) and got[1002] == 1000 and 5000 not in got
    assert components.components(df.where(F.lit(False))).count() == 0


def _sentences(text):
    """(start, end, words) of each sentence, in plain code."""
    found = list(WORD.finditer(text))
    out = []
    for k, m in enumerate(found):
        w = m.group()
        lead = w[0]
        new = k == 0 or "\n" in text[found[k - 1].end() : m.start()] or found[k - 1].group()[-1] in ".!?" or "A" <= lead <= "Z" or ("À" <= lead <= "Þ" and lead != "×")
        if new:
            out.append([m.start(), [w]])
        else:
            out[-1][1].append(w)
    return [(s, out[k + 1][0] if k + 1 < len(out) else len(text), w) for k, (s, w) in enumerate(out)]


def _substrings(rows, least=substring_dedup.MIN_WORDS):
    first, spans, parts = {}, [], {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        own = parts[i] = _sentences(t or "")
        for a in range(len(own)):
            n, b = 0, a
            while b < len(own) and (n < least or (b - a < 2 and n < 2 * least and not (b - a == 1 and n >= 2 * least))):
                if b - a == 1 and n >= 2 * least:
                    break
                n += len(own[b][2])
                b += 1
            if n >= least and (b - a >= 2 or n >= 2 * least):
                key = tuple(w for s in own[a:b] for w in s[2])
                first[key] = min(first.get(key, (i, a)), (i, a))
                spans.append((key, i, a, b))
    gone = {}
    for key, i, a, b in spans:
        if (i, a) != first[key]:
            gone.setdefault(i, set()).update(range(a, b))
    out = []
    for i, t in rows:
        own, drop, t = parts.get(i, []), gone.get(i, set()), t or ""
        if drop:
            t = t[: own[0][0]] + "".join(t[s:e] for k, (s, e, _) in enumerate(own) if k not in drop) if len(drop) < len(own) else ""
        out.append((i, t))
    return out


def test_substrings(hard, nothing):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    got = sorted(map(str, ((r["doc_id"], r["text"]) for r in substring_dedup.substring_dedup(hard).collect())))
    assert got == sorted(map(str, _substrings(rows)))
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_pasted_passage(hard):
    """The passage is gone from the second text, what surrounds it is not."""
    text = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(hard).collect()}
    passage = prose(9, 80)
    assert passage[:200] in text[10] and passage[:200] not in text[11] and passage[100:300] not in text[11]
    assert text[11].startswith(prose(5, 60)[:100]) and prose(6, 60)[100:300] in text[11]
