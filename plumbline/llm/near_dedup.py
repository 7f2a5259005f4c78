"""Near-duplicate groups by HyperMinHash.

A text's set is its distinct five-word shingles (A-Z lower-cased; with fewer words the
whole sequence is one shingle).  One hash of each shingle names a bucket and a value;
a bucket keeps its least value as a leading-zero count and mantissa bits, 16 bits a
register.  Empty registers borrow from the first full one in a fixed order of their own.
Four registers make a band; texts that share a band are candidates.  Candidates are
compared by register agreement, corrected for chance collisions, and what remains is
confirmed on the full sets.

Groups of any size stay linear.  Equal sets are one class with one representative.
Each representative is first confirmed against one smallest member of its bands.  Members
of a band that are then still in different components are compared in blocks of bounded
size (see links_across), exactly and without a cap; a block gives back a spanning set of
links instead of all pairs.

Rules: null text counts as empty; texts without a word are linked with nothing and keep
their own id.  Rows that share a doc_id are one node.  A null doc_id takes the component
of equal texts, else null.  An empty table gives an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, pieces_of, staged, texts_of
from .components import components

SHINGLE = 5
#: Registers, bits that name one, and mantissa bits of one.
REGISTERS, BUCKET_BITS, MANTISSA = 128, 7, 10
BAND = 4
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Texts of a block, and shingles of a strip of its incidence matrix.
BLOCK, STRIP = 256, 2048
#: 16 MB or so as a hash table of longs.
MOST_BROADCAST_IDS = 1_000_000
#: Candidates whose estimate is lower are not confirmed: five standard errors under 0.75.
ESTIMATE_FLOOR = 0.75 - 5 * (0.75 * 0.25 / REGISTERS) ** 0.5
_U = np.uint64
_SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, registers binary, bands array<long>"
#: For each register the order in which it borrows from others.
_ORDER = np.stack([np.random.Generator(np.random.PCG64(7_000 + r)).permutation(REGISTERS) for r in range(REGISTERS)])
_NONE = np.iinfo(np.uint64).max


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, shingle hash), distinct and ordered by both."""
    words = Words(texts, lower=True)
    doc, value, _ = words.windows(SHINGLE, words.hashes())
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def registers(n_texts: int, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The compressed registers of each text, uint16; zeros for texts without shingles."""
    least = np.full(n_texts * REGISTERS, _NONE, _U)
    np.minimum.at(least, doc * REGISTERS + (value & _U(REGISTERS - 1)).astype(np.int64), value >> _U(BUCKET_BITS))
    least = least.reshape(n_texts, REGISTERS)
    full = least != _NONE
    some = full.any(1)
    row, reg = np.nonzero(~full & some[:, None])
    filled, step = least.copy(), 0
    while len(row):
        other = _ORDER[reg, step]
        hit = full[row, other]
        # Lenders are tried in an order of the register's own, so two texts borrow alike.
        filled[row[hit], reg[hit]] = least[row[hit], other[hit]]
        row, reg, step = row[~hit], reg[~hit], step + 1
    fraction, exponent = np.frexp(filled.astype(np.float64))
    zeros = (64 - BUCKET_BITS) - np.minimum(exponent, 64 - BUCKET_BITS)
    mantissa = np.floor((fraction * 2 - 1).clip(0) * (1 << MANTISSA)).astype(np.int64)
    out = (zeros.astype(np.int64) << MANTISSA | mantissa) & 0xFFFF
    return np.where(some[:, None], out, 0).astype("<u2")


def bands(regs: np.ndarray) -> np.ndarray:
    """One key for each band of four registers."""
    keys = regs.view("<u8").reshape(len(regs), -1)
    salt = np.arange(1, keys.shape[1] + 1, dtype=_U) * _U(0xA24BAED4963EE407)
    x = keys ^ salt
    x = (x ^ (x >> _U(32))) * _U(0x9FB21C651E98DF25) + salt
    return (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The probability that registers of two unrelated sets agree: the same leading-zero
    count under both bucket loads, and the same mantissa."""
    level = np.arange(0, 64 - BUCKET_BITS)[:, None]

    def at(n: np.ndarray) -> np.ndarray:
        load = np.maximum(n / REGISTERS, 1.0)[None, :]
        return np.exp(load * np.log1p(-(2.0 ** -(level + 1)))) - np.where(level == 0, 0.0, np.exp(load * np.log1p(-np.minimum(2.0**-level, 1 - 1e-12))))

    return (at(n_a) * at(n_b)).sum(0) / (1 << MANTISSA)


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of pairs of register rows."""
    agree, by_chance = (regs_a == regs_b).mean(1), chance(n_a, n_b)
    return ((agree - by_chance) / (1 - by_chance)).clip(0, 1)


def _sign(batches):
    for batch in batches:
        ids = batch.column(0)
        for a, b, texts in pieces_of(batch.column(1)):
            doc, value = shingle_sets(texts)
            regs = registers(b - a, doc, value)
            at = np.searchsorted(doc, np.arange(b - a + 1))
            count = np.diff(at)
            whole = [hashlib.blake2b(value[x:y].tobytes(), digest_size=16).digest() if y > x else None for x, y in zip(at[:-1], at[1:], strict=True)]
            key = np.frombuffer(b"".join(w or bytes(16) for w in whole), "<i8").reshape(-1, 2)
            none = count == 0
            keys = bands(regs).view(np.int64)
            each = np.where(none, 0, keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a),
                    pa.array(count.astype(np.int64)),
                    pa.array(key[:, 0], mask=none),
                    pa.array(key[:, 1], mask=none),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))).astype(np.int32)), pa.array(keys[~none].ravel())),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "registers", "bands"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set key, registers and band keys of every row."""
    return texts_of(docs).mapInArrow(_sign, _SIGNATURES)


def _sets(batches):
    for batch in batches:
        ids = batch.column(0)
        for a, b, texts in pieces_of(batch.column(1)):
            doc, value = shingle_sets(texts)
            at = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(value.view(np.int64)))], names=["doc_id", "shingles"])


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles): the whole sets of the documents in ``ids``, built anew.

    Up to MOST_BROADCAST_IDS ids go to the texts; more are joined by shuffle."""
    ids = staged(ids, "ids")
    if ids.count() <= MOST_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return staged(texts_of(docs).join(ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles array<long>"), "sets")


def _likely(batches):
    for batch in batches:
        n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        if not len(n_a):
            continue
        regs = [np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (4, 5)]
        guess = estimate(*regs, n_a, n_b)
        ok = guess >= ESTIMATE_FLOOR
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok)), pa.array(guess[ok])], names=["u", "v", "guess"])


def linked(shared, n_a, n_b):
    """The contract's bound on sets of n_a and n_b shingles that share so many."""
    return (shared > 0) & (100 * shared >= SIMILAR * (n_a + n_b - shared))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of an Arrow list column."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False), bounds


def _confirm(batches):
    for batch in batches:
        (x, at), (y, bt) = _lists(batch.column(2)), _lists(batch.column(3))
        ok = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            both = np.concatenate((x[at[k] : at[k + 1]], y[bt[k] : bt[k + 1]]))
            both.sort()
            ok[k] = linked(int((both[1:] == both[:-1]).sum()), at[k + 1] - at[k], bt[k + 1] - bt[k])
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["u", "v"])


def likely_pairs(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """(u, v, guess) of the pairs whose sizes and estimate allow a link."""
    of = signed.select("doc_id", "n_shingles", "registers")
    a, b = of.toDF("u", "n_u", "r_u"), of.toDF("v", "n_v", "r_v")
    joined = pairs.select("u", "v").join(a, "u").join(b, "v").where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * SIMILAR)
    return joined.select("u", "v", "n_u", "n_v", "r_u", "r_v").mapInArrow(_likely, "u long, v long, guess double")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are linked."""
    pairs = staged(pairs.select("u", "v"), "pairs")
    full = full_sets(docs, pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct())
    a, b = full.toDF("u", "s_u"), full.toDF("v", "s_v")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "s_u", "s_v").mapInArrow(_confirm, "u long, v long")


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between different components within two blocks, as few as join what they join."""
    component = rows["component"].to_numpy()
    size = rows["shingles"].map(len).to_numpy()
    value = np.concatenate(rows["shingles"].to_list())
    owner = np.repeat(np.arange(len(rows)), size)
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    # A shingle of one text is shared by none.
    common = count > 1
    number = np.cumsum(common) - 1
    keep = common[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(rows), len(rows)), np.float32)
    for start in range(0, int(common.sum()), STRIP):
        x, y = np.searchsorted(column, (start, start + STRIP))
        strip = np.zeros((len(rows), min(STRIP, int(common.sum()) - start)), np.float32)
        strip[owner[x:y], column[x:y] - start] = 1.0
        shared += strip @ strip.T
    hit = linked(shared.astype(np.int64), size[:, None], size[None, :]) & (component[:, None] < component[None, :])
    root = {c: c for c in np.unique(component).tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(hit), strict=True):
        a, b = find(component[i]), find(component[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((a, b))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def links_across(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Links (between component names) that bands (band, doc_id, component) still allow.

    A text of whose shingles under three quarters occur in a second text of these bands can
    be linked with none, and is left out.  The rest falls into groups that share bands;
    every two blocks of a group meet in a task of bounded size, which compares all their
    texts by one product of incidence matrices and returns a spanning set of links.
    """

    def mixed(rows: DataFrame) -> DataFrame:
        # Written first: the join then deals both sides itself, and can split a hot band.
        several = staged(rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band"), "several")
        return rows.join(several, "band", "left_semi")

    left = staged(mixed(placed), "mixed")
    full = full_sets(docs, left.select("doc_id").distinct())
    seen = full.select("doc_id", F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    alone = seen.where("n = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))
    able = full.select("doc_id", F.size("shingles").alias("n")).join(alone, "doc_id", "left").where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= SIMILAR * F.col("n")).select("doc_id")
    left = staged(mixed(left.join(able, "doc_id", "left_semi")), "able")

    first = staged(left.groupBy("band").agg(F.min("doc_id").alias("u")), "first")
    group = staged(components(left.join(first, "band").select("u", F.col("doc_id").alias("v"))).withColumnsRenamed({"node": "doc_id", "component": "group"}), "groups")
    sizes = group.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    member = left.select("doc_id", "component").distinct().join(group, "doc_id").join(sizes, "group")
    member = member.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "component")
    return dealt.join(full, "doc_id").select("group", "i", "j", "component", "shingles").groupBy("group", "i", "j").applyInPandas(_block_links, "u long, v long")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id of every row of ``docs``.

    ``component_id``: the smallest doc_id reachable over links; ``kept``: the row's id is
    that id; ``class_id``: the smallest doc_id with the same set.
    """
    signed = staged(signatures(docs), "signatures")
    # Written first, as other aggregates here: a join of two tables can split a hot key.
    classes = staged(signed.where("set_a is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class_id")), "sets-of")
    member = staged(signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.coalesce("class_id", F.when(F.col("set_a").isNull(), F.col("doc_id"))).alias("class_id")), "members")
    chosen = member.where("n_shingles > 0 and doc_id = class_id").select("doc_id").distinct()
    signed = staged(signed.join(chosen, "doc_id", "left_semi").select("doc_id", "n_shingles", "registers", "bands"), "classes")

    keyed = signed.select("doc_id", F.explode("bands").alias("band"))
    shared = staged(keyed.groupBy("band").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last")).where("center < last").select("band", "center"), "shared")
    buckets = staged(keyed.join(shared.hint("merge"), "band"), "bands")

    # One centre for each representative: its most alike.
    stars = buckets.where("doc_id > center").select(F.col("center").alias("u"), F.col("doc_id").alias("v")).distinct()
    tried = staged(likely_pairs(stars, signed), "stars")
    best = tried.groupBy("v").agg(F.max_by("u", F.struct("guess", F.negate("u"))).alias("u"))
    found = staged(components(confirmed(best, docs)), "components")

    # Members of a band that are in different components so far.
    placed = buckets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    more = links_across(docs, placed)
    last = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    out = member.join(last.withColumnRenamed("node", "class_id"), "class_id", "left")
    group = F.coalesce("component", "class_id", "doc_id")
    return out.select("doc_id", "n_shingles", group.alias("component_id"), F.col("doc_id").eqNullSafe(group).alias("kept"), "class_id")
