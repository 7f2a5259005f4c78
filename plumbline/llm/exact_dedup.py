"""Exact deduplication by a minimal perfect hash over historical distinct digests.

History is an index table that is written and kept.  A row of it is a generation of a
bucket of digests: displacement values of a minimal perfect hash, and slots that hold the
full SHA-256 digest, the winner's locator (its doc_id) and the number of copies.  A load
of documents extends it: each distinct digest of the load goes to its bucket, is hashed to the
one slot of each generation it can be in and compared there byte by byte.  Members change
their slot's winner; nonmembers group among themselves and become the bucket's next
generation.  Every row then takes its winner from the slot of its digest.

A table without history is read as two loads, by a hash of doc_id: the first one is the
history of the second.

Buckets are counted when an index is made and written in it.  Generations of a bucket
are merged after MOST_GENERATIONS; an index of more than GROWN times the digests it was
made for is dealt into more buckets, so that a bucket stays in bounds however long the
history gets.

Rules: null text counts as empty.  Of equal texts the largest doc_id stays; a
null doc_id wins only where no copy has an id.  Rows that share an id and a text
are copies of one row: each counts in ``group_size`` and all are marked like it.
An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, staged, texts_of

#: Distinct digests of a bucket, on average; 0.2 MB of index.
BUCKET_DIGESTS = 4096
MOST_GENERATIONS, GROWN = 8, 4
_U = np.uint64
_INDEX = "buckets int, bucket int, generation int, n int, displacement binary, digests binary, winners binary, known binary, copies binary"
_SLOTS = "digest binary, winner long, copies long"


def _moved(b: np.ndarray, c: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (mix64(b + d * (c | _U(1))) % _U(n)).astype(np.int64)


def build_mph(digests: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash of n distinct digests (rows of four uint64).

    Keys fall into n/4 cells.  From the fullest cell down, the first displacement d is
    taken that sends all its keys ``mix(b + d * c) mod n`` to free slots; a cell of one key
    stores its slot itself, as ``-1 - slot``.
    """
    n = len(digests)
    cells = max(1, -(-n // 4))
    cell = (digests[:, 0] % _U(cells)).astype(np.int64)
    out, free = np.zeros(cells, np.int64), np.ones(n, bool)
    order, size = np.argsort(cell, kind="stable"), np.bincount(cell, minlength=cells)
    start = np.concatenate(([0], np.cumsum(size)))
    for c in np.argsort(-size, kind="stable"):
        if size[c] < 2:
            break
        keys = digests[order[start[c] : start[c + 1]]]
        tried = 0
        while True:
            d = np.arange(tried, tried + 64, dtype=_U)
            slot = _moved(keys[None, :, 1], keys[None, :, 2], d[:, None], n)
            ok = free[slot].all(1)
            if len(keys) > 1:
                ranked = np.sort(slot, 1)
                ok &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
            if ok.any():
                k = int(np.argmax(ok))
                out[c], free[slot[k]] = tried + k, False
                break
            tried += 64
            if tried > 1 << 22:
                raise ValueError("no displacement found: the digests are not distinct")
    single = np.flatnonzero(size == 1)
    out[single] = -1 - np.flatnonzero(free)[: len(single)]
    return out


def mph_slots(displacement: np.ndarray, n: int, digests: np.ndarray) -> np.ndarray:
    """The one slot in which each digest can be."""
    d = displacement[(digests[:, 0] % _U(len(displacement))).astype(np.int64)]
    return np.where(d < 0, -1 - d, _moved(digests[:, 1], digests[:, 2], np.maximum(d, 0).astype(_U), n))


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), _U).reshape(-1, 4)


def _generation(rows: pd.DataFrame, buckets: int, bucket: int, generation: int) -> dict:
    """The index row of distinct digests (digest, winner, copies)."""
    digests = _words(rows["digest"])
    displacement = build_mph(digests)
    slot = mph_slots(displacement, len(digests), digests)
    place = np.empty(len(slot), np.int64)
    place[slot] = np.arange(len(slot))
    winner = rows["winner"].astype("Int64").iloc[place]
    return {
        "buckets": buckets, "bucket": bucket, "generation": generation, "n": len(slot), "displacement": displacement.tobytes(), "digests": digests[place].tobytes(),
        "winners": winner.fillna(0).to_numpy(np.int64).tobytes(), "known": winner.notna().to_numpy().tobytes(), "copies": rows["copies"].to_numpy(np.int64)[place].tobytes(),
    }


class _Slots:
    """A generation in memory."""

    def __init__(self, x):
        self.n, self.displacement, self.digests = x.n, np.frombuffer(x.displacement, np.int64), np.frombuffer(x.digests, _U).reshape(-1, 4)
        self.winners, self.known, self.copies = np.frombuffer(x.winners, np.int64).copy(), np.frombuffer(x.known, bool).copy(), np.frombuffer(x.copies, np.int64).copy()

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The one slot each digest can be in, and whether its bytes are there."""
        slot = mph_slots(self.displacement, self.n, digests)
        return slot, (self.digests[slot] == digests).all(1)

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"digest": [x.tobytes() for x in self.digests], "winner": pd.Series(self.winners, dtype="Int64").where(self.known), "copies": self.copies})


_INDEX_NAMES = [x.split()[0] for x in _INDEX.split(", ")]


def _extend(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """A bucket's generations after a load of distinct digests."""
    if not len(rows):
        return index[_INDEX_NAMES]
    buckets, bucket = int(rows["buckets"].iloc[0]), int(rows["bucket"].iloc[0])
    digests, old = _words(rows["digest"]), np.zeros(len(rows), bool)
    winner, copies = rows["winner"].astype("Int64"), rows["copies"].to_numpy(np.int64)
    value, known = winner.fillna(0).to_numpy(np.int64), winner.notna().to_numpy()
    out, held = [], []
    for x in index.sort_values("generation").itertuples():
        own = _Slots(x)
        slot, hit = own.find(digests)
        at = slot[hit]
        later = known[hit] & (~own.known[at] | (value[hit] > own.winners[at]))
        own.winners[at] = np.where(later, value[hit], own.winners[at])
        own.known[at] |= known[hit]
        own.copies[at] += copies[hit]
        old |= hit
        held.append(own)
        out.append(x._asdict() | {"winners": own.winners.tobytes(), "known": own.known.tobytes(), "copies": own.copies.tobytes()})
    if not old.all():
        new = rows.loc[~old, ["digest", "winner", "copies"]]
        if len(out) < MOST_GENERATIONS:
            out.append(_generation(new, buckets, bucket, len(out)))
        else:
            out = [_generation(pd.concat([*(h.rows() for h in held), new], ignore_index=True), buckets, bucket, 0)]
    return pd.DataFrame(out)[_INDEX_NAMES]


def _first(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([_generation(rows, int(rows["buckets"].iloc[0]), int(rows["bucket"].iloc[0]), 0)])[_INDEX_NAMES]


def _look_up(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Winner and copies of each distinct digest that the index has."""
    digests = _words(rows["digest"]) if len(rows) else np.zeros((0, 4), _U)
    out = []
    for x in index.itertuples():
        own = _Slots(x)
        slot, hit = own.find(digests)
        at = slot[hit]
        out.append(pd.DataFrame({"digest": rows.loc[hit, "digest"], "keep_id": pd.Series(own.winners[at], index=rows.index[hit], dtype="Int64").where(own.known[at]), "group_size": own.copies[at]}))
    return pd.concat(out) if out else pd.DataFrame({"digest": [], "keep_id": pd.Series([], dtype="Int64"), "group_size": pd.Series([], dtype="int64")})


def _unpack(frames):
    for x in frames:
        for row in x.itertuples():
            yield _Slots(row).rows()


def digests_of(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row; texts do not leave the scan."""
    return texts_of(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))


def _dealt(distinct: DataFrame, buckets: int) -> DataFrame:
    return distinct.select("digest", "winner", "copies", F.lit(buckets).cast("int").alias("buckets"), F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"))


def distinct_digests(digests: DataFrame, buckets: int) -> DataFrame:
    """One row for each digest, aggregated before the shuffle, so hot texts cost one row a task."""
    return _dealt(digests.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies")), buckets)


def bucket_count(rows: int) -> int:
    return max(64, -(-rows // BUCKET_DIGESTS))


def build_index(digests: DataFrame, rows: int) -> DataFrame:
    """An index table of (doc_id, digest) rows, with buckets for ``rows`` of them."""
    return distinct_digests(digests, bucket_count(rows)).groupBy("bucket").applyInPandas(_first, _INDEX)


def _size(index: DataFrame) -> tuple[int, int]:
    """Buckets the index is dealt into (0 if it is empty) and digests it holds."""
    row = index.agg(F.coalesce(F.max("buckets"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return row[0], row[1]


def extend(index: DataFrame, digests: DataFrame) -> DataFrame:
    """``index`` after a load of (doc_id, digest) rows; it can be written and kept."""
    buckets, held = _size(index)
    if not buckets:
        return build_index(digests, digests.count())
    if held > GROWN * BUCKET_DIGESTS * buckets:
        buckets = bucket_count(held)
        slots = index.select(*_INDEX_NAMES).mapInPandas(_unpack, _SLOTS)
        index = staged(_dealt(slots, buckets).groupBy("bucket").applyInPandas(_first, _INDEX), "index")
    return distinct_digests(digests, buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_extend, _INDEX)


def look_up(digests: DataFrame, index: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of each different digest of the rows that ``index`` has."""
    own = distinct_digests(digests, max(1, _size(index)[0]))
    return own.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_look_up, "digest binary, keep_id long, group_size long")


def load(docs: DataFrame, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The result for every row of ``docs`` (see exact_dedup), and the index with them in it."""
    rows = staged(digests_of(docs), "digests")
    if index is None:
        second = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1, F.lit(False))
        index, incoming = staged(build_index(rows.where(~second), rows.count()), "history"), rows.where(second)
    else:
        incoming = rows
    index = staged(extend(index, incoming), "index")
    # Both sides are dealt by the join alone, so a hot digest's rows can be split.
    joined = rows.join(staged(look_up(rows, index), "winners"), "digest")
    result = joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return result, index


def exact_dedup(docs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``.

    ``index``: history, as build_index() or load() made it; its texts count as copies, and
    its doc_ids can win.  ``kept``: the row is its group's winner.
    """
    return load(docs, index)[0]
