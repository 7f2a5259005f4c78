"""Pattern packing by non-negative least squares.

Documents become ids with an end-of-document id; those longer than a sequence are cut
into full pieces after a first one that may be shorter.  What is then packed is a
histogram of lengths, as large as a sequence is long, whatever the number of documents:
patterns of one to three lengths that fill a sequence are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares and rounded down, and the
residual lengths are packed best-fit, longest first.  Of a few parts of the fitted counts the
one that needs fewest sequences is taken.  Pieces find their place by their
rank among those of their length, so no group of pieces is ever gathered.

Rules: null text counts as empty, a document of the end id alone.  A special token's string
in a text is that token, as the public library has it.  Rows that share a doc_id are
documents of their own.  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, strings_of
from .tokens import byte_bpe, default_vocabulary

SEQUENCE, END_ID = 1024, 2
#: Rounds of the fit at most, and patterns that may join in one.
ROUNDS, JOIN = 400, 24
#: Parts of the fitted counts that are tried, most first, before the rest is packed best-fit.
SHARES = (1.0, 0.95, 0.9, 0.8, 0.65, 0.5, 0.3, 0.1, 0.0)
#: Pieces of a length are ranked in so many parts at least.
PARTS = 64
PIECES_A_PART = 1_000_000


# --------------------------------------------------------------------------- the plan
def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All sets of two or three of the lengths that fill ``size`` exactly, as rows with
    a zero in place of a missing third."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    out = []
    for a in lengths[::-1]:
        b = lengths[(lengths <= a) & (lengths <= size - a)]
        c = size - a - b
        ok = (c <= b) & ((c == 0) | have[np.minimum(c, size)])
        if ok.any():
            out.append(np.column_stack((np.full(ok.sum(), a), b[ok], c[ok])))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit_counts(rows: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative repeat counts x that make the patterns' lengths meet the histogram in
    least squares.

    An active-set method: the patterns whose gradient is steepest join the active ones in
    blocks, those solve the normal equations, and the ones that would be negative leave.  It
    ends when no gradient is left, or when even one pattern gains nothing; at most as many patterns
    as there are lengths repeat, so that rounding loses little."""
    size, use, thirds = len(histogram), (rows > 0).astype(float), np.ascontiguousarray(rows.T)
    b = histogram.astype(float)
    b[0] = 0.0
    tall = max(1.0, float(b.max(initial=0.0)))
    def columns(own: np.ndarray) -> np.ndarray:
        out = np.zeros((size, len(own)))
        np.add.at(out, (rows[own].ravel(), np.repeat(np.arange(len(own)), rows.shape[1])), use[own].ravel())
        return out

    x, active, lost = np.zeros(len(rows)), np.zeros(0, np.int64), float(b @ b)
    held, products = columns(active), np.zeros((0, 0))
    residual, join = b, JOIN
    for _ in range(rounds):
        # No piece has length 0, so a missing third adds nothing.
        steep = sum(residual[c] for c in thirds)
        steep[active] = -np.inf
        # The steepest, ties in the order of the patterns.
        new = np.flatnonzero(steep >= np.partition(steep, -join)[-join])[: 4 * join] if join < len(steep) else np.arange(len(steep))
        new = new[np.argsort(-steep[new], kind="stable")][:join]
        new = new[steep[new] > 1e-9 * tall]
        if not len(new):
            break
        # Of the products of columns only those with new ones are made.
        more = columns(new)
        own, a, across = np.concatenate((active, new)), np.concatenate((held, more), 1), held.T @ more
        g, left = np.block([[products, across], [across.T, more.T @ more]]), b
        while len(own):
            z = np.linalg.solve(g + 1e-9 * np.eye(len(own)), a.T @ b)
            keep = z > 1e-9 * tall
            if keep.all():
                left = b - a @ z
                break
            own, a, g = own[keep], a[:, keep], g[np.ix_(keep, keep)]
        if left @ left >= lost * (1 - 1e-6):
            # A block can be in its own way; one pattern alone cannot.
            if join == 1:
                break
            join //= 2
            continue
        active, held, products, residual, lost = own, a, g, left, float(left @ left)
        x[:] = 0
        x[own] = z
    return x


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that pack the counts ``left``, longest first, each piece into the
    sequence with the least sufficient room; equal sequences are handled together."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        at = length
        while n and at <= size:
            if not room[at]:
                at += 1
                continue
            pattern, repeats = room[at].pop()
            take = min(n, repeats)
            if take < repeats:
                room[at].append((pattern, repeats - take))
            room[at - length].append(((*pattern, length), take))
            n -= take
            at = min(at, at - length) if at - length >= length else at
        if n:
            fill = size // length
            whole, rest = divmod(n, fill)
            if whole:
                room[size - fill * length].append(((length,) * fill, whole))
            if rest:
                room[size - rest * length].append(((length,) * rest, 1))
    return [x for own in room for x in own]


class Plan:
    """Where the r-th piece of a length goes: parallel arrays sorted by (length, rank)."""

    def __init__(self, histogram: np.ndarray, size: int = SEQUENCE):
        start = histogram.astype(np.int64).copy()
        whole = [((size,), int(start[size]))] if start[size] else []
        start[size] = 0
        lengths = np.flatnonzero(start)
        rows = patterns(lengths, size) if len(lengths) else np.zeros((0, 3), np.int64)
        fitted = fit_counts(rows, start) if len(rows) else np.zeros(0)
        best: tuple[int, int, list] | None = None
        for share in SHARES if len(rows) else (0.0,):
            # Rounded down: what is short of a whole sequence is packed with the residuals.
            chosen, left = list(whole), start.copy()
            x = np.floor(share * fitted).astype(np.int64)
            for k in np.argsort(-x, kind="stable"):
                if x[k] <= 0:
                    break
                parts = [int(v) for v in rows[k] if v]
                fits = min(int(left[v]) // parts.count(v) for v in parts)
                if repeats := min(int(x[k]), fits):
                    for v in parts:
                        left[v] -= repeats
                    chosen.append((tuple(parts), repeats))
            by_pattern = int((start - left).sum())
            chosen += best_fit(left, size)
            total = sum(repeats for _, repeats in chosen)
            # Of equal plans, the one with most by patterns.
            if best is None or total < best[0]:
                best = total, by_pattern, chosen
        #: Pieces that patterns place; whole sequences aside, the others are residuals.
        _, self.by_pattern, chosen = best
        used = np.zeros(size + 1, np.int64)
        out, sequence = [], 0
        for parts, repeats in chosen:
            offset = 0
            for v in sorted(set(parts), reverse=True):
                m = parts.count(v)
                out.append((v, used[v], m, sequence, offset))
                used[v] += m * repeats
                offset += m * v
            sequence += repeats
        self.sequences, self.used = sequence, used
        self.rows = np.array(sorted(out), np.int64).reshape(-1, 5)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces given by length and rank from 0."""
        # Rows of a length are consecutive; within them ranks ascend.
        order = np.lexsort((rank, length))
        at = np.empty(len(order), np.int64)
        low, high = np.searchsorted(self.rows[:, 0], length[order]), np.searchsorted(self.rows[:, 0], length[order], "right")
        found = np.empty(len(order), np.int64)
        for v in np.unique(length):
            mine = length[order] == v
            a, b = low[mine][0], high[mine][0]
            found[mine] = a + np.searchsorted(self.rows[a:b, 1], rank[order][mine], "right") - 1
        at[order] = found
        row = self.rows[at]
        q = rank - row[:, 1]
        return row[:, 3] + q // row[:, 2], row[:, 4] + q % row[:, 2] * row[:, 0]


# --------------------------------------------------------------------------- pieces
def pieces(docs: DataFrame, size: int = SEQUENCE, end_id: int = END_ID, vocabulary: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; with ``with_ids`` also its ids."""
    path, pattern = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = byte_bpe(path, pattern).encode_special
        for batch in batches:
            for a, _, texts in strings_of(batch.column(1)):
                doc, piece, start, length, crc, raw = [], [], [], [], [], []
                for k, text in enumerate(texts, a):
                    ids = encode(text) + end
                    n = len(ids) // 4
                    at, p = 0, 0
                    while at < n:
                        to = at + ((n - 1) % size + 1 if p == 0 else size)
                        part = ids[4 * at : 4 * to]
                        doc.append(k), piece.append(p), start.append(at), length.append(to - at), crc.append(zlib.crc32(part))
                        if with_ids:
                            raw.append(part)
                        at, p = to, p + 1
                columns = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def ranked(cut: DataFrame, rows: int) -> DataFrame:
    """``cut`` with ``rank``: each piece's number among those of its length, from 0."""
    parts = max(PARTS, -(-rows // PIECES_A_PART))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    own = Window.partitionBy("length", "part")
    sizes = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    numbered = cut.withColumn("own", F.row_number().over(own.orderBy("doc_id", "piece", "ids_crc32")) - 1)
    return numbered.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("own")).drop("base", "own", "part")


def pack(docs: DataFrame, size: int = SEQUENCE, end_id: int = END_ID, vocabulary: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; with
    ``with_ids`` also its ids, so that a sequence's pieces by offset are its tokens."""
    cut = staged(pieces(docs, size, end_id, vocabulary, with_ids), "pieces")
    histogram = np.zeros(size + 1, np.int64)
    # At most ``size`` rows, whatever the table.
    for row in cut.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    plan = Plan(histogram, size)

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            sequence, offset = plan.place(length, rank)
            kept = [k for k, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[k] for k in kept), "sequence_id", "offset"])

    placed = ranked(cut, int(histogram.sum()))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "rank"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return placed.select(*columns).mapInArrow(run, schema)
