"""Substring deduplication by sliding spans of sentences.

Every run of consecutive sentences that just reaches MIN_WORDS words is hashed, joined
over all documents, and the sentences of every run but the first of its kind are
removed.  The first is that of the smallest (doc_id, place).  With ``closing``, as in the
query, so are the runs that just reach MIN_WORDS words backwards from each closing sentence:
a passage is removed up to its last sentence.  Such a run starts with a run of the first kind, which repeats
where it does; what follows that is its tail, and only tails of repeated runs are compared.

A sentence ends after a word that ends in ``. ! ?``, at a line feed, and before a word
that starts with a capital, so a pasted passage starts a sentence wherever it lies.
A run has two sentences at least; one of 2 * MIN_WORDS words is a run alone.  Runs
are equal when their words are (two 61-bit hashes, polynomials modulo a prime over 64-bit
hashes of the words); white space between does not count.

Rules: null text counts as empty.  Rows that share a doc_id are one document: a run is
first in all of them or in none.  Rows without a doc_id are neither compared nor
changed.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, pieces_of, run_hashes, staged, texts_of

MIN_WORDS = 25
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def sentences(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """The words, and the index of each sentence's first word."""
    w = Words(texts)
    if not len(w.start):
        return w, np.zeros(0, np.int64)
    new = np.ones(len(w.start), bool)
    lines = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(w.buf == 10, out=lines[1:])
    broken = lines[w.start[1:]] > lines[w.end[:-1]]
    lead, after = w.buf[w.start[1:]], w.buf[np.minimum(w.start[1:] + 1, len(w.buf) - 1)]
    capital = (lead >= 65) & (lead <= 90) | (lead == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
    new[1:] = broken | _ENDS[w.buf[w.end[:-1] - 1]] | capital
    return w, np.flatnonzero(new)


def runs(w: Words, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first sentence, index after the last) of each run."""
    n = len(first)
    end = np.append(first[1:], len(w.start))
    start = np.arange(n)
    last = np.searchsorted(end, first + min_words)
    alone = (last == start) & (end - first < 2 * min_words)
    last = last + alone
    ok = last < n
    start, last = start[ok], last[ok]
    same = w.doc[first[start]] == w.doc[first[last]]
    return start[same], last[same] + 1


def tails(w: Words, first: np.ndarray, start: np.ndarray, stop: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(which run, index after the last sentence) of each longer run from the start of a run
    that is the shortest to end where it ends."""
    end = np.append(first[1:], len(w.start))
    begin = np.searchsorted(first, end - min_words, side="right") - 1
    last = np.arange(len(first))
    begin = begin - ((begin == last) & (end - first < 2 * min_words))
    ok = begin >= 0
    begin, last = begin[ok], last[ok]
    same = w.doc[first[begin]] == w.doc[first[last]]
    begin, last = begin[same], last[same]
    # Starts do not fall with the closing sentence, so tails come in the order of runs.
    which = np.searchsorted(start, begin)
    longer = last + 1 > stop[which]
    return which[longer], last[longer] + 1


_OCCURRENCE = np.dtype([("doc_id", "<i8"), ("at", "<i4"), ("n", "<i4")])
_TAIL = np.dtype([("k", "<i4"), ("longer", "<i4"), ("rest", "<i8")])
_FOUND = "block long, h1 long, h2 long, doc_id long, at int, several boolean, runs binary, tails binary"


def _binary(records: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Consecutive records as one binary value for each pair of bounds."""
    ends = (bounds * records.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(records).tobytes())])


def _records(column, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The records of a binary column, and the bounds of each value among them."""
    raw = column.to_pylist()
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // dtype.itemsize)))
    return np.frombuffer(b"".join(raw), dtype), bounds


def _gathered(keys: list[np.ndarray], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Occurrences grouped by equal keys: their order, the bounds of the groups, and the
    columns doc_id and at of each group's first, whether it has another place, and all."""
    order = np.lexsort((seen["at"], seen["doc_id"], *keys[::-1]))
    own = seen[order]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    begin = np.flatnonzero(new)
    bounds = np.append(begin, len(order))
    first, last = own[begin], own[bounds[1:] - 1]
    several = (first["doc_id"] != last["doc_id"]) | (first["at"] != last["at"])
    return order, bounds, [pa.array(first["doc_id"]), pa.array(first["at"]), pa.array(several), _binary(own, bounds)]


def spans(docs: DataFrame, min_words: int = MIN_WORDS, closing: bool = False) -> DataFrame:
    """A row for each different run of a block of texts: its hash (h1, h2), the first place
    (doc_id, at) of the block that has it, whether the block has it at several places, all its
    ``runs`` there, and their ``tails`` if ``closing``.

    A block is about SCAN_BYTES of text, one text at least; its name is the number of its
    task and its own.  A run that many texts share costs one row a block."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, texts in pieces_of(batch.column(1)):
                w, first = sentences(texts)
                start, stop = runs(w, first, min_words)
                if not len(start):
                    continue
                words = np.append(first, len(w.start))
                doc = w.doc[first[start]]
                lanes = [w.hashes(k) for k in (0, 1)]
                seen = np.empty(len(start), _OCCURRENCE)
                seen["doc_id"], seen["at"], seen["n"] = ids[doc + a], start - np.searchsorted(first, w.first)[doc], stop - start
                h = [run_hashes(lanes[k], words[start], words[stop], k).view(np.int64) for k in (0, 1)]
                order, bounds, columns = _gathered(h, seen)
                which, beyond = tails(w, first, start, stop, min_words) if closing else (start[:0], stop[:0])
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                # Tails in the order of the gathered runs they go on from.
                by = np.argsort(place[which], kind="stable")
                which, beyond = which[by], beyond[by]
                group = np.searchsorted(bounds, place[which], "right") - 1
                more = np.empty(len(which), _TAIL)
                more["k"], more["longer"] = place[which] - bounds[group], beyond - start[which]
                more["rest"] = run_hashes(lanes[0], words[stop[which]], words[beyond]).view(np.int64)
                at = order[bounds[:-1]]
                columns = [pa.array(np.full(len(at), block)), *(pa.array(x[at]) for x in h), *columns, _binary(more, np.searchsorted(group, np.arange(len(bounds))))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _FOUND.split(", ")])
                block += 1

    return texts_of(docs).where("doc_id is not null").mapInArrow(run, _FOUND)


_LONGER = "block long, h1 long, h2 long, rest long, doc_id long, at int, several boolean, runs binary"


def _longer(batches):
    """The tails of repeated runs as runs of their own, gathered like those."""
    for batch in batches:
        seen, first = _records(batch.column(3), _OCCURRENCE)
        more, bounds = _records(batch.column(4), _TAIL)
        if not len(more):
            continue
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        own = seen[first[row] + more["k"]]
        own["n"] = more["longer"]
        order, ends, columns = _gathered([row, more["rest"]], own)
        at = order[ends[:-1]]
        keys = [batch.column(k).take(pa.array(row[at])) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(more["rest"][at]), *columns], names=[x.split()[0] for x in _LONGER.split(", ")])


def _merged(rows: pa.Table) -> pa.Table:
    """The stretches (at, n) of each document of a block that its later runs cover."""
    rows = rows.combine_chunks()
    seen, bounds = _records(rows["runs"], _OCCURRENCE)
    row = np.repeat(np.arange(rows.num_rows), np.diff(bounds))
    first_doc, first_at = rows["first_doc"].to_numpy()[row], rows["first_at"].to_numpy()[row]
    seen = seen[(seen["doc_id"] > first_doc) | (seen["doc_id"] == first_doc) & (seen["at"] > first_at)]
    seen = seen[np.lexsort((seen["at"], seen["doc_id"]))]
    ids, doc = np.unique(seen["doc_id"], return_inverse=True)
    begin = doc.astype(np.int64) << 32 | seen["at"]
    reach = np.maximum.accumulate(begin + seen["n"])
    new = np.ones(len(seen), bool)
    new[1:] = begin[1:] > reach[:-1]
    start = np.flatnonzero(new)
    stop = np.append(start, len(seen))[1:] - 1
    offsets = pa.array(np.searchsorted(doc[start], np.arange(len(ids) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (seen["at"][start], reach[stop] - begin[start])]
    return pa.table([pa.array(ids), *lists], names=["doc_id", "at", "n"])


def covered(found: DataFrame) -> DataFrame:
    """(doc_id, gone): for each document the stretches of sentences that are removed.

    Nothing is joined run by run: a hash that is repeated meets the rows of its blocks, and
    each block's rows, which are as many as its texts have runs at most, are then merged."""
    place = F.struct("doc_id", "at")

    def repeated(rows: DataFrame, by: list[str]) -> DataFrame:
        summed = rows.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("several").alias("several"))
        return staged(summed.where("several or first < last").select(*by, F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at")), "hashes")

    runs_of = ["h1", "h2"]
    again = staged(found.select("block", *runs_of, "runs", "tails").join(repeated(found, runs_of).hint("merge"), runs_of).select("block", *runs_of, "runs", "tails", "first_doc", "first_at"), "repeated")
    longer = staged(again.select("block", *runs_of, "runs", "tails").mapInArrow(_longer, _LONGER), "longer")
    keys = [*runs_of, "rest"]
    later = longer.select("block", *keys, "runs").join(repeated(longer, keys).hint("merge"), keys)
    names = ["block", "runs", "first_doc", "first_at"]
    merged = again.select(*names).union(later.select(*names)).groupBy("block").applyInArrow(_merged, "doc_id long, at array<int>, n array<int>")
    # Rows that share a doc_id may lie in several blocks.
    return merged.groupBy("doc_id").agg(F.collect_set(F.struct("at", "n")).alias("gone"))


def _remove(batches):
    for batch in batches:
        gone = batch.column(2)
        for a, b, texts in pieces_of(batch.column(1)):
            w, first = sentences(texts)
            base = np.searchsorted(first, w.first)
            count = np.diff(base)
            # A sentence reaches from its first word to the next sentence's.
            byte = np.append(w.start[first], 0)
            out, removed = [], np.zeros(b - a, np.int64)
            for k in range(b - a):
                text, cuts = texts[k], gone[a + k].as_py()
                if cuts:
                    drop = np.zeros(count[k], bool)
                    for x in cuts:
                        for at, n in zip(x["at"], x["n"], strict=True):
                            drop[at : at + n] = True
                    edge = byte[base[k] : base[k + 1]] - w.at[k]
                    stop = np.append(edge[1:], len(text))
                    kept = [text[edge[i] : stop[i]] for i in np.flatnonzero(~drop)]
                    removed[k] = drop.sum()
                    text = text[: edge[0]] + b"".join(kept) if kept else b""
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.binary()).cast(pa.string()), pa.array(count.astype(np.int64)), pa.array(removed), *[c.slice(a, b - a) for c in batch.columns[3:]]], names=["doc_id", "text", "n_sentences", "n_removed", *batch.schema.names[3:]])


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, carry: list[str] | None = None, closing: bool = False) -> DataFrame:
    """doc_id, text without repeats, n_sentences, n_removed of every row of ``docs``.

    ``carry``: further columns to hand through, as ``carry_<position>``.
    ``closing``: passages are removed up to their last sentence, and not to their last run's.
    """
    found = staged(spans(docs, min_words, closing), "spans")
    gone = staged(covered(found), "gone")
    more = [F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry or [])]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    # Alike at every size: neither side is ever sent whole to all tasks.
    joined = own.join(gone.hint("merge"), "doc_id", "left")
    names = [c for c in joined.columns if c.startswith("carry_")]
    joined = joined.select("doc_id", "text", "gone", *names)
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in joined.schema.fields[3:])
    return joined.mapInArrow(_remove, "doc_id long, text string, n_sentences long, n_removed long" + extra)
