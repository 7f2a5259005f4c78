"""Token counts by separator scan over flat token files without an index.

A flat file is token ids end to end, each document closed by an end-of-document id, and
nothing else: no header, no offsets.  Files of any size are read as byte ranges of one
block each; a block's separators are found by one vectorised comparison, and only its
summary leaves the task.  Documents that cross blocks are stitched by a prefix scan over
block summaries (tokens, separators, place of the last one), in two levels, so that no
task sees all blocks of a large file.

Files lie in any store that Spark can list and pyarrow can open (local or shared
folders, hdfs, s3, gs), under the shared folder where they are made here.

Rules: null text counts as empty, a document of no tokens before its separator.  Special
tokens' strings in a text are ordinary text.  An unclosed last document counts, marked
``closed`` false, if it has a token; a last block that ends inside a token is refused, and
so are ids that do not fit the width.  An empty table or folder gives an empty result.
Extra columns are ignored; repeated rows are documents of their own.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import made_folder, staged, strings_of
from .tokens import byte_bpe, default_vocabulary

END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 17
#: Blocks of a group in the first level of the prefix scan.
GROUP = 256


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def as_width(raw: bytes, width: int) -> bytes:
    """32-bit ids in ``width`` bytes each."""
    if width == 4:
        return raw
    ids = np.frombuffer(raw, "<u4")
    if len(ids) and int(ids.max()) >> (8 * width):
        raise ValueError(f"id {ids.max()} does not fit {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


def write_flat(docs: DataFrame, folder: str, end: int = END_OF_DOCUMENT, width: int = 2, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Writes one flat file for each input partition that has rows into ``folder``, and gives
    (file, doc_index, doc_id): which document comes where, without its place in the file.

    A file has a name of its own for each attempt; only files of attempts that were
    committed are in the result."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches):
        encode, close, out = byte_bpe(path, pattern).encode, as_width(np.array([end], "<u4").tobytes(), width), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name, index = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tokens", 0
                store, at = _store(f"{folder}/{name}")
                out = store.open_output_stream(at)
            for _, _, texts in strings_of(batch.column(1)):
                out.write(b"".join(as_width(encode(text), width) + close for text in texts))
            yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), pa.array(np.arange(index, index + batch.num_rows)), batch.column(0)], names=["file", "doc_index", "doc_id"])
            index += batch.num_rows
        if out is not None:
            out.close()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "file string, doc_index long, doc_id long")


def ranges(spark: SparkSession, folder: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, path, block, at, size): the byte ranges of the flat files under ``folder``, which
    need not be read for it.  ``file`` is the file's name."""
    step = width * block_tokens
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long")))
    cut = files.where("length > 0").select("path", "length", at.alias("at"))
    return cut.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", (F.col("at") / step).cast("long").alias("block"), "at", F.least(F.lit(step), F.col("length") - F.col("at")).cast("long").alias("size"))


def block_summaries(blocks: DataFrame, end: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """For each byte range (file, path, block, at, size): tokens, separators, where the last one
    ends (0: none), and the tokens before each separator since the block's start or the last one."""
    kind = f"<u{width}"

    def run(batches):
        opened = ("", None)
        for batch in batches:
            size, count, last, gaps = [], [], [], []
            for path, at, n in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)), strict=True):
                if opened[0] != path:
                    store, place = _store(path)
                    opened = path, store.open_input_file(place)
                raw = opened[1].read_at(n, at)
                if len(raw) != n or n % width:
                    raise ValueError(f"{path} ends inside a token")
                tokens = np.frombuffer(raw, kind)
                ends = np.flatnonzero(tokens == end)
                size.append(len(tokens)), count.append(len(ends)), last.append(int(ends[-1]) + 1 if len(ends) else 0)
                gaps.append(np.diff(ends, prepend=-1) - 1)
            bounds = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(last, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int64), *gaps])))], names=["file", "block", "size", "ends", "last", "gaps"])

    own = blocks.select("file", "path", "block", "at", "size")
    # A few blocks a task, in the order of their files; ranges are all that moves.
    dealt = own.repartitionByRange("path", "block")
    return dealt.mapInArrow(run, "file string, block long, size long, ends long, last long, gaps array<long>")


def scan(blocks: DataFrame, end: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """file, doc_index, n_tokens, closed of every document in the byte ranges ``blocks``."""
    found = staged(block_summaries(blocks, end, width), "blocks").withColumn("part", F.floor(F.col("block") / GROUP))
    # Level one: places inside a group of blocks.
    inside = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    near = found.withColumns({"at": F.coalesce(F.sum("size").over(inside), F.lit(0)), "n": F.coalesce(F.sum("ends").over(inside), F.lit(0))})
    stop = F.when(F.col("ends") > 0, F.col("at") + F.col("last"))
    near = near.withColumn("stop", F.max(stop).over(inside))
    # Level two: one row a group.
    sums = near.groupBy("file", "part").agg(F.sum("size").alias("size"), F.sum("ends").alias("ends"), F.max(stop).alias("stop"))
    across = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"at_0": F.coalesce(F.sum("size").over(across), F.lit(0)), "n_0": F.coalesce(F.sum("ends").over(across), F.lit(0))})
    sums = sums.withColumn("stop_0", F.max(F.col("at_0") + F.col("stop")).over(across))
    tail = sums.groupBy("file").agg(F.max(F.col("at_0") + F.col("size")).alias("total"), F.sum("ends").alias("doc_index"), F.coalesce(F.max(F.col("at_0") + F.col("stop")), F.lit(0)).alias("start"))
    full = near.join(sums.select("file", "part", "at_0", "n_0", "stop_0"), ["file", "part"])
    start = F.col("at_0") + F.col("at")
    opened = start - F.coalesce(F.col("at_0") + F.col("stop"), F.col("stop_0"), F.lit(0))
    docs = full.select("file", (F.col("n_0") + F.col("n")).alias("first"), opened.alias("opened"), F.posexplode("gaps").alias("k", "gap"))
    n_tokens = F.col("gap") + F.when(F.col("k") == 0, F.col("opened")).otherwise(0)
    whole = docs.select("file", (F.col("first") + F.col("k")).alias("doc_index"), n_tokens.alias("n_tokens"), F.lit(True).alias("closed"))
    rest = tail.where("total > start").select("file", "doc_index", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return whole.union(rest)


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens of every row of ``docs``, counted in the flat files made of it."""
    spark = docs.sparkSession
    folder = made_folder(spark, "flat")
    order = staged(write_flat(docs, folder), "order")
    # Files that a lost attempt has left are not read.
    known = order.select("file").distinct()
    found = scan(ranges(spark, folder).join(known, "file", "left_semi"))
    return found.join(order, ["file", "doc_index"]).select("doc_id", "n_tokens")
