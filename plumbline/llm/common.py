"""What the operators share: staged tables, vectorised word scans, identifier rules."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of a batch are scanned together up to about so many bytes.
SCAN_BYTES = 1 << 20


# --------------------------------------------------------------------------- tables
def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a temporary folder, but only for a local master: executors of a
    cluster would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, named, True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Paths of staged tables that are not deleted yet, oldest first.
_STAGED: list[str] = []


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def made_folder(spark: SparkSession, name: str) -> str:
    """A new empty folder under the shared one; it stays until release(), or else until the
    driver ends."""
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    _STAGED.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here,
    columns can still be pruned, and a lost executor costs no recomputation."""
    path = f"{made_folder(df.sparkSession, name)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the list of staged tables, for release()."""
    return len(_STAGED)


def release(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Delete the tables staged between two marks, once what reads them is written."""
    for path in _STAGED[since:until]:
        place, files = _place(spark, path)
        files.delete(place, True)
    del _STAGED[since:until]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null text as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def keep_rows(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is in the one column of ``ids``; columns unchanged.
    Null ids match null ids."""
    theirs = ids.toDF("__plumbline_kept_id")
    return docs.join(theirs, docs[id_col].eqNullSafe(theirs["__plumbline_kept_id"]), "left_semi")


# --------------------------------------------------------------------------- hashing
_U = np.uint64
#: Where the two lanes of a span's hash start from.
LANES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Spans of more bytes are hashed by BLAKE2b, shorter ones eight bytes at a time.
SHORT_SPAN = 64
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Run hashes are polynomials modulo this prime, where no text makes a base fail.
PRIME = (1 << 61) - 1
_P, _LOW30, _LOW31 = _U(PRIME), _U((1 << 30) - 1), _U((1 << 31) - 1)
#: A base for each lane, and its inverse.
_RUN_BASES = (0x0B1E6C3F5A2D9877, 0x17C4D28E93B5A061)


def mod_prime(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def mul_prime(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME of numbers below it, in halves of 31 and 30 bits."""
    a0, a1, b0, b1 = a & _LOW31, a >> _U(31), b & _LOW31, b >> _U(31)
    mid = a1 * b0 + a0 * b1
    return mod_prime((a1 * b1 << _U(1)) + (mid >> _U(30)) + ((mid & _LOW30) << _U(31)) + mod_prime(a0 * b0))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, _U)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate((have, mul_prime(have, _U(pow(base, len(have), PRIME)))))
        _POWERS[base] = have
    return have


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each ``values[start:end]``, below 2**61, by prefix sums of a polynomial."""
    base = _RUN_BASES[which]
    up, down = _powers(base, len(values) + 1), _powers(pow(base, -1, PRIME), len(values) + 1)
    term = mul_prime(mod_prime(values), up[: len(values)])
    # Sums of the halves stay below 2**61 for up to 2**30 values.
    low, high = np.zeros(len(values) + 1, _U), np.zeros(len(values) + 1, _U)
    np.cumsum(term & _LOW31, out=low[1:])
    np.cumsum(term >> _U(31), out=high[1:])
    low, high = mod_prime(low[end] - low[start]), mod_prime(high[end] - high[start])
    total = mod_prime(low + mul_prime(high, np.full(len(high), 1 << 31, _U)))
    return mod_prime(mul_prime(total, down[start]) + mod_prime(mix64((end - start).astype(_U))))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of several texts, found in one pass over their bytes.

    ``start``/``end``: byte offsets in ``buf``; ``doc``: index of the text; ``first``:
    for each text the index of its first word (one entry more than texts).
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = b"\n".join(texts) + b"\n" + bytes(8)
        if lower:
            raw = raw.translate(_LOWER)
        self.raw, self.buf = raw, np.frombuffer(raw, np.uint8)[:-8]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=self.at[1:])
        space = _SPACE[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self, which: int = 0) -> np.ndarray:
        return self.span_hashes(self.start, self.end, which)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """A 64-bit hash of the bytes of each span; ``which`` names one of two lanes.

        No sum of letters, so no two texts collide by their structure: short spans go
        through a bijective mixer eight bytes after eight, long ones through BLAKE2b."""
        size = end - start
        out = mix64(size.astype(_U) + _U(LANES[which]))
        eight = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, 0, (1,))
        own = np.flatnonzero((size > 0) & (size <= SHORT_SPAN))
        at, left = start[own], size[own]
        while len(own):
            out[own] = mix64(out[own] ^ (eight[at] & _HEAD[np.minimum(left, 8)]))
            more = left > 8
            own, at, left = own[more], at[more] + 8, left[more] - 8
        for k in np.flatnonzero(size > SHORT_SPAN):
            whole = hashlib.blake2b(self.raw[start[k] : end[k]], digest_size=16).digest()
            out[k] = int.from_bytes(whole[8 * which : 8 * which + 8], "little")
        return out

    def windows(self, n: int, hashed: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text index, window hash, index of its first word) of every run of ``n`` words;
        with ``whole`` a text of 1 to n-1 words gives its whole sequence as one window."""
        total = len(hashed)
        if total >= n:
            acc = np.zeros(total - n + 1, _U)
            for k in range(n):
                acc = (acc ^ hashed[k : total - n + 1 + k]) * _U(0x9FB21C651E98DF25)
                acc ^= acc >> _U(29)
            ok = self.doc[: total - n + 1] == self.doc[n - 1 :]
            at = np.flatnonzero(ok)
            doc, value = self.doc[at], acc[at]
        else:
            at, doc, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
        if whole and len(short := np.flatnonzero((self.count > 0) & (self.count < n))):
            extra = np.zeros(len(short), _U)
            for k in range(n - 1):
                have = self.count[short] > k
                word = hashed[np.minimum(self.first[short] + k, total - 1)]
                extra = np.where(have, (extra ^ word) * _U(0xE7037ED1A0B428DB), extra)
                extra ^= extra >> _U(31)
            extra = mix64(extra + self.count[short].astype(_U))
            doc, value, at = np.concatenate((doc, short)), np.concatenate((value, extra)), np.concatenate((at, self.first[short]))
        return doc, mix64(value), at


def slices(sizes: list[int], most: int = SCAN_BYTES):
    """(from, to) ranges of consecutive texts of about ``most`` bytes together, one text at least."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n + 1
    if at < len(sizes):
        yield at, len(sizes)


def byte_texts(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def pieces_of(column, most: int = SCAN_BYTES):
    """(from, to, texts as bytes) of an Arrow string column, about ``most`` bytes at a time, so
    that of a batch only so much is held as Python objects."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in slices(sizes, most):
        yield a, b, byte_texts(column.slice(a, b - a))


def strings_of(column, most: int = SCAN_BYTES):
    """Like pieces_of, with texts as strings."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in slices(sizes, most):
        yield a, b, [x or "" for x in column.slice(a, b - a).to_pylist()]
