"""SentencePiece encoding and decoding by a streaming Viterbi pass.

A text is a stream of characters.  The window holds the boundaries from which the next
piece can start, as many as the longest piece has characters, and each boundary's
back-pointer chain.  As soon as the chains of all boundaries that can still be extended
meet in one, the ids up to there are committed and what lies before is forgotten.

Two kinds of models are read.  For a unigram model a boundary's back-pointer is the
piece of the best-scored path.  For a BPE model it is the one piece whose merges agree
with its predecessor's: a sequence is the BPE encoding of its text exactly when every
two neighbours encode, taken together, to themselves, so of the pieces that end at a
boundary one alone has an admissible path.

Where two characters stand side by side in no piece, nothing spans the boundary between
them: all paths meet there, whatever surrounds it.  One scan of the text finds these
commit points; the stretches between them go through the window, in sorted order so that
a stretch goes on from what it shares with the one before, and are remembered with their ids up
to MEMORY bytes.  Stretches of any length take the same pass.

Rules: null text counts as empty and has no ids; repeated rows are encoded alike; extra
columns are handed through, and a column that has the name of the result is replaced.
"""

from __future__ import annotations

import codecs
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructType

from .common import slices, strings_of

BLANK = "▁"
#: Bytes of remembered stretches with their ids, and of pairs of pieces, of a Python worker.
MEMORY = 96 << 20
#: What a remembered entry costs besides its characters and ids.
_ENTRY = 200
codecs.register_error("plumbline_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(raw: bytes):
    """(number, value) of a protocol-buffer message; bytes for length-delimited fields."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = raw[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


class PieceModel:
    """A SentencePiece model file: unigram or BPE, identity normaliser."""

    def __init__(self, path: str):
        raw = open(path, "rb").read()
        self.kind, self.prefix, self.squeeze = 1, True, True
        pieces: list[tuple[str, float, int]] = []
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]), own.get(3, 1)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                own = dict(_fields(value))
                self.prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
                if own.get(2):
                    raise ValueError("models with a character map are not supported")
        if self.kind not in (1, 2):
            raise ValueError("unigram and BPE models are supported")
        if any(kind == 4 for _, _, kind in pieces):
            raise ValueError("models with user-defined symbols are not supported")
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.score = {p: s for p, s, kind in pieces if kind == 1}
        self.unknown = next(i for i, x in enumerate(pieces) if x[2] == 2)
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.blank_led = {i for i, (p, _, kind) in enumerate(pieces) if kind != 6 and (p[0] == BLANK or kind == 2)}
        self.longest = max(map(len, self.id))
        self.suffixes: dict[str, float | bool] = {p[k:]: False for p in self.id for k in range(1, len(p))} | self.score
        self.floor = min(self.score.values()) - 10.0
        self.bytes = [p.replace(BLANK, " ").encode() if kind == 1 else bytes([int(p[3:5], 16)]) if kind == 6 else " ⁇ ".encode() if kind == 2 else b"" for p, _, kind in pieces]
        self.prefixes = {p[:k] for p in self.id for k in range(1, len(p))}
        self._pairs: dict[tuple[str, str], bool] = {}
        self.stretches: dict[str, bytes] = {}
        self.held = 0
        #: Boundaries held at most so far, and stretches that went through the window.
        self.widest = self.ran = 0
        self._stretch = self._stretch_pattern()

    def _stretch_pattern(self) -> re.Pattern:
        """What finds the stretches of a normalised text: characters that stand side by side in
        some piece are of one kind; blanks belong to what follows them."""
        inner = any(p.find(BLANK, 1) > 0 and p.strip(BLANK) for p in self.id)
        kind: dict[str, str] = {}

        def find(c: str) -> str:
            while kind.setdefault(c, c) != c:
                kind[c] = c = kind[kind[c]]
            return c

        for p in self.id:
            for x, y in zip(p, p[1:]):
                if inner or x != BLANK:
                    a, b = sorted((find(x), find(y)))
                    kind[b] = a
        groups: dict[str, list[str]] = {}
        for c in kind:
            if inner or c != BLANK:
                groups.setdefault(find(c), []).append(c)
        classes = ["[" + "".join(map(re.escape, sorted(g))) + "]+" for g in sorted(groups.values(), key=len, reverse=True) if len(g) > 1]
        known = {c for g in groups.values() if len(g) > 1 for c in g} | {BLANK}
        # Unknown characters stay together, as they share an id where there is no byte fallback.
        others = "[^" + "".join(map(re.escape, sorted(known))) + "]"
        classes.append(others if self.byte_id else others + "+")
        if inner:
            return re.compile("|".join(classes) + f"|{BLANK}+", re.S)
        return re.compile(f"{BLANK}*(?:" + "|".join(classes) + f")|{BLANK}+", re.S)

    # ----------------------------------------------------------- admissible neighbours
    def merged(self, text: str) -> list[str]:
        """The BPE pieces of a short text, merge by merge."""
        parts, score = list(text), self.score
        pairs = [score.get(x + y) for x, y in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for k, x in enumerate(pairs):
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = score.get(parts[at] + parts[at + 1])

    def _follows(self, before: str, piece: str) -> bool:
        """``piece`` can come after ``before`` (nothing: at the start) in a BPE encoding."""
        ok = self.merged(before + piece) == ([before, piece] if before else [piece])
        if self.held < MEMORY:
            self._pairs[before, piece] = ok
            self.held += _ENTRY
        return ok

    # ----------------------------------------------------------- the streaming pass
    def _run(self, text: str, window: list[list], out: list[str]) -> None:
        """The pass over ``text``, from the boundaries in ``window`` on.

        A boundary is [place, its piece, the boundary that piece starts from, score];
        ``window`` has those of consecutive places, and ``longest`` of them at most.  What
        is committed goes to ``out``."""
        suffixes, pairs, follows = self.suffixes, self._pairs, self._follows
        unigram, floor, longest, prefixes = self.kind == 1, self.floor, self.longest, self.prefixes
        base = window[0][0]
        for j in range(window[-1][0] + 1, len(text) + 1):
            found, top = None, -1e300
            for i in range(j - 1, base - 1, -1):
                piece = text[i:j]
                score = suffixes.get(piece)
                if score is None or score is False:
                    if i < j - 1:
                        if score is None:
                            break
                        continue
                    score = floor  # an unknown character
                before = window[i - base]
                if unigram:
                    if before[3] + score > top:
                        top = before[3] + score
                        found = [j, piece, before, top]
                else:
                    ok = pairs.get((before[1], piece))
                    if ok or ok is None and follows(before[1], piece):
                        found = [j, piece, before, 0.0]
                        break
            if found is None:
                raise AssertionError(f"no admissible piece ends at {j}")
            window.append(found)
            if len(window) > longest:
                del window[0]
                base += 1
                # Boundaries that some piece can still reach beyond the last character.
                alive = {b[0]: b for b in window[:-1] if text[b[0] : j] in prefixes}
                alive[j] = found
                while len(alive) > 1:
                    last = alive.pop(max(alive))[2]
                    if last is None:
                        break
                    alive[last[0]] = last
                else:
                    self._commit(next(iter(alive.values())), out)
        self.widest = max(self.widest, len(window))

    @staticmethod
    def _commit(at: list, out: list[str]) -> None:
        """The pieces up to the boundary ``at``, which is where later paths start from now on."""
        pieces, b = [], at
        while b[2] is not None:
            pieces.append(b[1])
            b = b[2]
        out += reversed(pieces)
        at[2] = None

    def stream(self, text: str) -> list[str]:
        """The pieces of a normalised text."""
        window, out = [[0, "", None, 0.0]], []
        self._run(text, window, out)
        self._commit(window[-1], out)
        return out

    def _as_ids(self, pieces) -> bytes:
        out: list[int] = []
        unknown = False
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
                unknown = False
            elif self.byte_id:
                out += (self.byte_id[b] for b in p.encode())
            else:
                if not unknown:
                    out.append(self.unknown)
                unknown = True
        return array("i", out).tobytes()

    def _encode_stretches(self, new: set[str]) -> dict[str, bytes]:
        """Ids of each stretch, all paths of which meet at both of its ends."""
        made, old, window, longest = {}, "", [[0, "", None, 0.0]], self.longest
        for text in sorted(new):
            shared = 0
            for x, y in zip(old, text):
                if x != y:
                    break
                shared += 1
            if shared and window[0][0] == 0:
                # Nothing was committed yet: the window still starts where the stretch does.
                del window[shared + 1 :]
            else:
                window = [[0, "", None, 0.0]]
            out: list[str] = []
            self._run(text, window, out)
            b, rest = window[-1], []
            while b[2] is not None:
                rest.append(b[1])
                b = b[2]
            out += reversed(rest)
            made[text] = self._as_ids(out)
            old = text
        self.ran += len(made)
        return made

    # ----------------------------------------------------------- texts
    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def encode(self, text: str) -> bytes:
        """Ids, little-endian 32-bit."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out, find, known = [], self._stretch.findall, self.stretches
        for a, b in slices([len(x) for x in texts], 1 << 21):
            cut = [find(self.normalised(x)) for x in texts[a:b]]
            made = self._encode_stretches(set().union(*cut).difference(known))
            known.update(made)
            out += (b"".join(map(known.__getitem__, x)) for x in cut)
            for text, ids in made.items():
                size = _ENTRY + len(text) + len(ids)
                if self.held + size > MEMORY:
                    del known[text]
                else:
                    self.held += size
        return out

    def decode(self, ids) -> str:
        """The text of ids; the blank that encoding put before it goes, a byte piece's stays."""
        own = self.bytes
        text = b"".join(map(own.__getitem__, ids)).decode("utf-8", "plumbline_each_byte")
        if self.prefix and text[:1] == " " and next(i for i in ids if own[i]) in self.blank_led:
            return text[1:]
        return text


_HELD: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _HELD:
        _HELD[path] = PieceModel(path)
    return _HELD[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _replaced(df: DataFrame, name: str, kind: DataType):
    """The columns of ``df`` to hand through beside a new one called ``name``, and the schema."""
    kept = [k for k, c in enumerate(df.columns) if c.lower() != name.lower()]
    schema = StructType([df.schema.fields[k] for k in kept]).add(name, kind)
    return kept, schema


def _lists(raw: list[bytes]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 4))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str | None = None, check_col: str | None = None) -> DataFrame:
    """``df`` with ``ids_col``: the ids of each text, an empty list for null; with
    ``check_col`` also whether they decode to it, without a second pass through Python."""
    path = model or default_model()
    at = df.columns.index(text_col)
    kept, schema = _replaced(df, ids_col, ArrayType(IntegerType()))
    if check_col:
        kept = [k for k in kept if df.columns[k].lower() != check_col.lower()]
        schema = StructType([f for f in schema.fields if f.name.lower() != check_col.lower()]).add(check_col, BooleanType())

    def run(batches):
        encoder = piece_model(path)
        for batch in batches:
            for a, b, texts in strings_of(batch.column(at), 1 << 21):
                raw = encoder.encode_many(texts)
                own = batch.slice(a, b - a)
                made = [_lists(raw)]
                if check_col:
                    made.append(pa.array([encoder.decode(np.frombuffer(x, "<i4").tolist()) == t for x, t in zip(raw, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in kept), *made], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str | None = None) -> DataFrame:
    """``df`` with ``text_col``: the text of each id list, null for null."""
    path = model or default_model()
    at = df.columns.index(ids_col)
    kept, schema = _replaced(df, text_col, StringType())

    def run(batches):
        decoder = piece_model(path)
        for batch in batches:
            column = batch.column(at)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
            for a, b in slices(sizes, 1 << 18):
                texts = [None if x is None else decoder.decode(x) for x in column.slice(a, b - a).to_pylist()]
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in kept), pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
