"""Byte-level BPE ids, fast enough for whole corpora.

A text is cut before runs of white space; such chunks encode independently of each
other, so their ids are remembered and joined as raw 32-bit values.  Texts with
uncommon white space go to the tokenizer whole.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np

#: White space of the pattern other than blank and line feed.
_ODD = re.compile("[\t\x0b\x0c\r\x85\xa0  -     　]")
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Remembered chunks of a Python worker, about 0.25 kB each; more are encoded each time.
MEMORY, LONGEST = 120_000, 48
#: The special token of the public vocabulary (fixed values).
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Two white spaces together, in texts that have no odd ones.
_DOUBLE = ("  ", " \n", "\n ", "\n\n")


def plain(text: str) -> bool:
    """Words with one blank or line feed between them, none at the ends."""
    return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in _DOUBLE)


class _Memo(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        out = self.encode(chunk)
        if len(self) < MEMORY and len(chunk) <= LONGEST:
            self[chunk] = out
        return out


class ByteBpe:
    """Ids of the byte-level BPE whose ranks are in ``path``."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ordinary = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = _Memo(lambda word: self._raw(word if word[:1] == "\n" else " " + word))
        self.chunks = _Memo(self._raw)

    def _raw(self, text: str) -> bytes:
        return array("I", self.ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids, little-endian unsigned 32-bit; a special token's string is ordinary text."""
        if not text:
            return b""
        if _ODD.search(text):
            return self._raw(text)
        if plain(text):
            words = text.replace("\n", " \n").split(" ")
            return self._raw(words[0]) + b"".join(map(self.words.__getitem__, words[1:]))
        return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))

    def encode_special(self, text: str) -> bytes:
        """The ids that the public library gives, where a special token's string is that token."""
        if SPECIAL not in text:
            return self.encode(text)
        return np.array([SPECIAL_ID], "<u4").tobytes().join(map(self.encode, text.split(SPECIAL)))


_HELD: dict[tuple, ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The tokenizer, loaded once for each Python worker."""
    if (path, pattern) not in _HELD:
        _HELD[path, pattern] = ByteBpe(path, pattern)
    return _HELD[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public 50k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
