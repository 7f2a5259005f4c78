"""Counts of whole texts, for the quality rules and the classifier, in vectorised scans."""

from __future__ import annotations

import numpy as np

from .common import Words, mix64

#: Symbols whose number the base rules count (fixed values of the contract).
SYMBOLS = b"#*$%&|<>"
_U = np.uint64


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _mask(SYMBOLS)
_UPPER, _LOWER, _DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(bytes(range(48, 58)))
_STOP, _LOUD, _COMMA = _mask(b".?"), _mask(b"!"), _mask(b",;:")


def _again(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each (text, value): how often the pair occurs, and whether it occurred earlier."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    _, first, back, count = np.unique(mix64(value + mix64(doc.astype(_U) + _U(77))), return_index=True, return_inverse=True, return_counts=True)
    return count[back], first[back] != np.arange(len(doc))


class Counts:
    """Whole-text counts of each of several texts; every attribute has one entry a text."""

    def __init__(self, texts: list[bytes], more: bool = False):
        w = self.words = Words(texts)
        n = len(texts)
        self.n_words = w.count.astype(np.int64)
        # A text's bytes are followed by one line feed that is not its own.
        begin, end = w.at[:-1], w.at[1:] - 1

        def total(mask: np.ndarray) -> np.ndarray:
            run = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=run[1:])
            return run[end] - run[begin]

        points = (w.buf & 0xC0) != 0x80
        blank = np.zeros(256, bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        self.word_chars = total(points & ~blank[w.buf])
        self.n_symbols = total(_SYMBOL[w.buf])

        # Lines: every line feed ends one, that after a text its last.
        stop = np.flatnonzero(w.buf == 10)
        start = np.concatenate(([0], stop[:-1] + 1))
        some = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
        line_doc = np.searchsorted(w.at, start, "right") - 1
        start, stop, line_doc = start[some], stop[some], line_doc[some]
        _, earlier = _again(line_doc, mix64(w.span_hashes(start, stop)))
        self.n_lines = np.bincount(line_doc, minlength=n)
        self.n_dup_lines = np.bincount(line_doc[earlier], minlength=n)

        hashed = w.hashes()
        doc, value, at = w.windows(5, hashed, whole=False)
        often, _ = _again(doc, value)
        step = np.zeros(len(hashed) + 1, np.int64)
        hit = at[often > 1]
        np.add.at(step, hit, 1)
        np.add.at(step, hit + 5, -1)
        self.n_repeat_words = np.bincount(w.doc[np.cumsum(step)[:-1] > 0], minlength=n)
        if more:
            self.n_chars = total(points)
            self.upper, self.lower, self.digits = total(_UPPER[w.buf]), total(_LOWER[w.buf]), total(_DIGIT[w.buf])
            self.stops, self.louds, self.commas = total(_STOP[w.buf]), total(_LOUD[w.buf]), total(_COMMA[w.buf])
            _, seen = _again(w.doc, hashed)
            self.distinct_words = np.bincount(w.doc[~seen], minlength=n)
            same = np.zeros(len(hashed), bool)
            same[1:] = (hashed[1:] == hashed[:-1]) & (w.doc[1:] == w.doc[:-1])
            self.doubled = np.bincount(w.doc[same], minlength=n)
