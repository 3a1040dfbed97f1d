"""Whole Arrow batches of texts as arrays of word hashes, and hashes of windows of words built by doubling.

Words are maximal runs of bytes other than space and \\x09-\\x0D, which in UTF-8 is the same as runs of such characters.
Nothing here loops over words in Python; a batch is cut into pieces of a few MB, a longer text is one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 2_000_000
_U = np.uint64
_rng = np.random.default_rng(20240607)
_COEF = _rng.integers(1, 2**63, 4096, dtype=np.int64).astype(_U) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> _U(27))) * _U(0x94D049BB133111EB)
    return a ^ (a >> _U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence of two hashes."""
    return mix(a * _U(0x9E3779B97F4A7C15) + b + _U(0x632BE59BD9B4E019))


@dataclass
class Tape:
    """The words of some consecutive rows: hash, row, and where each row's words begin (first has a last entry more)."""

    rows: range
    words: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))

    def left(self) -> np.ndarray:
        """For each word, how many words of its row begin at or after it."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.words))


def tape(data: np.ndarray, offsets: np.ndarray, rows: range) -> Tape:
    base, top = int(offsets[0]), int(offsets[-1])
    raw = data[base:top]
    cuts = np.asarray(offsets, np.int64) - base
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[inner] = ~space[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Tape(rows, np.zeros(0, _U), np.zeros(len(rows) + 1, np.int64), starts, starts)
    at = np.flatnonzero(~space)
    which = np.cumsum(begins)[at] - 1
    inside = at - starts[which]
    value = (raw[at].astype(_U) + _U(1)) * _COEF[inside & 4095]
    if (far := inside >> 12).any():
        value *= far.astype(_U) * _U(0xD6E8FEB86659FD93) * _U(2) + _U(1)
    heads = np.flatnonzero(inside == 0)
    sizes = np.diff(np.append(heads, len(at)))
    words = mix(np.add.reduceat(value, heads) + sizes.astype(_U) * _U(0xA0761D6478BD642F))
    return Tape(rows, words, np.searchsorted(starts, cuts), starts + base, starts + base + sizes)


def tapes(column: pa.Array, piece: int = PIECE) -> Iterator[tuple[Tape, np.ndarray]]:
    """The tapes of a string column in order, with the bytes that starts and ends point into; a null has no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + piece, "right")) - 1)
        b = min(b, n)
        yield tape(data, offsets[a : b + 1], range(a, b)), data
        a = b


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` words over the whole tape (also across rows): size doubles, the last step overlaps."""
    w, have = words, 1
    while 2 * have <= size:
        w = pair(w[: len(w) - have], w[have:]) if len(w) > have else w[:0]
        have *= 2
    if rest := size - have:
        w = pair(w[: len(w) - rest], w[rest:]) if len(w) > rest else w[:0]
    return w


def extend(w: np.ndarray, by: int) -> np.ndarray:
    """From hashes of windows, those of windows longer by `by` words."""
    return pair(w[: len(w) - by], w[by:]) if len(w) > by else w[:0]


def sliding_argmin(w: np.ndarray, width: int) -> np.ndarray:
    """The position of the first smallest of each `width` consecutive values; ordered by the upper 40 bits, then position."""
    n = len(w) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    step = 1 << 23
    low = _U((1 << 24) - 1)
    for a in range(0, n, step):
        m = min(step, n - a)
        key = (w[a : a + m + width - 1] & ~low) | np.arange(m + width - 1, dtype=_U)
        have = 1
        while 2 * have <= width:
            key = np.minimum(key[: len(key) - have], key[have:])
            have *= 2
        if rest := width - have:
            key = np.minimum(key[: len(key) - rest], key[rest:])
        out[a : a + m] = (key & low).astype(np.int64) + a
    return out
