"""Arrow text columns as byte arrays: words, their hashes and counts, worked out by numpy for a batch at a time.

Word hashes are 64-bit polynomials over the bytes of a word. They do not depend on where the word stands, so
a batch is worked on in windows of bounded size that end between words, and a text of any length fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
"""White space of the word rule: blank and 0x09 to 0x0D."""

MARKS = np.ones(256, bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
"""All ASCII bytes that are neither letters nor digits."""

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32
"""A-Z to a-z; other bytes as they are."""


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def pieces(batch: pa.RecordBatch, column: str, size: int = 4 * WINDOW) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each with about `size` bytes of text at most (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; NULL counts as empty. `lower` folds case by Unicode first."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if lower:
        texts = pc.utf8_lower(texts)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch of texts: byte ranges [start, end), and `bounds`: text i has words bounds[i] to bounds[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        gap = gaps[data]
        self._mark(~gap)

    def _mark(self, inside: np.ndarray) -> None:
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)

    @classmethod
    def cut_at(cls, data: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> Words:
        """Words that begin where `first` is true, and at each text's begin, and fill the text."""
        words = cls.__new__(cls)
        words.data, words.offsets = data, offsets
        first = first.copy()
        begins = offsets[:-1][np.diff(offsets) > 0]
        first[begins] = True
        words.start = np.flatnonzero(first)
        words.end = np.append(words.start[1:], len(data)) if len(words.start) else words.start
        words.bounds = np.searchsorted(words.start, offsets)
        return words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self, fold: np.ndarray = SAME, stems: tuple[int, ...] = ()) -> list[np.ndarray]:
        """64-bit hashes of the words, their bytes replaced by `fold`; then, for each length, of the words' first bytes."""
        out = [np.empty(len(self.start), np.uint64) for _ in range(1 + len(stems))]
        values, k = _BYTE_VALUES[fold], 0
        while k < len(self.start):
            low = self.start[k]
            stop = max(k + 1, int(np.searchsorted(self.end, low + WINDOW, "right")))
            high = self.end[stop - 1]
            power, inverse = _powers(high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(values[self.data[low:high]] * power, out=sums[1:])
            start, end = self.start[k:stop] - low, self.end[k:stop] - low
            for target, to in zip(out, [end, *(np.minimum(end, start + n) for n in stems)], strict=True):
                target[k:stop] = mixed((sums[to] - sums[start]) * inverse[start])
            k = stop
        return out


_kept: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a usual window are kept."""
    size = max(n, WINDOW)
    if size == WINDOW and _kept:
        return _kept[0][:n], _kept[1][:n]
    both = []
    for base in (_BASE, _BASE_INVERSE):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        both.append(np.cumprod(x))
    if size == WINDOW:
        _kept[:] = both
    return both[0][:n], both[1][:n]


def runs(hashes: np.ndarray, owner: np.ndarray, width: int, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of `width` words that stand `gap` apart in the same text, for each place where they fit."""
    reach = (width - 1) * gap
    if len(hashes) <= reach:
        return owner[:0], hashes[:0]
    n = len(hashes) - reach
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(_BASE) + hashes[k * gap : k * gap + n]
    fits = owner[:n] == owner[reach:]
    return owner[:n][fits], mixed(total[fits] + np.uint64(width * 64 + gap))
