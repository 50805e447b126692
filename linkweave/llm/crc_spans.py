"""CRC-32 of many byte spans at once.

The checksum is linear: a byte contributes the same bits wherever the message begins, depending on its value and its distance
from the end alone. So one table by distance and byte holds all contributions, those of a span are combined by
`bitwise_xor.reduceat`, and a constant for each length stands for the register's start and end. Spans longer than the table
are cut into blocks from their end, which are folded in pairs: the front half moves on by the length of the one behind it.
"""

from __future__ import annotations

import zlib

import numpy as np

REACH = 256
"""Distances in the table, so the longest span done in one go."""

WINDOW = 1 << 20
"""Bytes of spans that are spread out at a time."""


def _contributions() -> np.ndarray:
    """[distance, byte]: the register that a byte leaves behind when so many zero bytes follow it."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(0xEDB88320), first >> 1).astype(np.uint32)
    table = np.empty((REACH, 256), np.uint32)
    table[0] = first
    for d in range(1, REACH):
        table[d] = (table[d - 1] >> 8) ^ first[table[d - 1] & 0xFF]
    return table


TABLE = _contributions()
FLAT = TABLE.ravel()
ONES = np.uint32(0xFFFFFFFF)
LENGTHS = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)
"""The checksum of so many zero bytes."""


def _moved(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers after the zero bytes that a mover (four rows of 256) stands for."""
    return by[0][x & 0xFF] ^ by[1][(x >> 8) & 0xFF] ^ by[2][(x >> 16) & 0xFF] ^ by[3][x >> 24]


def _linear(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The contributions of data[start : start + size], combined; sizes are 1 to REACH."""
    out = np.empty(len(start), np.uint32)
    ends = np.cumsum(size)
    k = 0
    while k < len(start):
        before = ends[k - 1] if k else 0
        stop = max(k + 1, int(np.searchsorted(ends, before + WINDOW, "right")))
        n, last = size[k:stop], ends[k:stop] - before
        first = last - n
        at = np.arange(last[-1]) + np.repeat(start[k:stop] - first, n)
        away = np.repeat(start[k:stop] + n - 1, n) - at
        out[k:stop] = np.bitwise_xor.reduceat(FLAT[(away << 8) + data[at]], first)
        k = stop
    return out


BLOCK = TABLE[REACH - 1 : REACH - 5 : -1]
"""Moves a register on by REACH zero bytes: its four bytes contribute like those of a message."""


def _twice(by: np.ndarray) -> np.ndarray:
    return np.stack([_moved(row, by) for row in by])


def _folded(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The contributions of spans of any length above 0, block by block."""
    blocks = -(-size // REACH)
    owner = np.repeat(np.arange(len(size)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)  # from the end of the span
    end = start[owner] + size[owner] - nth * REACH
    low = np.maximum(start[owner], end - REACH)
    value, by = _linear(data, low, end - low), BLOCK
    while len(value) > len(size):
        value = np.where(nth & 1, _moved(value, by), value)
        head = np.flatnonzero((nth & 1) == 0)
        value, nth, by = np.bitwise_xor.reduceat(value, head), nth[head] >> 1, _twice(by)
    return value


def _constants(size: np.ndarray) -> np.ndarray:
    """The checksum of so many zero bytes, any number."""
    value, turns, by = LENGTHS[size % REACH] ^ ONES, size // REACH, BLOCK
    while turns.any():
        value, turns, by = np.where(turns & 1, _moved(value, by), value), turns >> 1, _twice(by)
    return value ^ ONES


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """zlib.crc32 of data[start:end] for each span of bytes."""
    size = end - start
    out = np.zeros(len(size), np.uint32)
    short = np.flatnonzero((size > 0) & (size <= REACH))
    out[short] = _linear(data, start[short], size[short]) ^ LENGTHS[size[short]]
    long = np.flatnonzero(size > REACH)
    if len(long):
        out[long] = _folded(data, start[long], size[long]) ^ _constants(size[long])
    return out
