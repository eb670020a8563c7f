"""Whole texts of an Arrow batch as word arrays: splitting and fingerprints without a loop over words.

A word is a maximal run of bytes other than ``\\x20 \\x09-\\x0D`` of the UTF-8 text. Its fingerprint is
a 64-bit polynomial hash over random byte values with a final mix; it is the same in every process.
A null text has no words. Texts are worked on in blocks of about ``BLOCK`` bytes, so memory follows the
block and the longest single text, never the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUES_LOWER = _VALUES[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, _SEGMENT + 1), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Fingerprint of each byte run ``data[starts[i]:ends[i]]``; runs are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    values = _VALUES_LOWER if lower else _VALUES
    i = 0
    while i < len(starts):
        origin = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, origin + _SEGMENT, "right")))
        stop = int(ends[j - 1])
        terms = values[data[origin:stop]]
        terms *= _power(_BASE, stop - origin)[: stop - origin]
        sums = np.zeros(stop - origin + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        at = starts[i:j] - origin
        h = sums[ends[i:j] - origin] - sums[at]
        h *= _power(_BASE_INVERSE, stop - origin)[at]
        out[i:j] = mix(h + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


@dataclass
class Block:
    """Some consecutive rows of a batch: their bytes, and where each text begins."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text where its words begin (rows + 1 entries)."""
        inside = ~_WHITE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], inside))
        after = np.concatenate((inside, [False]))
        begins = after & (~before | edge)
        finishes = before & (~after | edge)
        starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes)
        return starts, ends, np.searchsorted(starts, self.offsets)


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[Block]:
    """The rows of a string column in blocks of at most ``limit`` bytes, or of one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    rows = len(column)
    if not rows:
        return
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    i = 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, rows)
        yield Block(i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
    give_back()


def give_back() -> None:
    """Return freed memory to the machine: Python workers outlive their tasks, and idle ones should be small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """For word positions bounded per row by ``bounds``: the row of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


class Lookup:
    """Values of 64-bit keys: a direct table for the hits, a sorted list for keys that share a slot."""

    def __init__(self, bits: int = 20):
        self._shift = np.uint64(64 - bits)
        self._keys = np.zeros(1 << bits, np.uint64)
        self._values = np.full(1 << bits, -1, np.int64)
        self._more_keys = np.zeros(0, np.uint64)
        self._more_values = np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be distinct and new."""
        slots = (keys >> self._shift).astype(np.int64)
        _, first = np.unique(slots, return_index=True)
        own = np.zeros(len(keys), bool)
        own[first] = self._values[slots[first]] < 0
        self._keys[slots[own]] = keys[own]
        self._values[slots[own]] = values[own]
        if not own.all():
            more = np.concatenate((self._more_keys, keys[~own]))
            order = np.argsort(more, kind="stable")
            self._more_keys = more[order]
            self._more_values = np.concatenate((self._more_values, values[~own]))[order]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it has none."""
        slots = (keys >> self._shift).astype(np.int64)
        out = self._values[slots]
        other = np.flatnonzero(self._keys[slots] != keys)
        out[other] = -1
        if len(other) and len(self._more_keys):
            at = np.minimum(np.searchsorted(self._more_keys, keys[other]), len(self._more_keys) - 1)
            found = self._more_keys[at] == keys[other]
            out[other[found]] = self._more_values[at[found]]
        return out
