"""Periodic runs of words by block convolution.

A run of period q and at least 4q words holds, in its first half, an aligned block of b = 2**s words with
b <= q < 2b, and that block occurs again q words on. So at each dyadic scale every aligned block of every text
long enough meets the window of the b distances from b on: the sum of squared differences of word codes is
expanded, and its cross term is a convolution by a number-theoretic transform modulo a prime. Codes are taken
so small that the whole sum stays below the prime; a residue of zero is then a zero-mismatch occurrence, no
rounding about it. Consecutive blocks with one distance are one seed; it is compared word by word and extended
by less than a block to each side, which gives the whole stretch of equal words at that distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillgrid.llm.support import col
from tillgrid.llm.textblocks import Block, run_hashes, text_blocks

PRIME = 7_340_033  # 7 * 2**20 + 1; sums of 64 products of two residues are exact in a double
GENERATOR = 3
LARGEST_BLOCK = 1 << 19  # a transform of twice as many words is the longest this prime has
LEAST_WORDS = 6
LEAST_PERIODS = 4
_RADIX = 32
_SLAB = 1 << 17  # numbers transformed at once
RUNS = "array<struct<start:long,length:long,period:long>>"


def reduced(x: np.ndarray) -> np.ndarray:
    """Residues of whole doubles in place, about zero."""
    x -= np.rint(x * (1.0 / PRIME)) * PRIME
    return x


def _powers(root: int, exponents: np.ndarray) -> np.ndarray:
    """Powers of a root of unity, about zero."""
    table = np.empty(int(exponents.max(initial=0)) + 1, np.int64)
    table[0] = 1
    filled = 1
    while filled < len(table):  # doubles what is known
        more = min(filled, len(table) - filled)
        table[filled : filled + more] = table[:more] * (table[filled - 1] * root % PRIME) % PRIME
        filled += more
    return reduced(table[exponents].astype(np.float64))


@cache
def _step(size: int, inverse: bool) -> tuple[int, np.ndarray, np.ndarray | None]:
    """The radix of a transform's first step, its matrix, and the twiddle factors before the rest."""
    radix = min(size, _RADIX)
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    i = np.arange(radix)
    matrix = _powers(pow(root, size // radix, PRIME), np.outer(i, i) % radix)
    rest = size // radix
    return radix, matrix, _powers(root, np.outer(i, np.arange(rest))) if rest > 1 else None


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row; the order of the result is that of ``frequencies``."""
    rows, size = x.shape
    radix, matrix, twiddles = _step(size, False)
    if twiddles is None:
        return reduced(x @ matrix)
    y = reduced(x.reshape(rows, radix, -1).swapaxes(1, 2).reshape(-1, radix) @ matrix).reshape(rows, -1, radix)
    y *= twiddles.T
    return transform(reduced(y).swapaxes(1, 2).reshape(rows * radix, -1)).reshape(rows, size)


def inverse(x: np.ndarray) -> np.ndarray:
    """Rows from what ``transform`` made of them, times their length."""
    rows, size = x.shape
    radix, matrix, twiddles = _step(size, True)
    if twiddles is None:
        return reduced(x @ matrix)
    y = inverse(x.reshape(rows * radix, -1)).reshape(rows, radix, -1)
    y *= twiddles
    y = reduced(reduced(y).swapaxes(1, 2).reshape(-1, radix) @ matrix).reshape(rows, -1, radix)
    return y.swapaxes(1, 2).reshape(rows, size)


def frequencies(size: int) -> np.ndarray:
    radix = min(size, _RADIX)
    if radix == size:
        return np.arange(size)
    return (np.arange(radix)[:, None] + radix * frequencies(size // radix)).ravel()


@cache
def _mirror(size: int) -> np.ndarray:
    """Where the negated frequency of each place stands."""
    own = frequencies(size)
    place = np.empty(size, np.int64)
    place[own] = np.arange(size)
    return place[-own % size]


def occurrences(codes: np.ndarray, starts: np.ndarray, block: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """All (start, distance) with equal codes, for blocks at the starts and distances from ``first`` on.

    ``block`` distances are tried. Codes must be below the square root of PRIME / block, and go on for
    first + 2 * block words behind the last start.
    """
    size = 2 * block
    squares = np.concatenate(([0], np.cumsum(codes * codes)))
    scale = float(pow(size, PRIME - 2, PRIME) * 2 % PRIME)
    at, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, _SLAB // size)
    for i in range(0, len(starts), step):
        x = starts[i : i + step]
        own = np.zeros((len(x), size))
        own[:, :block] = codes[x[:, None] + np.arange(block)]
        window = codes[(x + first)[:, None] + np.arange(size)].astype(np.float64)
        product = transform(own)[:, _mirror(size)]
        product *= transform(window)
        cross = inverse(reduced(product))[:, :block]
        cross *= scale if scale < PRIME / 2 else scale - PRIME
        w = (x + first)[:, None] + np.arange(block)
        whole = (squares[x + block] - squares[x])[:, None] + squares[w + block] - squares[w]
        row, distance = np.nonzero(reduced(whole - reduced(cross)) == 0)
        at.append(x[row])
        far.append(first + distance)
    return np.concatenate(at), np.concatenate(far)


def _ragged(lows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each low on, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lows - (ends - sizes), sizes)


class _Runs:
    """Runs found so far, and whether a stretch lies within one of a period that divides another."""

    def __init__(self) -> None:
        self.rows = np.zeros((0, 3), np.int64)  # start, end, period

    def add(self, rows: np.ndarray) -> None:
        rows = np.concatenate((self.rows, rows))
        self.rows = rows[np.lexsort((rows[:, 0], rows[:, 2]))]

    def cover(self, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), bool)
        known, first = np.unique(self.rows[:, 2], return_index=True)
        for q, a, b in zip(known, first, [*first[1:], len(self.rows)]):
            # Runs of one period follow one another by start and by end.
            of = np.flatnonzero((periods % q == 0) & (periods > q) & ~out)
            place = np.searchsorted(self.rows[a:b, 0], starts[of], "right") - 1
            out[of] = (place >= 0) & (self.rows[a:b, 1][place] >= ends[of])
        return out


def _stretches(words: np.ndarray, low: np.ndarray, high: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Maximal (seed, start, end) within [low, high) of each seed where words ``far`` apart are equal."""
    sizes = high - low
    i = _ragged(low, sizes)
    same = words[i] == words[i + np.repeat(far, sizes)]
    edge = np.zeros(len(i) + 1, bool)
    edge[np.cumsum(sizes) - sizes] = True
    before, after = np.concatenate(([False], same)), np.concatenate((same, [False]))
    begins, finishes = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    seed = np.searchsorted(np.cumsum(sizes), begins, "right")
    return np.stack((seed, i[begins], i[begins] + finishes - begins), axis=1)


def runs_of(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(text, start, length, period) of all runs, by text, start and period.

    ``words`` are fingerprints of the words of several texts, ``bounds`` where each text's begin (one more
    entry than texts). Memory is some 60 bytes a word and a slab of fixed size.
    """
    found = _Runs()
    sizes = np.diff(bounds)
    scale = 1
    while (long := np.flatnonzero(sizes >= max(LEAST_WORDS, LEAST_PERIODS * scale))).size:
        block = min(scale, LARGEST_BLOCK)
        kinds = int((PRIME / block) ** 0.5)
        codes = np.zeros(len(words) + 3 * scale + 2 * block, np.int64)
        codes[: len(words)] = (words % np.uint64(kinds)).astype(np.int64)
        per_text = (sizes[long] - block) // scale  # starts whose window begins within the text
        text = np.repeat(long, per_text)
        starts = bounds[text] + _ragged(np.zeros(len(long), np.int64), per_text) * scale
        seeds = []
        for first in range(scale, 2 * scale, block):
            at, far = occurrences(codes, starts, block, first)
            own = text[np.searchsorted(starts, at)]
            inside = at + far + block <= bounds[own + 1]
            seeds.append(np.stack((own, far, at), axis=1)[inside])
        seeds = np.concatenate(seeds)
        seeds = seeds[np.lexsort((seeds[:, 2], seeds[:, 1], seeds[:, 0]))]
        # Consecutive blocks of one text with one distance are one seed.
        new = np.ones(len(seeds), bool)
        new[1:] = (np.diff(seeds[:, :2], axis=0) != 0).any(axis=1) | (np.diff(seeds[:, 2]) != scale)
        head = np.flatnonzero(new)
        own, far, low = seeds[head].T
        high = seeds[np.append(head[1:], len(seeds)) - 1, 2] + block if len(head) else low
        open_ = ~found.cover(low, high + far, far)
        own, far, low, high = own[open_], far[open_], low[open_], high[open_]
        # The next block to either side holds a word that differs, or the text's end.
        low = np.maximum(low - scale, bounds[own])
        high = np.minimum(high + scale, bounds[own + 1] - far)
        spans = _stretches(words, low, high, far)
        seed, start, end = spans.T
        period = far[seed]
        keep = end - start + period >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        runs = np.unique(np.stack((start, end + period, period), axis=1)[keep], axis=0)
        found.add(runs[~found.cover(runs[:, 0], runs[:, 1], runs[:, 2])])
        scale *= 2
    start, end, period = found.rows.T
    text = np.searchsorted(bounds, start, "right") - 1
    rows = np.stack((text, start - bounds[text], end - start, period), axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _collapsed(block: Block, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, runs: np.ndarray) -> list[bytes]:
    """Each text's words joined by one space, without those that a run holds behind its first period."""
    repeats = np.zeros(len(starts) + 1, np.int64)
    first = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(repeats, first + runs[:, 3], 1)
    np.add.at(repeats, first + runs[:, 2], -1)
    kept = np.cumsum(repeats[:-1]) == 0
    # Bytes of kept words, and one space before each but the first of a text.
    sizes = np.where(kept, ends - starts + 1, 0)
    at = _ragged(starts - 1, sizes)
    data = block.data[np.maximum(at, 0)]
    after = np.cumsum(sizes)
    data[(after - sizes)[kept]] = 0x20
    cuts = np.concatenate(([0], after))[bounds]
    whole = data.tobytes()
    return [whole[a + 1 : b] for a, b in zip(cuts, cuts[1:])]


def _runs_and_rest(texts: pa.Array) -> list[pa.Array]:
    counts, values, rest = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)], []
    for block in text_blocks(texts):
        starts, ends, bounds = block.words()
        runs = runs_of(run_hashes(block.data, starts, ends), bounds)
        counts.append(np.bincount(runs[:, 0], minlength=block.rows))
        values.append(runs[:, 1:])
        rest += _collapsed(block, starts, ends, bounds, runs)
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)
    fields = [pa.array(c) for c in np.concatenate(values).T]
    structs = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
    return [pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(rest, pa.binary()).cast(pa.string())]


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, its ``runs`` by start and period, and the text ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch with smallest period q, at least six and 4q words,
    that no neighbouring word extends; start and length are in words, start from 0. The collapsed text is the
    words, joined by one space, that no run holds behind its first period. A null, empty or blank text has
    no runs and collapses to the empty text. Rows without an id and repeated rows are rows like others; an empty
    table stays empty. Every row is worked on where it lies, without a shuffle, and no other column is read. A
    very long text takes some 60 bytes a word, more only where it holds many runs; its transforms work on slabs
    of fixed size. Words are compared by 64-bit fingerprints.
    """
    rows = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _runs_and_rest(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *found], names=["id", "runs", "collapsed"])

    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(f"runs {RUNS}, collapsed string").fields])
    return rows.mapInArrow(find, schema)
