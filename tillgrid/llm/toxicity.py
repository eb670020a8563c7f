"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

A sentence is the sum of its units: runs of letters, words whose letters stand apart (``i.d.i.o.t``,
``i d i o t``) as one. Two units are alike by the gap-weighted count of their common subsequences of ``ORDER``
letters, plain and normalised, each raised to a power: a letter put in or left out costs little, a shared stem counts
in the plain one whatever the ending, and a few shared letters count next to nothing; a sentence's kernel is the
sum over its units. Landmarks are the
units, and parts of units, that the labels tell apart best. On them the kernel is a vector, on which a linear machine with hinge loss is fitted to
a bounded sample of labelled sentences. As the vector of a sentence is a sum, so is its margin: every unit adds
its own, which is computed once for each distinct unit a worker meets. A text's score is the margin of its
highest sentence, made a probability by a logistic curve over texts that the machine did not learn from.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.language_id import _folded
from tillgrid.llm.support import col, fresh, settle
from tillgrid.llm.textblocks import Block, Lookup, mix, text_blocks

ORDER = 4
DECAY = 0.9
POWER = 2
LONGEST_UNIT = 24  # longer units are cut into windows of this many letters, each overlapping the last by half
LONGEST_PART = 9  # signs of the parts of units that may become landmarks
SENTENCE = 512  # characters; longer sentences end at the next white space
LANDMARKS = 64
SENTENCES = 10_000  # sampled for each label
TEXTS = 10_000  # scored for each label to calibrate
LABELLED = 100_000  # labelled ids that a model is fitted to
_CODES = 64
_HEAD = 27  # stands before the first letter of a unit
_WIDTH = LONGEST_UNIT + 1
_GAP = 0x20
COST = 1.0
NEARLY = 0.95
_KNOWN = 1 << 20  # distinct units a worker keeps
_PAIRS = 1 << 13


def coded(letters: np.ndarray) -> np.ndarray:
    """Letters as 1 to 63: a to z by place, all others by a hash; 0 is no letter."""
    out = np.zeros(letters.shape, np.uint8)
    latin = (letters >= ord("a")) & (letters <= ord("z"))
    out[latin] = letters[latin] - ord("a") + 1
    other = (letters != _GAP) & ~latin
    out[other] = _HEAD + 1 + (mix(letters[other].astype(np.uint64)) >> np.uint64(32)) % np.uint64(_CODES - _HEAD - 1)
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted common subsequences of ``ORDER`` letters of paired rows of codes, 0 behind their ends.

    Each weighs ``DECAY`` to the power of the letters it spans in both.
    """
    rows, width = b.shape
    shift = np.arange(width)
    # Sums over earlier letters of b, each step away weighing DECAY; row j of the matrix gives to column i > j.
    apart = shift[None, :] - shift[:, None]
    reach = np.where(apart > 0, DECAY ** np.maximum(apart - 1, 0), 0.0).astype(np.float32)
    before = [np.zeros((rows, width), np.float32) for _ in range(ORDER)]  # of each order, at letters of a so far
    total = np.zeros(rows, np.float32)
    one = np.float32(DECAY * DECAY)
    for i in range(a.shape[1]):
        equal = ((b == a[:, i : i + 1]) & (b > 0)).astype(np.float32) * one
        new = [equal]
        for p in range(1, ORDER):
            new.append(equal * (before[p - 1] @ reach))
        total += new[-1].sum(axis=1)
        for p in range(ORDER):
            before[p] *= np.float32(DECAY)
            before[p] += new[p]
    return total


@dataclass
class Landmarks:
    """Units to compare with, their letter counts and their own kernels."""

    codes: np.ndarray
    counts: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.counts = letter_counts(self.codes)
        self.own = kernel(self.codes, self.codes)

    def compare(self, units: np.ndarray) -> np.ndarray:
        """Kernels of each unit with each landmark: as a share of the landmark's own, then normalised by both."""
        counts, out = letter_counts(units), np.zeros((len(units), len(self.codes)), np.float32)
        lengths = (units > 0).sum(axis=1)
        for start in range(0, len(units), 4_096):
            rows = slice(start, start + 4_096)
            # Without as many letters in common no subsequence is: those pairs are zero.
            shared = np.zeros((len(counts[rows]), len(self.codes)), np.uint8)
            for letter in np.flatnonzero(self.counts.any(axis=0)):
                shared += np.minimum(counts[rows, letter : letter + 1], self.counts[:, letter])
            u, z = np.nonzero(shared >= ORDER)
            u += start
            order = np.argsort(lengths[u], kind="stable")  # like lengths together, so padding is short
            for i in range(0, len(order), _PAIRS):
                at = order[i : i + _PAIRS]
                value = kernel(units[u[at], : lengths[u[at]].max()], self.codes[z[at]])
                out[u[at], z[at]] = value
        live = np.flatnonzero(out.any(axis=1))
        own = np.ones(len(units), np.float32)
        for i in range(0, len(live), _PAIRS):
            own[live[i : i + _PAIRS]] = kernel(units[live[i : i + _PAIRS]], units[live[i : i + _PAIRS]])
        return np.concatenate((out / self.own, out / np.sqrt(own[:, None] * self.own)), axis=1) ** POWER


    def whitening(self) -> np.ndarray:
        """Nyström: what makes the landmarks' kernels among themselves, of either kind, the identity."""
        n = len(self.codes)
        normalised = self.compare(self.codes)[:, n:].astype(np.float64)
        out = np.zeros((2 * n, 2 * n))
        # Shares of the own kernel are the plain kernel after scaling the landmarks, which leaves this matrix as it is.
        for block in (slice(0, n), slice(n, 2 * n)):
            values, vectors = np.linalg.eigh((normalised + normalised.T) / 2)
            out[block, block] = vectors / np.sqrt(np.maximum(values, 1e-6))
        return out


def letter_counts(units: np.ndarray) -> np.ndarray:
    flat = np.arange(len(units))[:, None] * _CODES + units
    counts = np.bincount(flat[units > 0], minlength=len(units) * _CODES)
    return counts.reshape(len(units), _CODES).astype(np.uint8)


@dataclass
class Units:
    """The units of a block by text and sentence, and each text's first sentence (rows + 1 entries)."""

    letters: np.ndarray  # of all units, one after another
    starts: np.ndarray
    ends: np.ndarray
    heads: np.ndarray  # whether a unit is the first window of its own
    sentence: np.ndarray
    bounds: np.ndarray
    keys: np.ndarray

    def codes(self, at: np.ndarray) -> np.ndarray:
        """Codes of some units as rows, filled up with zeros."""
        place = self.starts[at][:, None] + np.arange(-1, LONGEST_UNIT)
        inside = place < self.ends[at][:, None]
        inside[:, 0] = False
        out = np.zeros(place.shape, np.uint8)
        out[inside] = coded(self.letters[place[inside]])
        return with_heads(out, self.heads[at])

    def text(self, i: int) -> str:
        """The unit as text, ``+`` before one that goes on another."""
        text = self.letters[self.starts[i] : self.ends[i]].astype("<u4").tobytes().decode("utf-32-le", "replace")
        return text if self.heads[i] else "+" + text


def with_heads(codes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Rows whose first column is free, with the sign of a unit's head; the others move up to fill it."""
    out = np.zeros_like(codes)
    out[:, :-1] = codes[:, 1:]
    out[heads] = codes[heads]
    out[heads, 0] = _HEAD
    return out


_ENDS = np.zeros(128, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def units(block: Block) -> Units:
    """Units of ``ORDER`` letters and more, lower-cased.

    Sentences end at ``. ! ?`` before white space, at line ends, and at white space once they are long. Runs of
    letters are one unit if only signs part them and one has fewer than ``ORDER`` letters, or if only white
    space does and both are single letters.
    """
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))[block.offsets]
    text, n = _folded(points), len(points)
    letter = text != _GAP
    white = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    opens = np.zeros(n + 1, bool)  # a sentence starts here
    opens[1:] = _ENDS[np.minimum(points, 127)] & ((points == 0x0A) | np.append(white[1:], True)[:n])
    opens[heads] = opens[n] = True
    cuts = np.flatnonzero(opens)
    for i in np.flatnonzero(np.diff(cuts) > SENTENCE):
        gaps = np.flatnonzero(white[cuts[i] : cuts[i + 1]])
        opens[cuts[i] + gaps[1:][np.diff(gaps // SENTENCE) > 0]] = True
    begins = np.flatnonzero(opens[:n])
    sentence = np.cumsum(opens[:n]) - 1
    # Runs of letters, and which of them go on the one before.
    starts = np.flatnonzero(letter & (np.append(True, ~letter[:-1])[:n] | opens[:n]))
    ends = np.flatnonzero(letter & (np.append(~letter[1:], True)[:n] | opens[1:])) + 1
    of, size = sentence[starts], ends - starts
    spaces = np.concatenate(([0], np.cumsum(white)))
    joins = np.zeros(len(starts), bool)
    if len(starts):
        apart = spaces[starts[1:]] > spaces[ends[:-1]]
        short = np.minimum(size[1:], size[:-1]) < ORDER
        joins[1:] = (of[1:] == of[:-1]) & np.where(apart, (size[1:] == 1) & (size[:-1] == 1), short)
    first = np.flatnonzero(~joins)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    place = np.concatenate(([0], np.cumsum(letter)))  # among the letters alone
    a, b, of = place[starts[first]], place[ends[last]], of[first]
    able = b - a >= ORDER
    a, b, of = a[able], b[able], of[able]
    # Long units in windows.
    half = LONGEST_UNIT // 2
    pieces = np.maximum(1, -(-(b - a - half) // half))
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a, b, of = np.repeat(a, pieces) + step * half, np.repeat(b, pieces), np.repeat(of, pieces)
    b = np.minimum(b, a + LONGEST_UNIT)
    letters = text[letter]
    keys = (b - a + (step > 0) * 64).astype(np.uint64)
    live = np.arange(len(a))
    for i in range(LONGEST_UNIT):
        live = live[a[live] + i < b[live]]
        keys[live] = (keys[live] ^ letters[a[live] + i]) * np.uint64(0x9E3779B97F4A7C15)
        keys[live] ^= keys[live] >> np.uint64(29)
    return Units(letters, a, b, step == 0, of, np.searchsorted(begins, heads), mix(keys))


_known: dict[str, tuple[Lookup, np.ndarray]] = {}


@dataclass
class Model:
    landmarks: Landmarks | None
    weights: np.ndarray  # of the landmarks' kernels
    bias: float
    slope: float = 0.0  # of the logistic curve over margins
    intercept: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def margins(self, block: Block, bent: bool = False) -> np.ndarray:
        """Margin of each text's highest sentence; a text without units has the bias alone.

        ``bent`` reads every unit with a letter put in.
        """
        out = np.full(block.rows, self.bias)
        if self.landmarks is None:
            return out
        found = units(block)
        if not len(found.keys):
            return out
        if bent:
            found.keys = mix(found.keys)
        table, known = _known.get(self.name) or (Lookup(21), np.zeros(0, np.float32))
        if len(known) > _KNOWN:
            table, known = Lookup(21), np.zeros(0, np.float32)
        entries = table.get(found.keys)
        new = np.flatnonzero(entries < 0)
        if len(new):
            distinct, first, back = np.unique(found.keys[new], return_index=True, return_inverse=True)
            table.add(distinct, np.arange(len(known), len(known) + len(distinct)))
            entries[new] = len(known) + back
            codes = found.codes(new[first])
            values = self.landmarks.compare(_with_insertions(codes) if bent else codes) @ self.weights
            known = np.concatenate((known, np.round(values, 4).astype(np.float32)))  # free of the order of sums
        _known.clear()  # a worker keeps the units of one model
        _known[self.name] = table, known
        own = self.bias + np.bincount(found.sentence, known[entries], minlength=found.bounds[-1])
        full = np.flatnonzero(np.diff(found.bounds) > 0)
        out[full] = np.maximum.reduceat(own, found.bounds[:-1][full]) if len(full) else out[full]
        return out

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.intercept, -500, 500)))


def support_vectors(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of least |w|²/2 + sum of cost · max(0, 1 - y f)², by Newton steps on the active rows."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    ridge = np.append(np.ones(x.shape[1] - 1), 1e-3)
    w = np.zeros(x.shape[1])

    def loss(w):
        return (ridge * w * w).sum() / 2 + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(rounds):
        active = 1 - y * (x @ w) > 0
        xa, ca = x[active], cost[active]
        slope = ridge * w - 2 * xa.T @ (ca * (y[active] - xa @ w))
        step = np.linalg.solve(2 * xa.T @ (xa * ca[:, None]) + np.diag(ridge), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def logistic(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of P(1 | margin); targets keep one in as many as there are, and two, in doubt."""
    ones, zeros = weights[labels == 1].sum(), weights[labels == 0].sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack((margins, np.ones(len(margins))), axis=1)
    w = np.array([0.0, np.log((ones + 1) / (zeros + 1))])

    def loss(w):
        z = x @ w
        return (weights * (np.logaddexp(0, z) - target * z)).sum()

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (weights * (p - target))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def _with_insertions(codes: np.ndarray) -> np.ndarray:
    """Each unit with one letter put in behind its first half."""
    lengths = (codes > 0).sum(axis=1)
    at = lengths // 2
    shift = np.arange(codes.shape[1])
    out = np.where(shift[None, :] <= at[:, None], codes, np.roll(codes, 1, axis=1))
    out[np.arange(len(codes)), np.minimum(at, codes.shape[1] - 1)] = 1 + _code_keys(codes) % np.uint64(26)
    return out


_CODE_WEIGHTS = mix(np.arange(1, _WIDTH + 1, dtype=np.uint64))


def _code_keys(codes: np.ndarray) -> np.ndarray:
    return mix((codes.astype(np.uint64) * _CODE_WEIGHTS).sum(axis=1))


def as_codes(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), _WIDTH), np.uint8)
    for i, text in enumerate(texts):
        points = np.frombuffer(text.lstrip("+").encode("utf-32-le", "replace"), np.uint32)
        out[i, 1 : len(points) + 1] = coded(points)
    return with_heads(out, np.array([not text.startswith("+") for text in texts], bool))


def fragments(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, fragment) pairs without repeats, and the fragments: parts of 4 to 9 signs, the head among them, and whole units."""
    lengths = (codes > 0).sum(axis=1)
    units_, parts, keys = [np.arange(len(codes))], [codes], [_code_keys(codes)]
    for size in range(ORDER, LONGEST_PART + 1):
        for at in range(_WIDTH - size + 1):
            of = np.flatnonzero(lengths >= at + size)
            part = np.zeros((len(of), _WIDTH), np.uint8)
            part[:, :size] = codes[of, at : at + size]
            units_.append(of)
            parts.append(part)
            keys.append(_code_keys(part))
    units_, parts = np.concatenate(units_), np.concatenate(parts)
    _, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return np.unique(np.stack((units_, back), axis=1), axis=0), parts[first]


def choose_landmarks(said: np.ndarray, labels: np.ndarray, codes: np.ndarray, count: int) -> np.ndarray:
    """Codes of the fragments by which sentences of label 1 are told apart, then of frequent units.

    ``said`` are (sentence, unit) pairs, ``codes`` the units. One fragment after another is taken, the one whose
    sentences lie farthest from the labels' shares by likelihood ratio, the longest of those nearly as far; its
    sentences are settled and no longer count. The last is beyond what the best of so many would reach by chance.
    """
    of, parts = fragments(codes)
    bounds = np.searchsorted(of[:, 0], np.arange(len(codes) + 1))
    sizes = np.diff(bounds)[said[:, 1]]
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[said[:, 1]], sizes)
    pairs = np.unique(np.repeat(said[:, 0], sizes) * len(parts) + of[place, 1])
    sentence, part = np.divmod(pairs, len(parts))
    lengths = (parts > 0).sum(axis=1)
    rate, chance = labels.mean(), 2 * np.log(len(parts) + 1)
    chosen: list[int] = []
    seen = np.bincount(part, minlength=len(parts))
    often = seen[part] >= 4
    sentence, part = sentence[often], part[often]
    while len(chosen) < count * 3 // 4 and len(part):
        ones = np.bincount(part, labels[sentence], minlength=len(parts))
        seen = np.bincount(part, minlength=len(parts))
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.nan_to_num(ones * np.log(ones / (seen * rate)))
            down = np.nan_to_num((seen - ones) * np.log((seen - ones) / (seen * (1 - rate))))
        told = np.where(ones > seen * rate, 2 * (up + down), 0.0)
        if told.max() <= chance:
            break
        best = int(np.lexsort((-told, np.where(told >= NEARLY * told.max(), -lengths, 0)))[0])
        chosen.append(best)
        settled = np.zeros(len(labels), bool)
        settled[sentence[part == best]] = True
        open_ = ~settled[sentence]
        sentence, part = sentence[open_], part[open_]
    usual = np.bincount(said[:, 1], minlength=len(codes))
    more = codes[np.lexsort((np.arange(len(codes)), -usual))[: count // 4]]
    return np.unique(np.concatenate((parts[chosen], more)), axis=0)


def labelled(labels: DataFrame, id_col: str, label_col: str, most: int = LABELLED) -> DataFrame:
    """``label_id`` and ``label`` of at most ``most`` labelled ids, drawn evenly by a hash of the id.

    Ids whose labels disagree count as 1. So few rows may be broadcast: texts then stay where they lie.
    """
    known = labels.where(col(id_col).isNotNull() & col(label_col).isin(0, 1))
    one = known.groupBy(col(id_col).alias("label_id")).agg(F.max(col(label_col)).alias("label"))
    return one.orderBy(F.xxhash64("label_id", F.lit(29)), "label_id").limit(most)


def fit(
    train: DataFrame,
    label: Column,
    text_col: str = "text",
    landmarks: int = LANDMARKS,
    sentences: int = SENTENCES,
    texts: int = TEXTS,
) -> Model:
    """Fit on the rows whose ``label`` is 0 or 1; all others teach nothing.

    A fifth of the texts, by a hash of the text, is kept for calibration, as they are and with a letter put into
    every unit. Of the sentences of the rest at most
    ``sentences`` distinct ones of each label, those of smallest hash, are the sample that the machine is fitted
    to on the driver, each at most ``SENTENCE`` characters and a word long; a task sends no more than that. At most ``texts``
    margins of each label set the curve, weighted to the numbers of all rows. Labels of one kind
    only give every text the share of that kind.
    """
    rows = train.select(col(text_col).cast("string").alias("text"), label.cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1))
    apart = F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(13)), F.lit(5)) == 0
    sizes = {(r["label"], r["apart"]): r["count"] for r in rows.groupBy("label", apart.alias("apart")).count().collect()}
    n = [sum(v for k, v in sizes.items() if k[0] == y) for y in (0, 1)]
    flat = Model(None, np.zeros(0), 0.0, 0.0, float(np.log((n[1] + 1) / (n[0] + 1))))
    if not all(n):
        return flat

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[int, str]] = [{}, {}]
        least = [np.uint64((1 << 64) - 1)] * 2

        def prune() -> None:
            for y in (0, 1):
                if len(held[y]) > sentences:
                    kept = sorted(held[y])[:sentences]
                    least[y] = np.uint64(kept[-1])
                    held[y] = {k: held[y][k] for k in kept}

        for batch in batches:
            labels = batch.column("label").to_numpy()
            for block in text_blocks(batch.column("text")):
                found = units(block)
                if not len(found.keys):
                    continue
                cuts = np.flatnonzero(np.append(True, np.diff(found.sentence) > 0))
                keys = mix(np.add.reduceat(found.keys, cuts))
                row = np.searchsorted(found.bounds, found.sentence[cuts], "right") - 1
                y = labels[block.first + row]
                stops = np.append(cuts[1:], len(found.keys))
                for i in np.flatnonzero(keys <= np.where(y == 1, least[1], least[0])):
                    if (k := int(keys[i])) not in held[y[i]]:
                        held[y[i]][k] = " ".join(found.text(j) for j in range(cuts[i], stops[i]))
                if max(map(len, held)) > 2 * sentences:
                    prune()
        prune()
        for y in (0, 1):
            keys = np.array(sorted(held[y]), np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), y, np.int32)), pa.array(keys.view(np.int64)), pa.array([held[y][int(k)] for k in keys], pa.string())],
                names=["label", "key", "said"],
            )

    drawn = rows.where(~apart).mapInArrow(smallest, "label int, key long, said string")
    # Keys are unsigned: the order of the tasks' choice.
    drawn = drawn.withColumn("place", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    drawn = settle(drawn.groupBy("label", "place").agg(F.min("said").alias("said")))
    sample = [r for y in (0, 1) for r in drawn.where(F.col("label") == y).orderBy("place").limit(sentences).collect()]
    labels = np.array([r["label"] for r in sample], np.int64)
    if len(np.unique(labels)) < 2:
        return flat
    said = [r["said"].split(" ") for r in sample]
    names = sorted({u for one in said for u in one})
    index = {u: i for i, u in enumerate(names)}
    pairs = np.array([(i, index[u]) for i, one in enumerate(said) for u in one], np.int64)
    codes = as_codes(names)
    marks = Landmarks(choose_landmarks(np.unique(pairs, axis=0), labels, codes, landmarks))
    whiten = marks.whitening()
    # The sample as it is, and with a letter put into every unit.
    begins = np.flatnonzero(np.append(True, np.diff(pairs[:, 0]) > 0))
    vectors = []
    for form in (codes, _with_insertions(codes)):
        per_unit = marks.compare(form) @ whiten.astype(np.float32)
        for i in range(0, len(begins), 1_000):  # not all units' vectors at once
            own = begins[i : i + 1_000]
            stop = begins[i + 1_000] if i + 1_000 < len(begins) else len(pairs)
            vectors.append(np.add.reduceat(per_unit[pairs[own[0] : stop, 1]], own - own[0], dtype=np.float64))
    x, y = np.concatenate(vectors), np.tile(labels, 2)
    # Each label weighs what it does among all rows, not in the sample.
    cost = np.where(y == 1, n[1] / (y == 1).sum(), n[0] / (y == 0).sum()) * len(y) / sum(n)
    w, bias = support_vectors(x, np.where(y == 1, 1.0, -1.0), cost * COST)
    model = Model(marks, whiten @ w, bias)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bent in (False, True):
                margins = [model.margins(b, bent) for b in text_blocks(batch.column("text"))]
                cells = [batch.column("label"), batch.column("place"), pa.array(np.concatenate([np.zeros(0), *margins]))]
                yield pa.RecordBatch.from_arrays(cells, names=["label", "place", "margin"])

    place = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(17)).alias("place")
    tested = rows.where(apart).select("label", place, "text").mapInArrow(judge, "label int, place long, margin double")
    tested = settle(tested)
    held = [r for y in (0, 1) for r in tested.where(F.col("label") == y).orderBy("place", "margin").limit(2 * texts).collect()]
    if len({r["label"] for r in held}) < 2:  # too few to set a curve: margins of one half are even
        model.slope, model.intercept = 2.0, 0.0
        return model
    labels = np.array([r["label"] for r in held])
    drawn_of = np.bincount(labels, minlength=2)
    weights = np.array([sizes.get((y, True), 0) / drawn_of[y] for y in labels])
    model.slope, model.intercept = logistic(np.array([r["margin"] for r in held]), labels, weights)
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``score`` of each row, after the columns of ``keep``: the probability that its text is toxic.

    A null, empty or letterless text has the score of a sentence without units. Every text is read whole; a
    very long one takes some 100 bytes a character. Rows without an id and repeated rows are rows like
    others, an empty table stays empty, and only the texts go to Python.
    """

    @F.arrow_udf("double")
    def predict(texts: pa.Array) -> pa.Array:
        margins = [model.margins(block) for block in text_blocks(texts)]
        return pa.array(model.scores(np.concatenate([np.zeros(0), *margins])))

    (found,) = fresh(df, "found")
    rows = df.select(*(keep or []), predict(col(text_col).cast("string")).alias(found))
    return rows.select(*[col(c) for c in rows.columns[:-1]], col(found).alias("score"))
