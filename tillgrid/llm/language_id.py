"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

Characters are lower-cased, and everything but letters is a gap. Grams of one to three characters are hashed
to ``1 << BITS`` features; a feature's value is its share of the text's grams times its inverse document
frequency, counted over all training rows. The weights are fitted by follow-the-regularised-leader with an
elastic net on a sample of at most ``per_language`` rows of each language, those of smallest hash of id and text,
and a temperature calibrated on a fifth of the sample makes scores honest. Every text is then predicted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrid.llm.support import col, fresh
from tillgrid.llm.textblocks import Block, mix, text_blocks

BITS = 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1_000
SCALE = 100.0
UNKNOWN = "und"
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_GAP = 0x20
_fold: list[np.ndarray] = []


def _folded(points: np.ndarray) -> np.ndarray:
    """Letters lower-cased, all else a gap."""
    if not _fold:
        table = np.full(1 << 16, _GAP, np.uint32)
        for c in range(1 << 16):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold.append(table)
    out = _fold[0][np.minimum(points, 0xFFFF)]
    wide = np.flatnonzero(points > 0xFFFF)
    if len(wide):
        distinct, back = np.unique(points[wide], return_inverse=True)
        out[wide] = np.array([ord(chr(c).lower()) if chr(c).isalpha() else _GAP for c in distinct], np.uint32)[back]
    return out


def grams(block: Block) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the features of all grams and where each text's begin; and the letters of each text."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))[block.offsets]
    text = _folded(points)
    letter = text != _GAP
    out = []
    for order in ORDERS:
        n = max(0, len(text) - order + 1)
        h = np.full(n, order, np.uint64)
        known = np.zeros(n, bool)
        for i in range(order):
            h += text[i : i + n] * _PRIMES[i]
            known |= letter[i : i + n]
        for head in heads[1:-1] if order > 1 else ():  # grams do not cross texts
            known[max(0, head - order + 1) : head] = False
        at = np.flatnonzero(known)
        features = (mix(h[at]) >> np.uint64(64 - BITS)).astype(np.int32)
        out.append((features, np.searchsorted(at, heads)))
    return out, np.diff(np.concatenate(([0], np.cumsum(letter)))[heads])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages, with idf and scale folded in
    bias: np.ndarray
    temperature: float

    def predict(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Language index (-1: unknown) and score of each text."""
        by_order, letters = grams(block)
        able = (letters > 0) & bool(self.languages)
        best, score = np.full(block.rows, -1), np.zeros(block.rows)
        if not able.any():
            return best, score
        total = np.zeros((block.rows, len(self.languages)))
        count = np.zeros(block.rows)
        for features, bounds in by_order:
            full = np.flatnonzero(np.diff(bounds) > 0)
            count += np.diff(bounds)
            for c in range(0, len(self.languages) if len(full) else 0, 8):
                rows = self.weights[:, c : c + 8][features]
                total[full, c : c + 8] += np.add.reduceat(rows, bounds[full], axis=0, dtype=np.float64)
        logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        best[able] = p.argmax(axis=1)[able]
        score[able] = p.max(axis=1)[able]
        return best, score


def ftrl(examples: list, labels: np.ndarray, classes: int, *, alpha=0.5, beta=0.1, l1=0.02, l2=0.01, epochs=4):
    """Weights (features x classes) and bias by follow-the-regularised-leader, one example at a time."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    order = np.arange(len(examples))
    bias_at = size - 1

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for epoch in range(epochs):
        order = order[np.argsort(mix(order.astype(np.uint64) + np.uint64(epoch * 7919)))]
        for i in order:
            at, x = examples[i]
            at, x = np.append(at, bias_at), np.append(x, 1.0)
            w = weights(z[at], n[at], l1)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = weights(z, n, l1)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by narrowing a grid of powers.

    One error in as many rows as there are, plus two, is held possible; so a sample without errors does not
    make the scores certain.
    """
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    doubt = 1 / (len(labels) + 2)
    target = np.full(logits.shape, doubt / (logits.shape[1] - 1))
    target[np.arange(len(labels)), labels] = 1 - doubt

    def loss(t):
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - (target * x).sum(axis=1)).mean())

    low, high = -4.0, 4.0
    for _ in range(6):
        grid = np.linspace(low, high, 9)
        best = grid[int(np.argmin([loss(2.0**g) for g in grid]))]
        step = (high - low) / 8
        low, high = best - step, best + step
    return float(2.0**best)


def _last_draws(rows: DataFrame, sizes: dict[str, int], per_language: int, spare: float | None) -> dict[str, int]:
    """The draw up to which each language has its sample; a language of whose rows too few were looked at is left out.

    Draws are even, so ``spare`` times the sample's share of the rows is looked at: no task meets all rows of a
    language. Without it every draw of the rows is, once each.
    """
    looked = rows.select("lang", "draw")
    if spare is not None:
        limit = F.lit(None).cast("long")
        for lang, n in sizes.items():
            share = min(1.0, spare * per_language / n)
            top = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
            limit = F.when(F.col("lang") == lang, top).otherwise(limit)
        looked = looked.where(F.col("draw") <= limit)
    order = Window.partitionBy("lang").orderBy("draw")
    first = looked.groupBy("lang", "draw").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(order))
    ends = first.where(F.col("place") <= per_language).groupBy("lang").agg(F.max("draw").alias("draw"), F.sum("n").alias("n"))
    found = ends.collect()  # one row per language
    return {r["lang"]: r["draw"] for r in found if spare is None or r["n"] >= min(per_language, sizes[r["lang"]])}


def fit(train: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the rows given; those without a language or a letter teach nothing.

    Rows that share an id are drawn by their texts, and equal ones up to the size of the sample. A very long
    text is read whole, at some 40 times its size in memory, and gives one row of at most ``1 << BITS`` features.
    """
    rows = train.where(col(lang_col).isNotNull()).select(
        col(text_col).cast("string").alias("text"),
        col(lang_col).cast("string").alias("lang"),
        F.xxhash64(col(id_col), col(text_col).cast("string"), F.lit(1)).alias("draw"),
    )
    sizes = {lang: n for lang, n in rows.groupBy("lang").count().collect()}  # one row per language
    last = _last_draws(rows, sizes, per_language, 4.0)
    # Where rows are so alike that they share draws, the first look may find too few of them.
    if few := {lang: n for lang, n in sizes.items() if lang not in last}:
        last |= _last_draws(rows.where(F.col("lang").isin(list(few))), few, per_language, None)
    languages = sorted(last)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << BITS) + 1, np.int64)  # the last entry counts texts
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                by_order, letters = grams(block)
                for row in np.flatnonzero(letters):
                    mark = np.zeros(1 << BITS, bool)
                    for features, bounds in by_order:
                        mark[features[bounds[row] : bounds[row + 1]]] = True
                    seen[:-1] += mark
                seen[-1] += int((letters > 0).sum())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["feature", "texts"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                by_order, letters = grams(block)
                for row in np.flatnonzero(letters):
                    own = np.concatenate([f[b[row] : b[row + 1]] for f, b in by_order])
                    at, n = np.unique(own, return_counts=True)
                    i = block.first + int(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("lang").slice(i, 1),
                            batch.column("draw").slice(i, 1),
                            pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                            pa.array([(n / n.sum()).astype(np.float32).tobytes()], pa.binary()),
                        ],
                        names=["lang", "draw", "features", "shares"],
                    )

    texts = rows.select("text").mapInArrow(frequencies, "feature long, texts long").groupBy("feature").agg(F.sum("texts"))
    seen = np.zeros((1 << BITS) + 1)
    for feature, n in texts.collect():  # at most one row per feature
        seen[feature] = n
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1

    limit, order = F.lit(None).cast("long"), Window.partitionBy("lang").orderBy("draw")
    for lang in languages:
        limit = F.when(F.col("lang") == lang, last[lang]).otherwise(limit)
    drawn = rows.where(F.col("draw") <= limit).mapInArrow(vectors, "lang string, draw long, features binary, shares binary")
    # Rows that are alike have one draw: cut to the size.
    drawn = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    sample = sorted(drawn.collect(), key=lambda r: (r["draw"], r["lang"]))
    index = {lang: i for i, lang in enumerate(languages)}
    examples, labels = [], []
    for r in sample:
        at = np.frombuffer(r["features"], np.int32)
        examples.append((at, np.frombuffer(r["shares"], np.float32) * idf[at] * SCALE))
        labels.append(index[r["lang"]])
    labels = np.array(labels, np.int64)
    test = np.arange(len(examples)) % 5 == 4
    w, bias = ftrl([e for e, t in zip(examples, test) if not t], labels[~test], len(languages))
    held = np.array([x @ w[at] + bias for (at, x), t in zip(examples, test) if t]).reshape(-1, len(languages))
    return Model(languages, (w * idf[:, None] * SCALE).astype(np.float32), bias, temperature(held, labels[test]))


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` of each row, after the columns of ``keep``.

    A text that is null or has no letter is ``und`` with score 0, as is every text of a model that has
    learned no language. An empty table stays empty. Only the texts go to Python.
    """

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        names = np.array([*model.languages, UNKNOWN], object)
        langs, scores = [], []
        for block in text_blocks(texts):
            best, score = model.predict(block)
            langs.append(names[best])
            scores.append(score)
        lang = pa.array(np.concatenate(langs) if langs else [], pa.string())
        score = pa.array(np.concatenate(scores) if scores else [], pa.float64())
        return pa.StructArray.from_arrays([lang, score], names=["lang", "score"])

    (found,) = fresh(df, "found")
    rows = df.select(*(keep or []), predict(col(text_col).cast("string")).alias(found))
    return rows.select(
        *[col(c) for c in rows.columns[:-1]], col(found)["lang"].alias("lang_pred"), col(found)["score"].alias("score")
    )
