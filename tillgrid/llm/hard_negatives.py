"""Hard negatives by exact inner products in a residue number system.

Components are whole numbers. Modulo each of several primes below 1,024 they are residues about zero, and a
product of residue matrices is exact in single precision as long as the sums stay below 2**24; wider vectors are
cut into strips. The primes are as many as the largest possible score asks for, so the remainders of a score
give it back by Chinese remaindering, sign and all, however large it is. Data rows are packed into blocks, each
shuffled once; the anchors pass by every block in slabs. The first pass finds every anchor's positives, the
second selects from the window that each positive's score sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrid.llm.support import col, settle

GRID = 256
BLOCK_ROWS = 8_192  # at most, of a data block
BLOCK_BYTES = 4 << 20  # of its components as doubles
SLAB_ROWS = 256  # anchors that pass by together
STRIP = 60  # columns of one product: 60 * 511**2 < 2**24
EXACT = 1 << 56  # scores below it stay longs when they are multiplied by 100
LONGEST = (1 << 63) - 1


@cache
def primes(bound: int) -> tuple[int, ...]:
    """Primes below 1,024, from the largest on, with a product above twice the bound."""
    out: list[int] = []
    p = 1023
    while prod(out) <= 2 * bound + 1:
        if all(p % d for d in range(2, isqrt(p) + 1)):
            out.append(p)
        p -= 1
    return tuple(out)


def residues(v: np.ndarray, p: int) -> np.ndarray:
    """Whole doubles of any size modulo p, about zero, in single precision."""
    r = np.fmod(v, p)
    return (r - np.rint(r / p) * p).astype(np.float32)


def product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Rows of ``a`` times rows of ``b`` modulo p, from 0 on."""
    total = np.zeros((len(a), len(b)), np.float32)
    for i in range(0, a.shape[1], STRIP):
        part = a[:, i : i + STRIP] @ b[:, i : i + STRIP].T
        total += part - np.rint(part / np.float32(p)) * np.float32(p)
        total -= np.rint(total / np.float32(p)) * np.float32(p)
    whole = total.astype(np.int64)
    whole[whole < 0] += p
    return whole


def exact_scores(a: list[np.ndarray], b: list[np.ndarray], moduli: tuple[int, ...]) -> np.ndarray:
    """Signed inner products by Chinese remaindering in mixed radix; Python integers beyond 62 bits."""
    whole = prod(moduli)
    narrow = whole < EXACT
    total, radix, digits = None, 1, []
    for i, p in enumerate(moduli):
        digit = product_modulo(a[i], b[i], p)
        for q, d in zip(moduli, digits):  # the digit that the earlier ones leave
            digit = (digit - d) * pow(q, -1, p) % p
        digits.append(digit)
        term = (digit if narrow else digit.astype(object)) * radix
        total = term if total is None else total + term
        radix *= p
    return np.where(total > whole // 2, total - whole, total)


def first_of(scores: np.ndarray, able: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of at most k able scores of each row, by score and then by smaller id."""
    row, at = np.nonzero(able)
    if len(row) > 4 * k * len(able):  # most cannot be among the first: keep those at or above the k-th
        ranks = scores
        if scores.dtype == object:
            ranks = np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
        least = np.iinfo(np.int64).min
        held = np.where(able, ranks, least)
        floor = -np.partition(-held, k - 1, axis=1)[:, k - 1] if held.shape[1] >= k else np.full(len(held), least)
        row, at = np.nonzero(able & (ranks >= floor[:, None]))
    values = scores[row, at]
    if values.dtype == object:
        values = np.unique(values, return_inverse=True)[1]
    order = np.lexsort((ids[at], -values, row))
    row, at = row[order], at[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], at[first]


def sortable(scores: np.ndarray, bound: int) -> list[str] | None:
    """Exact scores as texts of one length in the same order; none where a long holds them all."""
    if scores.dtype != object:
        return None
    digits = len(f"{2 * bound:x}")
    return [f"{int(s) + bound:0{digits}x}" for s in scores]


def restored(text: str | None, score: int, bound: int) -> int:
    return score if text is None else int(text, 16) - bound


def longs(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; one beyond them becomes the nearest."""
    return np.array([max(-LONGEST - 1, min(LONGEST, int(s))) for s in scores], np.int64) if scores.dtype == object else scores


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(rows: DataFrame, width: int, size: int) -> DataFrame:
    """key, ids, labels, vectors: rows of a task in lots of ``size``, components as whole doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32

        def lot(ids, labels, vectors):
            nonlocal made
            made += 1
            cells = [pa.array([made - 1])]
            cells += [pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, vectors)]
            return pa.RecordBatch.from_arrays(cells, names=["key", "ids", "labels", "vectors"])

        held: list[tuple] = []
        n = 0
        for batch in batches:
            for i in range(0, batch.num_rows, size):  # no more of a batch is unfolded than a lot holds
                part = batch.slice(i, size)
                vectors = np.floor(_matrix(part.column("v"), width) * GRID)
                held.append((part.column("id").to_numpy(), part.column("label").to_numpy(), vectors))
                n += part.num_rows
                if n >= size:
                    whole = [np.concatenate(x) for x in zip(*held)]
                    yield lot(*(x[:size] for x in whole))
                    held, n = [tuple(x[size:] for x in whole)], n - size
        if n:
            yield lot(*(np.concatenate(x) for x in zip(*held)))

    return rows.select("id", "label", "v").mapInArrow(pack, "key long, ids binary, labels binary, vectors binary")


class Lot:
    """A block or slab in a task: its ids, labels, and residues modulo each prime."""

    def __init__(self, row: dict, width: int, moduli: tuple[int, ...]):
        self.key = row["key"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, width)
        self.residues = [residues(vectors, p) for p in moduli]
        self.tops = row["tops"] or []


Select = Callable[[Lot, Lot, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, int]]]
_TOPS = "array<struct<row:int,turn:int,vec_id:long,score:long,wide:string>>"
_FOUND = "slab long, row int, turn int, anchor_id long, vec_id long, score long, wide string"


def _meet(blocks: DataFrame, slabs: DataFrame, width: int, bound: int, select: Select) -> DataFrame:
    """What ``select`` picks from every data block and every slab of anchors.

    A block is shuffled once and stays in its task while the slabs pass by, so the shuffle is the data and
    one copy of the anchors, the stated query set, for each block. ``select`` takes slab, block and the
    scores, and yields the rows and columns it picks, each time with a turn.
    """
    moduli = primes(bound)
    spark = blocks.sparkSession
    # Blocks are numbered without gaps: the driver sees one number for each task that packed some.
    tasks = blocks.groupBy(F.shiftright("key", 32).alias("task")).count().orderBy("task").collect()
    ahead, offsets = 0, []
    for task, n in tasks:
        offsets.append((task, ahead))
        ahead += n
    first = F.broadcast(spark.createDataFrame(offsets, "task long, ahead long"))  # one row per task
    numbered = blocks.join(first, F.shiftright("key", 32) == F.col("task"))
    number = F.col("ahead") + F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    cells = ["key", "ids", "labels", "vectors", "tops"]
    data = numbered.select(number.alias("place"), F.lit(0).alias("turn"), *cells[:4], F.lit(None).cast(_TOPS).alias("tops"))
    passing = slabs.select(F.explode(F.sequence(F.lit(0), F.lit(ahead - 1)).cast("array<bigint>")).alias("place"), F.lit(1).alias("turn"), *cells)
    met = data.union(passing).repartition(max(1, ahead), "place").sortWithinPartitions("place", "turn", "key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for i in range(batch.num_rows):
                (one,) = batch.slice(i, 1).to_pylist()
                lot = Lot(one, width, moduli)
                if one["turn"] == 0:
                    block = lot
                    continue
                scores = exact_scores(lot.residues, block.residues, moduli)
                for row, at, turn in select(lot, block, scores):
                    found = scores[row, at]
                    n = len(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, lot.key)),
                            pa.array(row.astype(np.int32)),
                            pa.array(np.full(n, turn, np.int32)),
                            pa.array(lot.ids[row]),
                            pa.array(block.ids[at]),
                            pa.array(longs(found), pa.int64()),
                            pa.array(sortable(found, bound) or [None] * n, pa.string()),
                        ],
                        names=["slab", "row", "turn", "anchor_id", "vec_id", "score", "wide"],
                    )

    return met.mapInArrow(search, _FOUND)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    block_rows: int = BLOCK_ROWS,
    slab_rows: int = SLAB_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(256 * x)``; the score is their whole inner product, exact whatever its
    size. An anchor's positives are the rows of its label with the highest scores; of each positive's window,
    scores from ``window[0]`` to ``window[1]`` hundredths of the positive's, the rows of other labels with the
    highest scores are the negatives, ranked from 1. Ties go to the smaller id. Rows that share the anchor's id
    are not its candidates. Rows without id, label or vector, or with a component that is null or whose
    256-fold is not finite, take no part. Shorter vectors count as filled up with zeros. Anchors and rows that
    stand several times are taken as often. Scores beyond a long are compared exactly and given as the nearest
    long. Very long vectors make blocks of fewer rows. Other columns are ignored; an empty table, or one
    without anchors, positives or negatives, gives no rows.
    """
    wide = F.transform(col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & (F.abs(x * GRID) < float("inf")))
    known = col(id_col).isNotNull() & col(label_col).isNotNull() & F.coalesce(fine, F.lit(False))
    rows = df.where(known).select(
        col(id_col).cast("long").alias("id"),
        col(label_col).cast("long").alias("label"),
        wide.alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    largest = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    width, most = rows.agg(F.max(F.size("v")), F.max(largest)).first()
    width = max(1, width or 0)
    bound = width * (int((most or 0.0) * GRID) + 1) ** 2
    # Lots of whole vectors, bounded in rows and in bytes.
    blocks = settle(_packed(rows, width, max(1, min(block_rows, BLOCK_BYTES // (8 * width)))))
    asking = rows.where("asks").repartition(F.xxhash64("id"))
    slabs = settle(_packed(asking, width, max(1, min(slab_rows, BLOCK_BYTES // (8 * width)))))
    slabs = slabs.withColumn("tops", F.lit(None).cast(_TOPS))
    order = [F.desc("wide"), F.desc("score"), F.asc("vec_id")]

    def same_label(slab: Lot, block: Lot, scores: np.ndarray):
        able = (slab.labels[:, None] == block.labels) & (slab.ids[:, None] != block.ids)
        yield *first_of(scores, able, block.ids, positives), 0

    place = Window.partitionBy("slab", "row").orderBy(*order)
    ranked = _meet(blocks, slabs, width, bound, same_label).withColumn("place", F.row_number().over(place))
    tops = ranked.where(F.col("place") <= positives).groupBy("slab").agg(
        # At most ``positives`` for each of the slab's rows.
        F.collect_list(F.struct("row", F.col("place").alias("turn"), "vec_id", "score", "wide")).alias("found")
    )
    ready = settle(slabs.drop("tops").join(tops, F.col("key") == F.col("slab")).select("key", "ids", "labels", "vectors", F.col("found").alias("tops")))
    low, high = window

    def windowed(slab: Lot, block: Lot, scores: np.ndarray):
        hundredfold = scores * 100
        other = slab.labels[:, None] != block.labels
        for turn in range(1, positives + 1):
            goal = np.zeros(len(slab.ids), scores.dtype)
            has = np.zeros(len(slab.ids), bool)
            for t in slab.tops:
                if t["turn"] == turn:
                    goal[t["row"]] = restored(t["wide"], t["score"], bound)
                    has[t["row"]] = True
            able = other & has[:, None] & (hundredfold >= low * goal[:, None]) & (hundredfold <= high * goal[:, None])
            yield *first_of(scores, able, block.ids, negatives), turn

    place = Window.partitionBy("slab", "row", "turn").orderBy(*order)
    chosen = _meet(blocks, ready, width, bound, windowed).withColumn("rank", F.row_number().over(place))
    chosen = chosen.where(F.col("rank") <= negatives)
    goals = ready.select(F.col("key").alias("slab"), F.inline("tops")).select(
        "slab", "row", "turn", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return chosen.join(goals, ["slab", "row", "turn"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
