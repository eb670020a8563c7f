"""Exact top-k by inner product: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are dealt by length into blocks, longest first, and rotated so that the first coordinates carry most of
all vectors' squared length (the right singular vectors, from the distributed sum of outer products). A query
first meets the block of the longest vectors, whose k-th score is its threshold. Then query blocks meet the
data blocks: a block is left out if the product of lengths cannot reach the threshold; within a block, so
is a vector whose partial inner product plus the product of the residual lengths cannot. What is left is
scored in whole numbers. Every bound is an upper bound, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrid.llm.hard_negatives import longs, sortable
from tillgrid.llm.support import col, settle

GRID = 256
BLOCK_ROWS = 2_048
QUERY_ROWS = 512
LARGEST = 1e150  # squares of anything smaller are finite
_PART = 0.25  # share of the rotated coordinates in the partial sum


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(rows: DataFrame, width: int, size: int) -> DataFrame:
    """block, ids, vectors, longest: rows of a partition, in order, ``size`` to a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32

        def block(ids, vectors):
            nonlocal made
            made += 1
            longest = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([made - 1]),
                    pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                    pa.array([vectors.tobytes()], pa.binary()),
                    pa.array([longest]),
                ],
                names=["block", "ids", "vectors", "longest"],
            )

        ids, vectors = np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            ids = np.concatenate((ids, batch.column("id").to_numpy()))
            vectors = np.concatenate((vectors, _matrix(batch.column("v"), width)))
            while len(ids) >= size:
                yield block(ids[:size], vectors[:size])
                ids, vectors = ids[size:], vectors[size:]
        if len(ids):
            yield block(ids, vectors)

    return rows.select("id", "v").mapInArrow(pack, "block long, ids binary, vectors binary, longest double")


def _best(ids, scores, own, k):
    """For each query at most k (query row, id, score), by score and then id."""
    kept = min(k + 1, scores.shape[1])  # one more, for the query itself
    scores = np.where(ids[None, :] == own[:, None], -np.inf, scores)
    floor = -np.partition(-scores, kept - 1, axis=1)[:, kept - 1]
    row, at = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
    order = np.lexsort((ids[at], -scores[row, at], row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    first = place < k
    return row[first], at[first]


def _whole(x: np.ndarray, kind: type) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if kind is object else x.astype(kind)


def _search(pairs: DataFrame, width: int, rotation: np.ndarray, k: int, bound: int) -> DataFrame:
    part = max(1, int(width * _PART))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                own = np.frombuffer(r["q_ids"], np.int64)
                x = np.frombuffer(r["vectors"], np.float64).reshape(-1, width)
                q = np.frombuffer(r["q_vectors"], np.float64).reshape(-1, width)
                least = np.frombuffer(r["least"], np.float64) if r["least"] else np.full(len(q), -np.inf)
                rx, rq = x @ rotation, q @ rotation
                reach = rq[:, :part] @ rx[:, :part].T
                reach += np.sqrt((rq[:, part:] ** 2).sum(axis=1))[:, None] * np.sqrt((rx[:, part:] ** 2).sum(axis=1))
                slack = 1e-9 * np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((x**2).sum(axis=1)) + 1e-6
                able = reach + slack >= least[:, None]
                live, used = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
                if not len(live):
                    continue
                able = able[np.ix_(live, used)]
                top = float(np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * width)
                if top < 2**52:  # products and sums are whole numbers that doubles hold exactly
                    scores = q[live] @ x[used].T
                    values = scores.astype(np.int64)
                else:
                    # Whole numbers of any size; ranks keep their order exactly.
                    kind = np.int64 if top < 2**62 else object
                    values = _whole(q[live], kind) @ _whole(x[used], kind).T
                    _, scores = np.unique(values, return_inverse=True)
                    scores = scores.reshape(values.shape).astype(np.float64)
                row, at = _best(ids[used], np.where(able, scores, -np.inf), own[live], k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), r["q_block"])),
                        pa.array(live[row]),
                        pa.array(own[live[row]]),
                        pa.array(ids[used[at]]),
                        pa.array(longs(values[row, at]), pa.int64()),
                        pa.array(values[row, at].astype(np.float64)),
                        pa.array(sortable(values[row, at].astype(object), bound) if bound >= 1 << 62 else [None] * len(row), pa.string()),
                    ],
                    names=["q_block", "q_row", "query_id", "vec_id", "score", "near", "wide"],
                )

    return pairs.mapInArrow(search, "q_block long, q_row long, query_id long, vec_id long, score long, near double, wide string")


def top_inner_products(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the k rows of highest score, ties to the smaller id.

    Components become ``floor(256 * x)``; the score is their whole inner product. Rows that share the
    query's id are not its candidates. Vectors that are null or hold null or non-finite components, and rows
    without an id take no part; nor do components beyond 1e150, which only doubles can be, as their squares
    are not finite. Scores beyond a long are compared exactly and given as the nearest long. Shorter
    vectors count as filled up with zeros. A query that stands in several rows has as many answers; with
    fewer candidates than k all are given. Tables that are empty or without queries give no rows.
    """
    wide = F.transform(col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    rows = df.where(col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        col(id_col).cast("long").alias("id"),
        # Beyond 2**43 a double's 256-fold is whole.
        F.transform(wide, lambda x: F.when(F.abs(x) < float(1 << 43), F.floor(x * GRID).cast("double")).otherwise(x * GRID)).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = rows.withColumn("length2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    largest = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    width, most, count = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.max(largest), F.count(F.lit(1))).first()
    width = max(1, width)
    bound = width * int(most or 0) ** 2 + 1

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width**2)), pa.array(total.ravel())], names=["at", "s"])

    gram = np.zeros(width * width)
    for at, s in rows.select("v").mapInArrow(moments, "at long, s double").groupBy("at").agg(F.sum("s")).collect():
        gram[at] = s  # width * width numbers
    rotation = np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1]

    parts = max(1, -(-count // (4 * block_rows)))
    ordered = rows.repartitionByRange(parts, F.desc("length2"), "id").sortWithinPartitions(F.desc("length2"), "id")
    data = settle(_blocks(ordered, width, block_rows))
    asking = rows.where("asks")
    queries = settle(_blocks(asking.repartition(max(1, parts // 8), "id"), width, query_rows))
    queries = queries.select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("longest").alias("q_longest")
    )
    # Thresholds from the block of the longest vectors.
    longest = data.orderBy(F.desc("longest"), "block").limit(1).select("ids", "vectors")
    none = F.lit(None).cast("binary")
    seeds = _search(queries.withColumn("least", none).join(F.broadcast(longest)), width, rotation, k, bound)  # one block of bounded size
    place = Window.partitionBy("q_block", "q_row").orderBy(F.desc("wide"), F.desc("score"), "vec_id")
    kth = seeds.withColumn("n", F.row_number().over(place)).where(F.col("n") == k)
    kth = kth.groupBy("q_block").agg(F.collect_list(F.struct("q_row", "near")).alias("kth"))  # at most query_rows

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for ids, found in zip(batch.column("q_ids"), batch.column("kth")):
                values = np.full(len(ids.as_py()) // 8, -np.inf)
                for one in found.as_py() or ():
                    values[one["q_row"]] = one["near"]
                least.append(values.tobytes())
            low = [float(np.frombuffer(x, np.float64).min()) for x in least]
            kept = [batch.column(c) for c in ("q_block", "q_ids", "q_vectors", "q_longest")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(least, pa.binary()), pa.array(low, pa.float64())],
                names=["q_block", "q_ids", "q_vectors", "q_longest", "least", "lowest"],
            )

    ready = settle(
        queries.join(kth, "q_block", "left").mapInArrow(
            thresholds, "q_block long, q_ids binary, q_vectors binary, q_longest double, least binary, lowest double"
        )
    )
    # Blocks meet blocks whose lengths can reach the lowest threshold: each data block is dealt to query blocks.
    names = ready.select("q_block", "q_longest", "lowest")
    met = F.col("longest") * F.col("q_longest") * (1 + 1e-9) + 1e-6 >= F.col("lowest")
    meets = data.select("block", "longest").join(names, met).select("block", "q_block")
    tasks = meets.join(data.select("block", "ids", "vectors"), "block").join(ready, "q_block")
    found = _search(tasks, width, rotation, k, bound)
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
