"""Packing token sequences by best-fit decreasing.

Whole windows are cut from overlong documents first. What remains, shorter than a window, is dealt to groups
of bounded size; in each the pieces are placed from the longest down, each into the open window that
leaves least room. A segment tree over the remaining capacity finds that window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.support import col, settle
from tillgrid.llm.textblocks import text_blocks
from tillgrid.llm.tokens import encoder

WINDOW = 2048
END_ID = 1
GROUP_PIECES = 50_000
_GROUP_SPAN = 1 << 32


class OpenWindows:
    """Open windows by remaining capacity; ``tightest(n)`` finds the one with least room that holds n."""

    def __init__(self, capacity: int):
        self._width = 1
        while self._width < capacity + 1:
            self._width *= 2
        self._any = [0] * (2 * self._width)  # open windows below each node
        self._at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        node = self._width + room
        while node:
            self._any[node] += by
            node >>= 1

    def put(self, window: int, room: int) -> None:
        self._at[room].append(window)
        self._change(room, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out (window, room) of the smallest room of at least ``size``."""
        node = self._width + size
        while not self._any[node]:
            while node & 1:  # a right child: go up until there is a sibling to the right
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self._width:
            node *= 2
            if not self._any[node]:
                node += 1
        room = node - self._width
        window = self._at[room].pop()
        self._change(room, -1)
        return window, room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece, for pieces of 1 to ``capacity``."""
    windows, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_, made = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        found = open_.tightest(size) if size < capacity else None
        if found is None:
            window, room, made = made, capacity, made + 1
        else:
            window, room = found
        windows[i], offsets[i] = window, capacity - room
        if room > size:
            open_.put(window, room - size)
    return windows, offsets


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"


def pieces(df: DataFrame, tokenizer: str, id_col: str, text_col: str, window: int) -> DataFrame:
    """The pieces of every document with their checksums; ``deal`` is a number that spreads them evenly."""
    end = np.array([END_ID], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, made = encoder(tokenizer), 0
        task = TaskContext.get().partitionId() << 40
        for batch in batches:
            names = batch.column("id")
            for block in text_blocks(batch.column("text")):
                ids, bounds = own_encoder.ids(block)
                ids = ids.astype("<u4", copy=False)
                docs, starts, lengths, sums, totals = [], [], [], [], []
                for row in range(block.rows):
                    own = np.concatenate((ids[bounds[row] : bounds[row + 1]], end))
                    for a in range(0, len(own), window):
                        part = own[a : a + window]
                        docs.append(block.first + row)
                        starts.append(a)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part))
                        totals.append(len(own))
                deal = np.arange(task + made, task + made + len(docs))
                made += len(docs)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(docs)), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals, deal))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"],
                )

    plain = df.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(cut, _PIECES)


def pack(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for each piece.

    A null or empty text is the end id alone. Rows are documents of their own, also when ids repeat or are
    null. An empty table has no pieces; other columns are ignored. Sequences of a group number
    from ``group * 2**32``; groups hold about ``group_pieces`` pieces whatever the table's size, and loose
    room is at most about one window in each.
    """
    cut = settle(pieces(df, tokenizer, id_col, text_col, window))
    groups = max(1, -(-cut.count() // group_pieces))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "deal"], ascending=[False, True])
        windows, offsets = best_fit_decreasing(group["length"].to_numpy(), window)
        return group.assign(sequence_id=group["grp"] * _GROUP_SPAN + windows, offset=offsets).drop(columns=["deal", "grp"])

    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("deal"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(
        place,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
