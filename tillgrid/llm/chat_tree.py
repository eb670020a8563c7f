"""Chat formatting over a prefix tree: turns that conversations share from the start are emitted once.

A turn is known by its place and a fingerprint of all turns up to it, so equal starts meet in one node. The
conversations are sorted by their paths, and a node belongs to the first conversation through it; read by
conversation and place, the nodes are in depth-first order, and the new nodes of one conversation follow one
another. Each node carries its tokens, the offset in its tree, the position of its first token in the
conversation, and the intervals of the tree that its tokens may attend to: those of its ancestors. Within a
node attention is causal.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``; the two marks are ids of their own beyond the tokenizer's.
In roles and texts one backslash is put into every ``<|``, after the ones already there, and roles also
escape line ends; both are undone on reading. Tokens of assistant texts, and no others, are under the loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrid.llm.support import col, ranked, running, settle
from tillgrid.llm.textblocks import text_blocks
from tillgrid.llm.tokens import encoder

START, END = "<|im_start|>", "<|im_end|>"
TURN_CELL = 256
_KEYS = ["depth", "p1", "p2"]


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """Line ends and the sign that marks them are spelled out."""
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def _encoded(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """Adds tokens, length, loss_from and loss_to (within the node) to rows of keys, head, body, assistant."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        start, end = own.size, own.size + 1
        (line,) = own._encode(["\n"])

        def ids(column):
            for block in text_blocks(column):
                found, bounds = own.ids(block)
                for i in range(block.rows):
                    yield found[bounds[i] : bounds[i + 1]]

        for batch in batches:
            tokens, lengths, lows, highs = [], [], [], []
            for head, body, loss in zip(ids(batch.column("head")), ids(batch.column("body")), batch.column("assistant").to_pylist()):
                low = 1 + len(head)
                high = low + len(body)
                tokens.append(np.concatenate(([start], head, body, [end], line)).astype(np.int32))
                lengths.append(len(tokens[-1]))
                lows.append(low if loss else high)
                highs.append(high)
            values = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in _KEYS),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(values, pa.int32())),
                    *(pa.array(x, pa.int64()) for x in (lengths, lows, highs)),
                ],
                names=[*_KEYS, "tokens", "length", "loss_from", "loss_to"],
            )

    return nodes.select(*_KEYS, "head", "body", "assistant").mapInArrow(
        encode, "depth long, p1 long, p2 long, tokens array<int>, length long, loss_from long, loss_to long"
    )


def format_conversations(
    df: DataFrame,
    tokenizer: str,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths) of all conversations.

    ``nodes``: ``tree, offset, length, tokens, position, attends`` (list of ``begin, end``), ``loss_from,
    loss_to`` (in the tree; equal where there is no loss). ``paths``: ``conv_id, turn_index, tree, offset`` for
    every turn. Rows are ordered by turn, nulls first, then role and text; a null role or text is empty, rows
    without a conversation id form one conversation. Equal conversations share a path; a repeated row is a
    turn of its own. Empty tables give empty tables; other columns are ignored.
    """
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), col(conv_col).cast("string")), F.lit("~")).alias("conv"),
        col(conv_col).cast("long").alias("conv_id"),
        F.coalesce(F.floor(col(turn_col) / TURN_CELL).cast("long"), F.lit(-(1 << 62))).alias("cell"),
        col(turn_col).alias("turn"),
        F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    turns = ranked(rows, "conv", "cell", order, "depth")
    marked = turns.select(
        "conv",
        "conv_id",
        "depth",
        "role",
        "text",
        *(F.xxhash64(F.lit(seed), "depth", "role", "text").alias(f"h{seed}") for seed in (1, 2)),
    )
    path = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    turns = settle(
        marked.select(
            "conv", "conv_id", "depth", "role", "text",
            F.bit_xor("h1").over(path).alias("p1"), F.bit_xor("h2").over(path).alias("p2"),
        )
    )
    # Conversations by path; numbers rise in that order.
    paths = turns.groupBy("conv").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("depth", "p1"))), lambda x: x["p1"]).alias("path")
    )
    places = settle(paths.orderBy("path", "conv").select("conv", F.monotonically_increasing_id().alias("place")))
    placed = settle(
        turns.join(places, "conv").select("conv", "conv_id", "place", *_KEYS).join(
            turns.where("depth = 0").select("conv", F.col("p1").alias("tree")), "conv"
        )
    )
    first = placed.groupBy(*_KEYS).agg(F.min("place").alias("owner"))
    owned = settle(placed.join(settle(first), _KEYS).withColumn("own", F.col("place") == F.col("owner")))
    # The text of every node from its owner.
    fresh_turns = turns.join(owned.where("own").select("conv", "depth"), ["conv", "depth"], "left_semi")
    encoded = settle(
        _encoded(
            fresh_turns.select(
                *_KEYS,
                F.concat(escaped_role(F.col("role")), F.lit("\n")).alias("head"),
                escaped(F.col("text")).alias("body"),
                (F.col("role") == "assistant").alias("assistant"),
            ),
            tokenizer,
        )
    )
    lengths = encoded.select(*_KEYS, "length")
    emitted = owned.where("own").join(lengths, _KEYS).withColumn("cell", F.shiftright("place", 33))
    offsets = settle(
        running(emitted, "tree", "cell", [F.col("place"), F.col("depth")], F.col("length"), "offset").select(
            *_KEYS, "offset", "length"
        )
    )
    along = Window.partitionBy("conv").orderBy("depth")
    located = settle(
        owned.join(offsets, _KEYS)
        .withColumn("position", F.coalesce(F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("breaks", (F.col("offset") != F.lag(F.col("offset") + F.col("length"), 1, -1).over(along)).cast("long"))
    )
    # What a conversation shares with earlier ones, as few intervals; its own nodes follow one another.
    shared = (
        located.where("not own")
        .withColumn("piece", F.sum("breaks").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("conv", "piece")
        .agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"))
        .groupBy("conv")
        .agg(F.array_sort(F.collect_list(F.struct("piece", "begin", "end"))).alias("pieces"))
        .select("conv", F.transform("pieces", lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"))).alias("before"))
    )
    own = located.where("own")
    own = own.withColumn("from", F.min("offset").over(Window.partitionBy("conv")))
    none = F.array().cast("array<struct<begin:long,end:long>>")
    since = F.when(
        F.col("from") < F.col("offset"), F.array(F.struct(F.col("from").alias("begin"), F.col("offset").alias("end")))
    ).otherwise(none)
    nodes = (
        own.join(shared, "conv", "left")
        .select(*_KEYS, "tree", "offset", "position", F.concat(F.coalesce("before", none), since).alias("attends"))
        .join(encoded, _KEYS)
        .select(
            "tree", "offset", "length", "tokens", "position", "attends",
            (F.col("offset") + F.col("loss_from")).alias("loss_from"), (F.col("offset") + F.col("loss_to")).alias("loss_to"),
        )
    )
    return settle(nodes), located.select("conv_id", F.col("depth").alias("turn_index"), "tree", "offset")


def read_nodes(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """``tree, offset, role, text, loss, formatted`` of every node, from its tokens alone."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            heads, losses = [], []
            begin = batch.column("offset").to_pylist()
            low, high = batch.column("loss_from").to_pylist(), batch.column("loss_to").to_pylist()
            for i, ids in enumerate(batch.column("tokens")):
                ids = ids.values.to_numpy()
                if ids[0] != own.size:
                    raise ValueError("a node does not begin with its mark")
                stop = int(np.flatnonzero(ids == own.size + 1)[-1])
                heads.append(ids[1:stop].tolist())
                losses.append(ids[low[i] - begin[i] : high[i] - begin[i]].tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("tree"),
                    batch.column("offset"),
                    pa.array(own.decode(heads), pa.string()),
                    pa.array(own.decode(losses), pa.string()),
                ],
                names=["tree", "offset", "said", "under"],
            )

    read = nodes.select("tree", "offset", "tokens", "loss_from", "loss_to").mapInArrow(
        decode, "tree long, offset long, said string, under string"
    )
    at = F.locate("\n", F.col("said"))
    return read.select(
        "tree",
        "offset",
        unescaped_role(F.col("said").substr(F.lit(1), at - 1)).alias("role"),
        unescaped(F.col("said").substr(at + 1, F.length("said"))).alias("text"),
        unescaped(F.col("under")).alias("loss"),
        F.concat(F.lit(START), "said", F.lit(END + "\n")).alias("formatted"),
    )


def read_back(nodes: DataFrame, paths: DataFrame, tokenizer: str) -> DataFrame:
    """``conv_id, n_turns, turns, loss, formatted_chars`` of every conversation, from nodes and paths.

    ``turns`` joins role, line end, text, line end of each turn; ``loss`` all text under the loss.
    """
    turns = paths.join(settle(read_nodes(nodes, tokenizer)), ["tree", "offset"])
    said = F.array_sort(
        F.collect_list(F.struct("turn_index", F.concat_ws("\n", "role", "text", F.lit("")).alias("turn"), "loss"))
    )
    whole = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), said.alias("said"), F.sum(F.length("formatted")).alias("formatted_chars")
    )
    return whole.select(
        "conv_id",
        "n_turns",
        F.concat_ws("", F.transform("said", lambda x: x["turn"])).alias("turns"),
        F.concat_ws("", F.transform("said", lambda x: x["loss"])).alias("loss"),
        "formatted_chars",
    )
