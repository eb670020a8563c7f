"""Substring dedup by compaction of a De Bruijn graph of word windows.

Nodes are runs of k-1 words; every window of ``k`` words is an edge from its first k-1 words to its last. Only edges
of several documents matter. They are found without shuffling edges one by one: consecutive windows of a document whose
smallest inner fingerprint (over ``k - GRAM + 1`` overlapping grams) is the same form one piece under that fingerprint.
Equal windows have equal fingerprints, so they meet in the same key, and keys of one document only are dropped. A key
with one distinct piece has no branch inside it: the piece is one path already. Pieces of other keys are opened at
their source into single edges.

Joins then compact these paths. Each node counts the edges that enter and leave it; where one enters, one leaves, and
the second follows the first at the coordinates of their first document, the two are linked, and linked paths become one
path piece ("unit") with an id and its source coordinates. An occurrence in a later document is a span of a unit. Spans
are verified: the digest of their words and that of the words at the source must be equal, and documents
of spans that fail are done again by the words themselves. So no word goes whose window does not repeat, and words
that share a fingerprint change no answer. A repeat could only be missed where two pieces of different word
fingerprints share key, length and the 64-bit fingerprint of their path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrid.llm.support import col, discard, settle
from tillgrid.llm.textblocks import Block, mix, rows_of, run_hashes, text_blocks

WINDOW = 13
GRAM = 5
CELL = 4096  # words of a source document; paths are cut between cells, so no task orders a whole document
HASHED = "32m"  # joins hash their smaller side if no partition of it is larger as shuffled; others sort, and may spill
_GRAM_BASE = np.uint64(0x2545F4914F6CDD1D)
_PATH_BASE = np.uint64(0xDA942042E4DD58B5)
_PATH_INVERSE = np.uint64(pow(int(_PATH_BASE), -1, 1 << 64))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _rolling(h: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i in range(width):
        out = out * _GRAM_BASE + h[i : len(h) - width + 1 + i]
    return mix(out)


def _words(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, and where each text's words begin."""
    starts, ends, bounds = block.words()
    return run_hashes(block.data, starts, ends) >> np.uint64(64 - bits), bounds


def _pieces(block: Block, k: int, gram: int, bits: int):
    """(row, key, start, windows, path hash) of the block's path pieces, in order."""
    h, bounds = _words(block, bits)
    if len(h) < k:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    low = _sliding_min(_rolling(h, gram), k - gram + 1)
    row = rows_of(bounds)
    inside = np.flatnonzero(row[: len(low)] == row[k - 1 :])
    low, row = low[inside], row[inside]
    first = np.ones(len(low), bool)
    first[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    windows = np.diff(np.append(at, len(low)))
    begin = inside[at]
    power = np.full(len(h) + 1, _PATH_BASE, np.uint64)
    power[0] = 1
    back = np.full(len(h) + 1, _PATH_INVERSE, np.uint64)
    back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h) * power[:-1])))
    path = mix((sums[begin + windows + k - 1] - sums[begin]) * back[begin])
    return row[at], low[at].view(np.int64), begin - bounds[row[at]], windows, path.view(np.int64)


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns)
    )


def _spans(row: np.ndarray, x: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Spans in order of row and ``begin``, once each, joined where they go on in the same unit."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (x["begin"][1:] != x["begin"][:-1])  # rows that stand twice
    row, x = row[new], {c: v[new] for c, v in x.items()}
    same = (row[1:] == row[:-1]) & (x["unit"][1:] == x["unit"][:-1])
    for c in ("begin", "off"):
        same &= x[c][1:] == x[c][:-1] + x["n"][:-1]
    at = np.flatnonzero(np.append(True, ~same)[: len(row)])
    size = np.add.reduceat(x["n"], at) if len(at) else x["n"]
    return row[at], {c: v[at] for c, v in x.items()} | {"n": size}


def _lists(row: np.ndarray, rows: int, x: dict) -> pa.ListArray:
    """The values as one list of structs for each of ``rows`` rows."""
    ends = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
    values = [v if isinstance(v, pa.Array) else pa.array(v) for v in x.values()]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(values, names=list(x)))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``spans`` of each row in order, once each, joined where they go on in the same unit; other columns as they are."""
    for batch in batches:
        lists = batch.column("spans")
        names = [f.name for f in lists.type.value_type]
        row = rows_of(lists.offsets.to_numpy())
        x = dict(zip(names, (c.to_numpy() for c in lists.flatten().flatten())))
        order = np.lexsort((x["begin"], row))
        spans = _spans(row[order], {c: v[order] for c, v in x.items()})
        others = {c: batch.column(c) for c in batch.schema.names if c != "spans"}
        yield _table(others | {"spans": _lists(spans[0], batch.num_rows, spans[1])})


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of pieces, each piece's together, as a row of spans for each piece, or more where a batch ends within it."""
    for batch in batches:
        x = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        piece = [x.pop(c) for c in ("doc", "part", "start")]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in piece])
        row = np.cumsum(new) - 1
        order = np.lexsort((x["begin"], row))
        edges = {"begin": x["begin"], "n": np.ones(len(row), np.int64)} | x
        spans = _spans(row[order], {c: v[order] for c, v in edges.items()})
        doc, part, start = (c[new] for c in piece)
        yield _table({"doc": doc, "part": part, "start": start, "way": _lists(spans[0], len(doc), spans[1])})


_SPANS = "array<struct<begin:long,n:long,unit:long,off:long>>"
_DIGEST = ["sha0", "sha1", "sha2", "sha3"]
_TO_SPACE = bytes(0x20 if 0x09 <= x <= 0x0D else x for x in range(256))


def _spaced(text: bytes) -> bytes:
    """The words of a text, joined by one space."""
    text = text.translate(_TO_SPACE).strip(b" ")
    return b" ".join(text.split()) if b"  " in text else text


def _cut(k: int, with_text: bool):
    """Words without the spans of each row, and the digests of its spans and of those asked for at their source."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("spans", "asked")]
            rows = [rows_of(x.offsets.to_numpy()) for x in lists]
            own = np.repeat([True, False], [len(x) for x in rows])
            order = np.argsort(np.concatenate(rows), kind="stable")
            row, own = np.concatenate(rows)[order], own[order]
            values = [[c.to_numpy() for c in x.flatten().flatten()] for x in lists]
            begin, n, unit, off = (np.concatenate(x)[order] for x in zip(*values))
            end = begin + n + (k - 1)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            shas = []
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                kept = _spaced(text.as_py() or b"")
                total, removed = kept.count(b" ") + 1 if kept else 0, 0
                lo, hi = edges[i], edges[i + 1]
                if lo < hi:
                    gaps = np.flatnonzero(np.frombuffer(kept, np.uint8) == 0x20)
                    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(kept))
                    for at, to in zip(starts[begin[lo:hi]].tolist(), ends[end[lo:hi] - 1].tolist()):
                        shas.append(hashlib.sha256(kept[at:to]).digest())
                    turns = np.zeros(total + 1, np.int64)
                    np.add.at(turns, begin[lo:hi], own[lo:hi])
                    np.add.at(turns, end[lo:hi], -1 * own[lo:hi])
                    stays = np.cumsum(turns[:-1]) == 0
                    removed = total - int(np.count_nonzero(stays))
                    if removed:
                        turns = np.flatnonzero(np.diff(stays, prepend=False, append=False))
                        runs = zip(starts[turns[::2]].tolist(), ends[turns[1::2] - 1].tolist())
                        kept = b" ".join([kept[at:to] for at, to in runs])
                out["n_words"].append(total)
                out["n_removed"].append(removed)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if with_text else None)
            digests = np.frombuffer(b"".join(shas), np.int64).reshape(-1, len(_DIGEST))
            proofs = {"unit": unit, "off": off, "n": n, "own": own} | {c: digests[:, i] for i, c in enumerate(_DIGEST)}
            yield _table(
                {
                    "doc_id": batch.column("doc"),
                    "part": batch.column("part"),
                    "n_words": pa.array(out["n_words"], pa.int64()),
                    "n_removed": pa.array(out["n_removed"], pa.int64()),
                    "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
                    "kept": pa.array(out["kept"], pa.binary()).cast(pa.string()),
                    "proofs": _lists(row, batch.num_rows, proofs),
                }
            )

    return cut


_CUT = (
    "doc_id long, part long, n_words long, n_removed long, kept_sha256 string, kept string, "
    f"proofs array<struct<unit:long,off:long,n:long,own:boolean,{','.join(f'{c}:long' for c in _DIGEST)}>>"
)


def _units(segments: DataFrame, *carried: str) -> DataFrame:
    """(doc, part, pos, unit, off) for paths of (doc, part, pos, n, head, tail): linked paths share a unit.

    A node with one path in and one out links them if the second begins where the first ends in one source document.
    Places meet as 64-bit fingerprints: unit and offset name a place at the source whichever paths are linked, so a
    false link changes no span's words. ``carried`` columns come along.
    """
    spot = ["doc", "part", "pos"]
    ends = segments.select(F.col("tail").alias("node"), F.xxhash64("doc", "part", F.col("pos") + F.col("n")).alias("place"), F.lit(1).alias("paths"))
    starts = segments.select(F.col("head").alias("node"), F.xxhash64(*spot).alias("place"), F.lit(1 << 32).alias("paths"))
    linked = (
        ends.unionByName(starts)
        .groupBy("node")
        .agg(F.sum("paths").alias("paths"), F.min("place").alias("place"), F.max("place").alias("high"))
        .where(F.col("paths") == F.lit((1 << 32) + 1))  # one ends, one starts
        .where("place = high")
        .select("place", F.lit(True).alias("linked"))
    )
    inside = Window.partitionBy("doc", "part", F.floor(F.col("pos") / CELL)).orderBy("pos")
    begins = F.last(F.when(F.col("linked").isNull(), F.col("pos")), ignorenulls=True).over(inside)
    begin = F.coalesce(begins, F.first("pos").over(inside))
    placed = segments.select(*spot, *carried, F.xxhash64(*spot).alias("place"))
    joined = placed.join(linked, "place", "left").withColumn("begin", begin)
    unit = F.xxhash64("doc", "part", "begin").alias("unit")
    return joined.select(*spot, unit, (F.col("pos") - F.col("begin")).alias("off"), *carried)


def _first(position: str) -> list[Column]:
    """The smallest document of a group and one place in it; numbers only, so that groups are hashed and not sorted."""
    return [F.min("doc").alias("doc"), *[F.min_by(c, "doc").alias(c) for c in ("part", position)]]


@contextmanager
def _hashed_joins(spark: SparkSession) -> Iterator[None]:
    """Joins of partitions up to ``HASHED`` are hashed and not sorted, unless the session has a limit of its own."""
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(key, "0b").rstrip("bB") != "0":
        yield
        return
    spark.conf.set(key, HASHED)
    try:
        yield
    finally:
        spark.conf.unset(key)


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = WINDOW,
    gram: int = GRAM,
    with_text: bool = False,
    bits: int = 64,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per row; with ``with_text`` also ``kept``, the text that is left.

    A word goes if it lies in a window of ``k`` words that also starts in a row with a smaller id. Windows
    are those of the input. A null or empty text has no words; texts under ``k`` words lose none. Rows without
    an id lose nothing and cause no loss. Rows that share an id do not clear each other, and each is judged
    by its own words. An empty table gives no rows; other columns are ignored. Texts are whole, however long: a text, its
    pieces and its spans are one row of a task each. ``bits`` is the width of a word's fingerprint: few bits make
    words collide, which costs time and changes no answer.
    """
    if not 1 <= gram <= k:
        raise ValueError("a gram lies within a window")
    with _hashed_joins(df.sparkSession):
        return _remove_repeats(df, id_col, text_col, k, gram, with_text, bits)


def _remove_repeats(df: DataFrame, id_col: str, text_col: str, k: int, gram: int, with_text: bool, bits: int) -> DataFrame:
    docs = df.select(col(id_col).cast("long").alias("doc"), col(text_col).cast("string").alias("text"))
    twice = docs.where("doc is not null").groupBy("doc").count().where("count > 1").select("doc")
    if twice.isEmpty():
        docs = docs.withColumn("part", F.lit(0).cast("long"))
    else:  # rows with one id are told apart by their text
        marked = docs.join(settle(twice.withColumn("many", F.lit(True))), "doc", "left")
        docs = marked.select("doc", "text", F.when(F.col("many"), F.xxhash64("text")).otherwise(0).alias("part"))
    known = docs.where("doc is not null")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            for block in text_blocks(batch.column("text")):
                row, key, *_ = _pieces(block, k, gram, bits)
                pairs = _distinct(row, key)
                yield _table({"key": pairs[1], "doc": doc[block.first + pairs[0]]})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, part = batch.column("doc").to_numpy(), batch.column("part").to_numpy()
            for block in text_blocks(batch.column("text")):
                row, key, start, windows, path = _pieces(block, k, gram, bits)
                at = block.first + row
                yield _table({"key": key, "path": path, "doc": doc[at], "part": part[at], "start": start, "n": windows})

    def segments_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("wanted")
            edges = lists.offsets.to_numpy()
            wanted = lists.values.flatten()
            doc, part = batch.column("doc").to_numpy(), batch.column("part").to_numpy()
            for block in text_blocks(batch.column("text")):
                h, bounds = _words(block, bits)
                windows, nodes = _rolling(h, k).view(np.int64), _rolling(h, k - 1).view(np.int64)
                lo, hi = edges[block.first], edges[block.first + block.rows]
                start, n, fork = (x.to_numpy(zero_copy_only=False)[lo:hi] for x in wanted)
                row = np.repeat(np.arange(block.rows), np.diff(edges[block.first : block.first + block.rows + 1]))
                opened = np.where(fork, n, 1)
                each = np.repeat(np.arange(len(n)), opened)
                step = np.arange(len(each)) - np.repeat(np.cumsum(opened) - opened, opened)
                size = np.where(fork, 1, n)[each]
                at = (bounds[row] + start)[each] + step
                yield _table(
                    {
                        "doc": doc[block.first + row][each],
                        "part": part[block.first + row][each],
                        "start": start[each],
                        "pos": start[each] + step,
                        "n": size,
                        "window": pa.array(windows[at], mask=~fork[each]),
                        "head": nodes[at],
                        "tail": nodes[at + size],
                    }
                )

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, part, text, wanted in zip(*(batch.column(c) for c in ("doc", "part", "text", "wanted"))):
                words = text.as_py().encode().split()
                at = sorted({i for x in wanted.as_py() for i in range(x["start"], x["start"] + x["n"])})
                sha = [hashlib.sha256(b" ".join(words[i : i + k])).digest() for i in at]
                same = {"doc": pa.array([doc.as_py()] * len(at), pa.int64()), "part": pa.array([part.as_py()] * len(at), pa.int64())}
                yield _table(same | {"begin": pa.array(at, pa.int64()), "sha": pa.array(sha, pa.binary())})

    # 1. Keys of more than one document.
    shared = settle(
        known.mapInArrow(keys, "key long, doc long")
        .groupBy("key")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        .where("low < high")
        .select("key")
    )
    # 2. Their pieces, wherever they occur.
    piece_schema = "key long, path long, doc long, part long, start long, n long"
    occurrences = settle(known.mapInArrow(pieces, piece_schema).join(shared, "key"))
    # 3. Distinct pieces; a key with one of them does not branch.
    distinct = settle(
        occurrences.groupBy("key", "path", F.col("n").alias("windows"))
        .agg(*_first("start"))
    )
    forks = settle(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1").select("key"))
    # 4. Edges of branching keys (with a window), and the ends of all other pieces, at their source.
    fork = F.coalesce("fork", F.lit(False)).alias("fork")
    wanted = (
        distinct.join(forks.withColumn("fork", F.lit(True)), "key", "left")
        .groupBy("doc", "part")
        .agg(F.collect_list(F.struct("start", F.col("windows").alias("n"), fork)).alias("wanted"))
    )
    opened = settle(
        known.join(wanted, ["doc", "part"]).mapInArrow(
            segments_at, "doc long, part long, start long, pos long, n long, window long, head long, tail long"
        )
    )
    discard(shared, forks)
    # 5. Each distinct path once, at its first document; linked paths are one unit.
    edges = settle(
        opened.where("window is not null")
        .groupBy("window")
        .agg(*_first("pos"), F.min("head").alias("head"), F.min("tail").alias("tail"))
        .withColumn("n", F.lit(1).cast("long"))
    )
    ends = ["doc", "part", "pos", "n", "head", "tail", "window"]
    straight = opened.where("window is null")
    units = settle(_units(straight.select(*ends).unionByName(edges.select(*ends)), "n", "window"))
    discard(edges)
    # 6. The way of each distinct piece through the units.
    placed = units.where("window is not null").select("window", "unit", "off", F.col("doc").alias("first"))
    piece = ["doc", "part", "start"]
    walked = settle(
        opened.where("window is not null")
        .select(*piece, (F.col("pos") - F.col("start")).alias("begin"), "window")
        .join(placed, "window")
        .select(*piece, "begin", "unit", "off", "first")
        .repartition(*piece)
        .sortWithinPartitions(F.xxhash64(*piece))  # one number sorts faster; pieces that share it stand in several rows
        .mapInArrow(
            _walks,
            "doc long, part long, start long, way array<struct<begin:long,n:long,unit:long,off:long,first:long>>",
        )
    )
    discard(opened)
    own = F.struct(F.lit(0).cast("long").alias("begin"), "n", "unit", "off", F.col("doc").alias("first"))
    whole = units.where("window is null").select("doc", "part", F.col("pos").alias("start"), F.array(own).alias("way"))
    ways = settle(
        distinct.join(walked.unionByName(whole), piece).select("key", "path", F.col("windows").alias("n"), "way")
    )
    discard(distinct, walked)
    # 7. What each occurrence loses: the steps that came before, as spans of units.
    lost = F.transform(
        F.filter("way", lambda x: x["first"] < F.col("doc")),
        lambda x: F.struct((F.col("start") + x["begin"]).alias("begin"), x["n"].alias("n"), x["unit"].alias("unit"), x["off"].alias("off")),
    )
    spans = settle(
        occurrences.join(ways, ["key", "path", "n"])
        .select("doc", "part", lost.alias("lost"))
        .where(F.size("lost") > 0)
        .groupBy("doc", "part")
        .agg(F.flatten(F.collect_list("lost")).alias("spans"))
        .mapInArrow(_merged, f"doc long, part long, spans {_SPANS}")
    )
    discard(ways)
    # 8. Each distinct span is asked for at its source, and spans and questions meet their texts.
    sources = units.where("off = 0").select("doc", "part", "pos", "unit")
    asked = (
        spans.select(F.explode("spans").alias("s"))
        .select("s.unit", "s.off", "s.n")
        .distinct()
        .join(sources, "unit")
        .groupBy("doc", "part")
        .agg(F.collect_list(F.struct((F.col("pos") + F.col("off")).alias("begin"), "n", "unit", "off")).alias("asked"))
    )
    none = F.array().cast(_SPANS)
    lists = settle(spans.join(asked, ["doc", "part"], "full"))
    discard(spans, units)
    out = settle(
        docs.join(lists, ["doc", "part"], "left")
        .select("doc", "part", "text", F.coalesce("spans", none).alias("spans"), F.coalesce("asked", none).alias("asked"))
        .mapInArrow(_cut(k, with_text), _CUT)
    )
    discard(lists)
    # 9. Words decide: spans whose digests differ.
    proofs = out.select("doc_id", "part", F.explode("proofs").alias("p")).select("doc_id", "part", "p.*")
    low, high = ([f(c).alias(f"{end}_{c}") for c in _DIGEST] for f, end in ((F.min, "low"), (F.max, "high")))
    false = settle(
        proofs.groupBy("unit", "off", "n")
        .agg(*low, *high)
        .where(" or ".join(f"low_{c} != high_{c}" for c in _DIGEST))
        .select("unit", "off", "n")
    )
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]
    if false.isEmpty():
        return out.select(*columns)
    # 10. Documents of such spans again, by the words of every window that may repeat.
    doubted = settle(
        proofs.where("own").join(false, ["unit", "off", "n"]).select(F.col("doc_id").alias("doc"), "part").distinct()
    )
    suspects = occurrences.join(doubted, ["doc", "part"]).select("key").distinct()
    places = (
        occurrences.join(suspects, "key")
        .groupBy("doc", "part")
        .agg(F.collect_set(F.struct("start", "n")).alias("wanted"))
    )
    windows = settle(known.join(places, ["doc", "part"]).mapInArrow(spelled, "doc long, part long, begin long, sha binary"))
    first = windows.groupBy("sha").agg(F.min("doc").alias("first"))
    one = F.struct("begin", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("unit"), F.lit(0).cast("long").alias("off"))
    again = (
        windows.join(doubted, ["doc", "part"])
        .join(first, "sha")
        .where("first < doc")
        .groupBy("doc", "part")
        .agg(F.collect_set(one).alias("spans"))
    )
    redone = (
        known.join(doubted, ["doc", "part"])
        .join(again, ["doc", "part"], "left")
        .select("doc", "part", "text", F.coalesce("spans", none).alias("spans"), none.alias("asked"))
        .mapInArrow(_cut(k, with_text), _CUT)
    )
    right = out.join(doubted.withColumnRenamed("doc", "doc_id"), ["doc_id", "part"], "left_anti")
    return right.select(*columns).unionByName(redone.select(*columns))


def _distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]
