"""MinHash near-dedup with circulant permutations.

One permutation scatters a document's word shingles over ``1 << PLACES`` places; a second one, shifted by k
places, gives coordinate k of the signature. All coordinates of a shingle are neighbours in one table, so a
signature is a running minimum of table rows. Bands of coordinates propose pairs, and the full sets decide.

Equal sets are one class from the start. In each bucket of a band the members first meet one of them, the pivot,
which joins most buckets to one component. Where a bucket still holds several, members of different
components meet: in buckets of at most ``FEW`` documents pair by pair, in larger ones what lies outside
the largest component meets the whole bucket, block against block, so what is shuffled are blocks and what
comes out are links; there two documents are compared in the first band they share. So every link
between members of a bucket is within a component in the end.

With 48 bands of 6, two documents of similarity 0.8 share no bucket with probability 5e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.components import components
from tillgrid.llm.support import col, fresh, settle
from tillgrid.llm.textblocks import Block, mix, rows_of, run_hashes, text_blocks

SHINGLE = 5
PERCENT = 80
BANDS = 48
BAND_ROWS = 6
PLACES = 20
FEW = 16
BLOCK_DOCS = 512
_STEP = np.uint64(0x2545F4914F6CDD1D)
_tables: dict[int, np.ndarray] = {}


def circulant(width: int) -> np.ndarray:
    """The second permutation, wrapped so that row i holds its values at places i to i + width - 1."""
    if width not in _tables:
        order = np.argsort(mix(np.arange(1 << PLACES, dtype=np.uint64) + np.uint64(1)), kind="stable").astype(np.uint32)
        _tables[width] = np.lib.stride_tricks.sliding_window_view(np.concatenate((order, order[: width - 1])), width)
    return _tables[width]


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each text's distinct shingles in rising order, and where each text's begin.

    A text of fewer words than ``size`` has its whole word sequence as its one shingle.
    """
    starts, ends, bounds = block.words()
    h = run_hashes(block.data, starts, ends, lower=True)
    row, count = rows_of(bounds), np.diff(bounds)
    width = max(0, len(h) - size + 1)
    runs = np.zeros(width, np.uint64)
    for i in range(size):
        runs = runs * _STEP + h[i : i + width]
    inside = row[:width] == row[size - 1 :] if width else np.zeros(0, bool)
    values, owner = mix(runs[inside]), row[:width][inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        alone = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            more = count[short] > i
            alone[more] = alone[more] * _STEP + h[bounds[short[more]] + i]
        values = np.concatenate((values, mix(alone + count[short].astype(np.uint64))))
        owner = np.concatenate((owner, short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(block.rows + 1))


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """All coordinates of one set's signature."""
    table = circulant(width)
    places = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - PLACES)).astype(np.int64)
    out = np.full(width, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(places), 1024):
        np.minimum(out, table[places[i : i + 1024]].min(axis=0), out=out)
    return out


def _signed(df: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc, n, digest (two longs), band keys; none for rows without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                values, bounds = shingle_sets(block, size)
                keys = np.zeros((block.rows, bands), np.uint64)
                low, high = np.zeros(block.rows, np.uint64), np.zeros(block.rows, np.uint64)
                for i in range(block.rows):
                    own = values[bounds[i] : bounds[i + 1]]
                    if not len(own):
                        continue
                    low[i], high[i] = own.sum(), mix(own).sum()
                    coordinates = signature(own, bands * rows).reshape(bands, rows)
                    key = numbers.copy()
                    for j in range(rows):
                        key = mix(key + coordinates[:, j])
                    keys[i] = key
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(block.first, block.rows),
                        pa.array(np.diff(bounds)),
                        pa.array(low.view(np.int64)),
                        pa.array(high.view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(block.rows + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel())
                        ),
                    ],
                    names=["doc", "n", "low", "high", "keys"],
                )

    return df.mapInArrow(sign, "doc long, n long, low long, high long, keys array<long>")


def _sets(df: DataFrame, size: int) -> DataFrame:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                values, bounds = shingle_sets(block, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(block.first, block.rows),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64))),
                    ],
                    names=["doc", "shingles"],
                )

    return df.mapInArrow(whole, "doc long, shingles array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar enough."""
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("right"))
    common = F.size(F.array_intersect("left", "right")).cast("long")
    union = F.size("left") + F.size("right") - common
    return pairs.join(left, "a").join(right, "b").where(100 * common >= percent * union).select("a", "b")


def _linked_in_blocks(members: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Links a, b between members of a bucket in different components; members: key, doc, at."""
    parts = members.groupBy("key", "at").agg(F.count(F.lit(1)).alias("c"))
    sizes = parts.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "at")).alias("top"))
    sizes = sizes.select("key", F.col("top.at").alias("home"), "all", (F.col("all") - F.col("top.c")).alias("out"))
    known = settle(members.join(settle(sizes), "key"))
    told = F.struct("doc", "at", "keys", "shingles")

    def blocks(rows: DataFrame, size: str, name: str, number: str) -> DataFrame:
        count = F.ceil(F.col(size) / BLOCK_DOCS)
        dealt = rows.withColumns({"many": count, number: F.pmod(F.xxhash64("doc"), count)})
        return dealt.join(info, "doc").groupBy("key", number).agg(F.max("many").alias(f"{name}_many"), F.collect_list(told).alias(name))

    left = blocks(known.where("at <> home"), "out", "left", "x")
    right = blocks(known, "all", "right", "y").drop("right_many")
    reach = known.groupBy("key").agg(F.max(F.ceil(F.col("all") / BLOCK_DOCS)).alias("ys"))
    met = left.drop("left_many").join(reach, "key").withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ys") - 1)))

    def side(column: pa.Array, i: int):
        rows = column[i].values
        doc, at = rows.field("doc").to_numpy(), rows.field("at").to_numpy()
        keys = np.asarray(rows.field("keys").flatten()).reshape(len(doc), -1)
        shingles = rows.field("shingles")
        return doc, at, keys, np.asarray(shingles.flatten()), np.concatenate(([0], np.cumsum(np.asarray(shingles.value_lengths()))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("key")[i].as_py()
                doc, at, keys, shingles, cut = side(batch.column("left"), i)
                doc2, at2, keys2, shingles2, cut2 = side(batch.column("right"), i)
                home = batch.column("home")[i].as_py()
                n, n2 = np.diff(cut), np.diff(cut2)
                a, b = [], []
                for x in range(len(doc)):
                    # Once for each pair of outsiders, in the first band that both share, and only if sizes allow.
                    use = (at2 != at[x]) & ((at2 == home) | (doc2 > doc[x]))
                    use &= 100 * np.minimum(n2, n[x]) >= percent * np.maximum(n2, n[x])
                    y = np.flatnonzero(use)
                    y = y[keys2[y, (keys2[y] == keys[x]).argmax(axis=1)] == key]
                    if not len(y):
                        continue
                    own = shingles[cut[x] : cut[x + 1]]  # in rising order as unsigned numbers
                    own = np.sort(own)
                    each = np.repeat(cut2[y] - (np.cumsum(n2[y]) - n2[y]), n2[y]) + np.arange(n2[y].sum())
                    other = shingles2[each]
                    hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                    common = np.add.reduceat(hit.astype(np.int64), np.cumsum(n2[y]) - n2[y])
                    close = 100 * common >= percent * (n[x] + n2[y] - common)
                    a += [int(doc[x])] * int(close.sum())
                    b += doc2[y[close]].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    homes = known.select("key", "home").distinct()
    pairs = met.join(right, ["key", "y"]).join(homes, "key").select("key", "home", "left", "right")
    return pairs.mapInArrow(compare, "a long, b long")


def near_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row.

    Two rows are linked when ``100 * intersection >= percent * union`` of their sets of distinct shingles of
    ``size`` lower-cased words; fewer words are one shingle. A component's id is its smallest id, and the rows
    with that id stay. Rows without words (null, empty, white space) are their own component. Rows without an
    id have no component and stay. Rows that repeat an id each have their own set; equal sets share a
    component, and sets whose smallest id is the same do too. An empty table gives no rows; other columns are
    ignored.
    """
    docs = df.select(col(id_col).cast("long").alias("doc"), col(text_col).cast("string").alias("text"))
    signed = settle(_signed(docs, size, bands, band_rows))
    able = signed.where("n > 0 and doc is not null")
    classes = settle(able.groupBy("low", "high", "n").agg(F.min("doc").alias("rep")))
    # Buckets with more than one class; of a class only its first document goes on.
    reps = classes.select(F.col("rep").alias("doc"), "low", "high")
    first = settle(able.join(reps, ["doc", "low", "high"], "left_semi").select("doc", "n", "keys"))
    exploded = first.select("doc", "n", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("key")
    members = settle(exploded.join(settle(shared), "key"))
    candidates = settle(members.select("doc").distinct())
    sets = settle(_sets(docs.join(candidates, "doc", "left_semi"), size))
    near = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")

    def meet(rows: DataFrame, others: DataFrame, apart: Column) -> DataFrame:
        """Links between rows and others (key, doc2, n2, at2) of their bucket in other components."""
        pairs = rows.join(others, "key").where(apart & near)
        pairs = pairs.select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()
        return settle(_linked(pairs, sets, percent))

    members = members.withColumn("at", F.col("doc"))
    pivots = settle(members.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("p")))
    hub = pivots.select("key", F.col("p.doc").alias("doc2"), F.col("p.n").alias("n2"), F.col("p.doc").alias("at2"))
    links = meet(members, hub, F.col("at") != F.col("at2"))
    roots = components(links)
    placed = members.join(roots, members["doc"] == roots["node"], "left")
    placed = settle(placed.select("doc", "n", "key", F.coalesce("root", "doc").alias("at")))
    open_ = placed.groupBy("key").agg(F.min("at").alias("x"), F.max("at").alias("y"), F.count(F.lit(1)).alias("size"))
    open_ = settle(open_.where("x < y").select("key", "size"))
    # The pivot has met its whole bucket.
    left = placed.join(pivots.select("key", F.col("p.doc").alias("doc")), ["key", "doc"], "left_anti")
    left = settle(left.join(open_, "key"))
    few = left.where(F.col("size") <= FEW).drop("size")
    if not few.isEmpty():
        others = few.select("key", F.col("doc").alias("doc2"), F.col("n").alias("n2"), F.col("at").alias("at2"))
        links = links.unionByName(meet(few, others, F.col("at") < F.col("at2")))
    many = left.where(F.col("size") > FEW).select("key", "doc", "at")
    if not many.isEmpty():
        info = sets.join(first.select("doc", "keys"), "doc")
        links = links.unionByName(settle(_linked_in_blocks(many, info, percent)))
    roots = components(links)
    labelled = signed.join(classes, ["low", "high", "n"], "left")
    labelled = labelled.join(roots, labelled["rep"] == roots["node"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc"))
    component = F.when(F.col("doc").isNotNull(), own)
    return labelled.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("doc").isNull() | (F.col("doc") == component)).alias("kept"),
    )


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with the columns they came with; of each component the rows with its smallest id."""
    (gone_id,) = fresh(df, "gone_id")
    gone = near_groups(df, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias(gone_id))
    kept = df.join(settle(gone), col(id_col).cast("long") == col(gone_id), "left_anti")
    return kept.select(*[col(c) for c in df.columns])
