"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` places; each shard owns ``nodes`` of them by hash. A row's id chooses its place, and
the row belongs to the next node clockwise. Every shard has room for its even share of the rows and no
more: what does not fit goes on clockwise to the next shard with room. Rows between the same two nodes
(an arc) share one walk around the ring, so the walk is planned over row counts per arc, ``shards * nodes``
numbers whatever the table holds, and each row then finds its shard from its rank in its arc. A place with
many rows, as where they have no id or one id repeats, is ranked in parts, none of which waits for another.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.support import col, ranked, settle

NODES = 64
CELLS = 1 << 16
PART_ROWS = 100_000  # of a place, ranked by one task


def ring(shards: int, nodes: int = NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(place, shard) of every node in clockwise order. A further shard adds nodes and moves none."""
    points = {}
    for shard in range(shards):
        for node in range(nodes):
            place = int.from_bytes(hashlib.md5(f"{shard}/{node}".encode()).digest()[:8], "big") % cells
            points.setdefault(place, shard)  # a place taken by two nodes stays with the older shard
    return sorted(points.items())


def clockwise(points: list[tuple[int, int]], arc: int) -> list[int]:
    """The distinct shards met from an arc's node on."""
    return list(dict.fromkeys(points[(arc + i) % len(points)][1] for i in range(len(points))))


def plan_loads(counts: list[int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, shard, from rank, to rank, first slot): arcs ask their next shard in turn until all rows have one."""
    left, taken, used, out = list(counts), [0] * len(counts), [0] * len(room), []
    walks = [clockwise(points, arc) for arc in range(len(points))]
    for step in range(len(room)):
        for arc, walk in enumerate(walks):
            if not left[arc] or step >= len(walk):
                continue
            shard = walk[step]
            n = min(left[arc], room[shard] - used[shard])
            if n:
                out.append((arc, shard, taken[arc], taken[arc] + n, used[shard]))
                left[arc] -= n
                taken[arc] += n
                used[shard] += n
    return out


def shard_rows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, nodes: int = NODES, cells: int = CELLS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``shard``, ``slot`` per row; counts of shards are at most one apart.

    Slots run from 0 without gaps in every shard. Rows without an id share one place of the ring, and
    whatever their number overflow like all others. A null text has size 1 and checksum 0; of a text, however
    long, only these two numbers are kept. Equal rows get different slots. A place of more than ``part_rows`` rows
    is ranked in parts, by a hash of the row and the partition it was read from, so which of its rows goes on to the next shard
    depends on the input's files. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    points = ring(shards, nodes, cells)
    if len({shard for _, shard in points}) < shards:
        raise ValueError("more shards than the ring has places for; raise cells or nodes")
    places = [place for place, _ in points]
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = settle(  # numbers only; the part of a row must not change between the two times it is read below
        df.select(
            col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(col(id_col)), F.lit(cells)).cast("int").alias("place"),
            F.spark_partition_id().alias("part"),
        )
    )
    counts, arcs = [0] * len(points), []
    for place, n in rows.groupBy("place").count().collect():  # at most ``cells`` rows
        arc = bisect_left(places, place) % len(points)
        counts[arc] += n
        arcs.append((arc, place, 1 + n // part_rows))
    total = sum(counts)
    room = [total // shards + (shard < total % shards) for shard in range(shards)]
    plan = plan_loads(counts, points, room)
    arcs = F.broadcast(spark.createDataFrame(arcs, "arc int, place int, parts long"))  # at most ``cells`` rows
    order = [F.xxhash64("id"), F.col("id"), F.col("size"), F.col("text_crc32")]
    part = F.pmod(F.xxhash64("id", "size", "text_crc32", "part"), F.col("parts"))
    cell = F.col("place").cast("long") * (1 << 40) + F.when(F.col("parts") > 1, part).otherwise(0)
    rows = rows.join(arcs, "place").select("id", "size", "text_crc32", "arc", cell.alias("cell"))
    placed = F.broadcast(  # at most shards * nodes * shards rows
        spark.createDataFrame(plan, "arc int, shard int, lo long, hi long, base long")
    )
    found = ranked(rows, "arc", "cell", order, "rank").join(placed, "arc").where("rank >= lo and rank < hi")
    return found.select("id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))
