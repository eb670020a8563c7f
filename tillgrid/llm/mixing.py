"""Mixing sources to target weights by Pfair scheduling.

The rows of each source, over and over, are cut into blocks of one size. Block i of a source with weight w may start at slot floor(i / w) and
must end by slot ceil((i + 1) / w); of the blocks that may start, the one due first takes the slot. After
any number of slots a source is then less than one block away from its share, in rows as in slots: the last rows
of a source share a block with its first. The weights are taken as they
are, as whole parts of their exact sum, over all slots of the mix. The driver deals the slots, some
microseconds each, in ranges of bounded size; each range is written out, and blocks meet their slots in a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import reduce
from itertools import count, islice
from math import inf, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrid.llm.support import col, fresh, ranked, settle

BLOCK_ROWS = 32
CELL_ROWS = 1_000
RANGE = 1 << 19  # slots that the driver holds at once
BROADCAST_SOURCES = 100_000  # a row each; more are joined by shuffle
BROADCAST_SLOTS = 1_000_000  # some 40 bytes each, for 32 million rows of a mix
SLOTS = "s string, block long, epoch long, slot long"


def exact_parts(weights: Mapping[str, float]) -> dict[str, int]:
    """Weights as whole parts of their sum, without rounding."""
    if any(not 0 < w < inf for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(float(w)) for s, w in weights.items()}
    unit = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * unit) for s, x in exact.items()}


def parts_of(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Weights as whole parts of the period, each at least one, by largest remainder."""
    if len(weights) > period:
        raise ValueError("a period needs a slot for every source")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    while (spare := period - sum(parts.values())) != 0:
        step = 1 if spare > 0 else -1
        far = sorted(
            (s for s in parts if step > 0 or parts[s] > 1), key=lambda s: (step * (parts[s] - exact[s]), s)
        )
        for s in far[: abs(spare)]:
            parts[s] += step
    return parts


def turns(parts: Mapping[str, int]) -> Iterator[str]:
    """The source of each slot, without end, earliest deadline first."""
    total = sum(parts.values())
    done = dict.fromkeys(parts, 0)
    waiting = [(0, s) for s in parts]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for slot in count():
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * total // parts[s]), s))
        _, s = heapq.heappop(ready)
        done[s] += 1
        heapq.heappush(waiting, (done[s] * total // parts[s], s))
        yield s


def schedule(parts: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks within as many slots as there are parts."""
    slots: dict[str, list[int]] = {s: [] for s in parts}
    for slot, s in enumerate(islice(turns(parts), sum(parts.values()))):
        slots[s].append(slot)
    return slots


def places(parts: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """Source, block, epoch and slot, until every block of every source had its first slot."""
    done, left = dict.fromkeys(parts, 0), len(parts)
    for slot, s in enumerate(turns(parts)) if parts else ():
        epoch, block = divmod(done[s], blocks[s])
        yield s, block, epoch, slot
        done[s] += 1
        left -= done[s] == blocks[s]
        if not left:
            return


def slot_table(
    spark: SparkSession, parts: Mapping[str, int], blocks: Mapping[str, int], slots: int = RANGE
) -> DataFrame:
    """What ``places`` gives, written in ranges of slots."""
    rest, ranges = places(parts, blocks), []
    while (held := list(islice(rest, slots))) or not ranges:
        s, *numbers = zip(*held) if held else ((), (), (), ())
        table = pa.table([pa.array(s, pa.string()), *(pa.array(n, pa.int64()) for n in numbers)], names=["s", "block", "epoch", "slot"])
        ranges.append(settle(spark.createDataFrame(table, SLOTS)))
    return reduce(DataFrame.unionByName, ranges)


def tempered(sizes: Mapping[str, int], power: float) -> dict[str, float]:
    """Weights in proportion to a power of the source sizes; a power below 1 favours small sources."""
    return {s: n**power for s, n in sizes.items() if n}


def mix(
    df: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: Mapping[str | None, float] | None = None,
    power: float = 0.8,
    block_rows: int = BLOCK_ROWS,
    period: int | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The rows with ``mix_epoch``, ``mix_block``, ``mix_slot`` and ``mix_place``, in as many copies as the weights ask for.

    The schedule runs until every row has been used once; a source that ends before starts over, so
    nothing is dropped and small sources come back in later epochs. ``weights`` names every source
    (None: the rows without one); without it they are the sizes to ``power``. A null source is a source.
    There may be any number of sources, and a weight may be as small as it likes: the mix is then as long
    as that source's share of its first pass asks for. With a ``period`` the weights are first rounded to
    whole parts of so many slots, at least one each, and there may be no more sources than that.
    Rows of one source are taken in the order of a hash of their id; equal ids follow one another. Every slot
    holds ``block_rows`` rows: ``mix_block`` counts the blocks of a source, ``mix_epoch`` how often a row
    came before, and a block may end one epoch and begin the next, so a source of a few rows stands several
    times in one block. Existing columns with these names are renamed by a trailing underscore on the new ones.
    Rows without an id are dealt to tasks by a hash of their content; of other rows texts, however long, are only carried.
    An empty table stays empty.
    """
    spark = df.sparkSession
    epoch, block, slot, place = fresh(df, "mix_epoch", "mix_block", "mix_slot", "mix_place")
    named = F.coalesce(F.concat(F.lit("="), col(source_col).cast("string")), F.lit("~"))
    sizes = {s: n for s, n in df.select(named.alias("s")).groupBy("s").count().collect()}  # one row per source of the recipe
    if weights is None:
        shares = tempered(sizes, power)
    else:
        shares = {"~" if s is None else f"={s}": w for s, w in weights.items()}
        if missing := sorted(set(sizes) - set(shares)):
            raise ValueError(f"no weight for {missing}")
        shares = {s: w for s, w in shares.items() if s in sizes}
    parts = exact_parts(shares) if period is None else parts_of(shares, period)
    per = {s: -(-n // block_rows) for s, n in sizes.items()}
    sized = spark.createDataFrame([(s, n, per[s]) for s, n in sizes.items()], "s string, rows long, blocks long")
    if len(sizes) <= BROADCAST_SOURCES:
        sized = F.broadcast(sized)
    slots = slot_table(spark, parts, per)
    few = slots.count() <= BROADCAST_SLOTS
    turn = (F.col("epoch") * F.col("blocks") + F.col("block")).alias("turn")
    dealt = slots.join(sized, "s").select("s", "rows", turn, "slot")
    # How often the rows of a source may come: one row for each source.
    last = dealt.groupBy("s").agg(F.max("rows").alias("rows"), F.ceil((F.max("turn") + 1) * block_rows / F.max("rows")).alias("epochs"))
    last = last.withColumnRenamed("s", "of")
    cells = max(1, -(-sum(sizes.values()) // cell_rows))
    hashed = [col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    content = F.xxhash64(*hashed)  # rows without an id have only their content to be dealt by
    rows = df.select(
        F.struct(*[col(c) for c in df.columns]).alias("row"),
        named.alias("source"),
        F.pmod(F.when(col(id_col).isNull(), content).otherwise(F.xxhash64(col(id_col))), F.lit(cells)).alias("cell"),
        F.xxhash64(col(id_col), F.lit(1)).alias("draw"),
        col(id_col).alias("id"),
    )
    numbered = ranked(rows, "source", "cell", [F.col("draw"), F.col("id")], "rank").select("row", "source", "rank")
    if len(sizes) <= BROADCAST_SOURCES:
        last = F.broadcast(last)
    again = numbered.join(last, F.col("source") == F.col("of")).select(
        "row", "source", "rank", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch")
    )
    at = F.col("rank") + F.col("epoch") * F.col("rows")
    placed = again.select("row", "source", "epoch", F.floor(at / block_rows).alias("own"), (at % block_rows).alias("place"))
    at_slots = dealt.drop("rows")
    if few:  # counted above; else both sides are shuffled, the rows as often as they come
        at_slots = F.broadcast(at_slots)
    held = placed.join(at_slots, (F.col("source") == F.col("s")) & (F.col("own") == F.col("turn")))
    return held.select(
        *[F.col("row").getField(c).alias(c) for c in df.columns],
        F.col("epoch").alias(epoch), F.col("own").alias(block), F.col("slot").alias(slot), F.col("place").alias(place),
    )
