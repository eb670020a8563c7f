"""Statistics behind the charts: intervals, correlation, histogram, density, box, line fit."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tillgrid.functions import nan_to_null, ratio
from tillgrid.operators.support import (
    BROADCAST_ROWS,
    broadcast_if_small,
    column,
    name_list,
    settle,
    with_keys,
)

# Beyond this many bandwidths exp(-z*z/2) is exactly zero in double precision.
KERNEL_REACH = 39.0


def mean_ci_by(
    df: DataFrame,
    keys: str | Iterable[str],
    col: str,
    ci: str = "normal",
    z: float = 1.96,
    replicates: int = 1000,
    row_key: Sequence[str] = (),
    blocks: int = 512,
) -> DataFrame:
    """Mean per key with a 95 % interval.

    ``normal`` is mean ± z·sd/√n. ``bootstrap`` deals the rows of a key to ``blocks`` blocks by a hash of
    ``row_key`` and resamples the blocks with Poisson(1) weights drawn from a hash of (block,
    replicate): every row counts, a rerun task draws the same weights, and one scan of the rows does
    for all replicates. A key with fewer rows than blocks is resampled nearly row by row.
    """
    keys = name_list(keys)
    kept = with_keys(df, keys)
    by = [column(k) for k in keys]
    v = column(col).cast("double")
    base = kept.groupBy(*by).agg(*[figure.alias(name) for name, figure in interval_figures(col).items()])
    if ci == "normal":
        return normal_interval(base, keys, z)
    if ci != "bootstrap":
        raise ValueError(f"unknown interval {ci!r}")
    if not row_key:
        raise ValueError("bootstrap needs row_key: columns that tell rows apart")
    # One row per key and block of rows; from here on nothing grows with the rows.
    digest = F.md5(F.concat_ws("|", *[column(k).cast("string") for k in row_key]).cast("binary"))
    block = F.pmod(_bits(digest), F.lit(blocks)).alias("block")
    sums = kept.where(v.isNotNull()).groupBy(*by, block).agg(F.sum(v).alias("s"), F.count(F.lit(1)).alias("c"))
    # The weights are the same for all keys: one list per block, drawn once.
    weight = _poisson_weight(F.md5(F.concat_ws(":", "id", "replicate").cast("binary")))
    drawn = df.sparkSession.range(0, blocks, 1, 8).select(
        "id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    )
    drawn = drawn.select(F.col("id").alias("drawn_for"), F.struct("replicate", weight.alias("w")).alias("draw"))
    weights = settle(drawn.groupBy("drawn_for").agg(F.collect_list("draw").alias("draws")))
    means = (
        sums.join(F.broadcast(weights), F.col("block") == F.col("drawn_for"))  # blocks x replicates, both arguments
        .select(*by, "s", "c", F.inline("draws"))
        .where(F.col("w") > 0)
        .groupBy(*by, "replicate")
        .agg(ratio(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("c"))).alias("m"))
    )
    # At most `replicates` values per key reach this aggregate.
    limits = means.groupBy(*by).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    joined = base.join(limits, keys, "left")
    return joined.select(
        *by,
        "n",
        "mean",
        F.col("q")[0].alias("ci_low"),
        F.col("q")[1].alias("ci_high"),
    )


def interval_figures(col: str) -> dict[str, Column]:
    v = column(col).cast("double")
    return {"n": F.count(v), "mean": F.avg(v), "sd": F.stddev_samp(v)}


def normal_interval(base: DataFrame, keys: Sequence[str], z: float) -> DataFrame:
    """Mean ± z·sd/√n from the figures above."""
    half = F.lit(z) * F.col("sd") / F.sqrt(F.col("n"))
    ends = [(F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high")]
    return base.select(*map(column, keys), "n", "mean", *ends)


def _bits(digest: Column) -> Column:
    """The first 52 bits of a hex digest as a number; any engine can do the same."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def _poisson_weight(digest: Column) -> Column:
    """Poisson(1) draw: the first count whose cumulative probability exceeds a hashed uniform."""
    uniform = _bits(digest).cast("double") / F.lit(float(2**52))
    weight, term, total = None, math.exp(-1.0), 0.0
    for k in range(18):
        total += term
        below = uniform < F.lit(total)
        weight = F.when(below, F.lit(k)) if weight is None else weight.when(below, F.lit(k))
        term /= k + 1
    return weight.otherwise(F.lit(18))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in long form; each pair drops its own nulls.

    One scan: every pair keeps the moments of the rows where both columns are known, and tasks cut
    them to one row before the shuffle. A constant column gives NULL, where ``corr`` would fail in ANSI
    mode.
    """
    cols = list(cols)
    clean = df.select(*[nan_to_null(column(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]

    def where_known(i: int, j: int) -> Column:
        return F.when(F.col(f"c{j}").isNotNull(), F.col(f"c{i}"))

    moments = [(F.min(f"c{i}") < F.max(f"c{i}")).alias(f"varies{i}") for i in range(len(cols))]
    for i, j in pairs:
        moments.append(F.covar_pop(f"c{i}", f"c{j}").alias(f"cov{i}_{j}"))
        moments.append(F.var_pop(where_known(i, j)).alias(f"var{i}_{j}"))
        moments.append(F.var_pop(where_known(j, i)).alias(f"var{j}_{i}"))
    row = clean.agg(*moments)

    def r(i: int, j: int) -> Column:
        if i == j:
            return F.when(F.col(f"varies{i}"), F.lit(1.0))
        low, high = min(i, j), max(i, j)
        return _correlation(F.col(f"cov{low}_{high}"), F.col(f"var{low}_{high}"), F.col(f"var{high}_{low}"))

    cells = [
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r(i, j).alias("corr"))
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
    ]
    return row.select(F.inline(F.array(*cells)))


def _correlation(cov: Column, var_x: Column, var_y: Column) -> Column:
    r = F.try_divide(cov, F.sqrt(var_x) * F.sqrt(var_y))
    return F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def _known(df: DataFrame, col: str) -> DataFrame:
    return df.select(nan_to_null(column(col).cast("double")).alias("v")).where(F.col("v").isNotNull())


def _shape(rows: DataFrame) -> Row:
    """Number, limits and spread of the values: the first scan of a histogram, a density, or both."""
    return rows.agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd")
    ).first()


def histogram_with_density(df: DataFrame, col: str, bins: int = 30, grid: int = 200) -> DataFrame:
    """One chart: the bins, and the density drawn over them in counts, from one first scan.

    (kind, at, lo, hi, value): ``bin`` rows hold counts, ``curve`` rows density times rows times bin
    width at the point lo = hi.
    """
    rows = _known(df, col)
    shape = _shape(rows)
    lo, hi = _limits(shape)
    scale = F.lit(None if lo is None else shape["n"] * ((hi - lo) / bins)).cast("double")
    bars = _histogram(rows, shape, bins).select(
        F.lit("bin").alias("kind"), F.col("bin").alias("at"), "lo", "hi", F.col("n").cast("double").alias("value")
    )
    curve = _kde(rows, shape, grid).select(
        F.lit("curve"), "point", "x", F.col("x").alias("hi"), (F.col("density") * scale).alias("value")
    )
    return bars.union(curve)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Counts over equal-width bins from minimum to maximum, the last bin closed, empty bins 0.

    The first scan for the limits runs here, so the second has them as constants.
    """
    rows = _known(df, col)
    return _histogram(rows, _shape(rows), bins)


def _limits(shape: Row) -> tuple[float | None, float | None]:
    lo, hi = shape["lo"], shape["hi"]
    if lo is not None and lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return lo, hi


def _histogram(rows: DataFrame, shape: Row, bins: int) -> DataFrame:
    lo, hi = _limits(shape)
    width = None if lo is None else (hi - lo) / bins
    base, step = F.lit(lo).cast("double"), F.lit(width).cast("double")

    def edge(i: Column) -> Column:
        return base + i * step

    # The floor can be off by one at an edge; comparing with the edges settles it.
    guess = F.least(F.floor((F.col("v") - base) / step).cast("bigint"), F.lit(bins - 1).cast("bigint"))
    down = (F.col("v") < edge(F.col("bin"))).cast("bigint")
    up = ((F.col("v") >= edge(F.col("bin") + 1)) & (F.col("bin") < bins - 1)).cast("bigint")
    binned = rows.withColumn("bin", guess).select((F.col("bin") - down + up).alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    # `counts` has one row per bin at most.
    dense = rows.sparkSession.range(0, bins, 1, 1).withColumnRenamed("id", "bin")
    dense = dense.join(F.broadcast(counts), "bin", "left")
    return dense.select(
        "bin",
        edge(F.col("bin")).alias("lo"),
        edge(F.col("bin") + 1).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
    )


def kde(
    df: DataFrame, col: str, grid: int = 200, block: int = 20, method: str = "exact", error: float = 1e-4
) -> DataFrame:
    """Gaussian density on an even grid from minimum to maximum, bandwidth h = sd·n^(-1/5).

    ``exact``: each row meets the blocks of grid points its kernel reaches and adds to all points of a
    block at once; tasks cut the sums to one row per block. The bandwidth shrinks as rows
    grow, and with it the reach, which leaves out only terms that are zero.

    ``binned``: each row splits its weight on the two nearest points of a finer grid, and that grid, not the
    rows, meets the kernel. A value's kernel is then its chord between points a step d apart, so no density is off by
    more than d²/8 times the largest curvature of the kernel, 1/(sqrt(2π)·h³). The step is chosen so that this is
    ``error`` times the kernel's peak 1/(sqrt(2π)·h): d = h·sqrt(8·error). Its cost is one scan with one
    row per point and task, whatever the grid.
    """
    if method not in ("exact", "binned"):
        raise ValueError(f"unknown method {method!r}")
    rows = _known(df, col)
    shape = _shape(rows)
    return _kde(rows if method == "exact" else _binned(rows, shape, error), shape, grid, block)


def _binned(rows: DataFrame, shape: Row, error: float) -> DataFrame:
    """(v, w): the points of a fine grid that rows lie beside, with the rows' weights."""
    spread = shape["n"] > 1 and shape["sd"] > 0
    step = F.lit(shape["sd"] * shape["n"] ** -0.2 * math.sqrt(8 * error) if spread else 1.0)
    lo = F.lit(shape["lo"]).cast("double")
    at = (F.col("v") - lo) / step
    cell = F.floor(at)
    over = at - cell
    parts = F.array(
        F.struct(cell.alias("cell"), (F.lit(1.0) - over).alias("w")), F.struct((cell + 1).alias("cell"), over.alias("w"))
    )
    cells = rows.select(F.inline(parts)).groupBy("cell").agg(F.sum("w").alias("w"))
    return cells.select((lo + F.col("cell") * step).alias("v"), "w")


def _kde(rows: DataFrame, shape: Row, grid: int, block: int = 20) -> DataFrame:
    """The density of rows (v), or of points (v, w) that stand for them."""
    weighted = "w" in rows.columns
    known = shape["n"] > 1 and shape["sd"] > 0
    lo = F.lit(shape["lo"]).cast("double")
    step = F.lit((shape["hi"] - shape["lo"]) / (grid - 1) if shape["n"] else None).cast("double")
    h = F.lit(shape["sd"] * shape["n"] ** -0.2 if known else None).cast("double")
    n = F.lit(float(shape["n"]))
    blocks = -(-grid // block)
    reach = h * F.lit(KERNEL_REACH)
    width = step * F.lit(float(block))
    first = F.greatest(F.floor(F.try_divide(F.col("v") - reach - lo, width)), F.lit(0))
    last = F.least(F.floor(F.try_divide(F.col("v") + reach - lo, width)), F.lit(blocks - 1))
    reached = rows.select(*rows.columns, first.alias("first"), last.alias("last")).where(F.col("first") <= F.col("last"))
    met = reached.select(*rows.columns, F.explode(F.sequence("first", "last")).alias("block"))
    # Distances in bandwidths: of the block's first point, and from one point to the next.
    z = (lo + F.col("block") * width - F.col("v")) / h
    met = met.select(*rows.columns[1:], "block", z.alias("z"), (step / h).alias("d"))
    masses = []
    for j in range(block):
        zj = F.col("z") + F.col("d") * F.lit(float(j))
        term = F.exp(zj * zj * F.lit(-0.5))
        masses.append(F.sum(F.col("w") * term if weighted else term).alias(f"mass_{j}"))
    # One row per block at most.
    sums = met.groupBy("block").agg(*masses)
    dense = rows.sparkSession.range(0, blocks, 1, 1).withColumnRenamed("id", "block").join(F.broadcast(sums), "block", "left")
    cells = [
        F.struct((F.col("block") * block + j).alias("point"), F.col(f"mass_{j}").alias("mass")) for j in range(block)
    ]
    points = dense.select(F.inline(F.array(*cells))).where(F.col("point") < grid)
    norm = n * h * F.lit(math.sqrt(2 * math.pi))
    return points.select(
        "point",
        (lo + F.col("point") * step).alias("x"),
        F.try_divide(F.coalesce(F.col("mass"), F.lit(0.0)), norm).alias("density"),
    )


def quantiles_by(
    df: DataFrame,
    group: str,
    col: str,
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    exact: bool = True,
    accuracy: int = 10_000,
    gather: int = 10_000,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles per group: (group, n, q), q an array in ``probs`` order.

    Groups of up to ``gather`` rows are small enough for one task's ``percentile``. A larger
    group is never gathered: see ``bracketed_quantiles``; its answer is the same to the last bit. ``exact=False`` returns the
    quantiles of a sketch with an error of one in ``accuracy``.
    """
    rows = df.select(column(group).alias(group), nan_to_null(column(col).cast("double")).alias("v"))
    rows = rows.where(column(group).isNotNull() & F.col("v").isNotNull())
    probs = [float(p) for p in probs]
    if not exact:
        return rows.groupBy(column(group)).agg(
            F.count("v").alias("n"), F.percentile_approx("v", probs, accuracy).alias("q")
        )
    sizes = settle(
        rows.groupBy(column(group)).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )
    large = sizes.where(F.col("n") > gather)
    has_large, has_small = not large.isEmpty(), not sizes.where(F.col("n") <= gather).isEmpty()
    parts = []
    if has_large:
        parts.append(bracketed_quantiles(rows, large, group, probs, gather, broadcast_rows))
    if has_small or not has_large:
        if has_large:
            rows = rows.join(broadcast_if_small(large.select(column(group)), broadcast_rows), group, "left_anti")
        parts.append(
            rows.groupBy(column(group)).agg(
                F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, probs))).alias("q")
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


# Cells of the sketch that narrows a bracket, and the sketch's rank error as one part of the rows.
_CELLS = 1_000
_SKETCH = 10_000


def bracketed_quantiles(
    rows: DataFrame,
    large: DataFrame,
    group: str,
    probs: Sequence[float],
    gather: int,
    broadcast_rows: int,
    start: DataFrame | None = None,
    list_at_once: bool = False,
) -> DataFrame:
    """Exact quantiles of large groups by brackets of a rank sketch; no group is sorted or gathered.

    A pass takes two scans: one sketches the open bracket of every probability, one counts the rows
    below, on and between the new ends. A rank that falls on an end is found; otherwise the
    next pass narrows what lies strictly between, until at most ``gather`` rows do and one last scan
    lists them. The sketch bounds ranks, not values, so the spread of the values does not matter: the
    first pass leaves six in 10,000 rows, a further one three in 1,000 of those, and ends that hold
    many equal rows are never inside.

    ``start`` gives first brackets (lo0, hi0, lo1, ...) from elsewhere and spares the first sketch; where one misses its
    rank it is opened again. ``list_at_once`` says that they hold few enough rows to be listed as they are counted.
    """
    g, ids = column(group), range(len(probs))
    at = [F.lit(p) * (F.col("n") - 1) for p in probs]
    state = large.select(
        g,
        "n",
        *[F.floor(at[i]).alias(f"k{i}") for i in ids],
        *[F.ceil(at[i]).alias(f"m{i}") for i in ids],
        # The bracket, open at both ends, the rows up to its lower end, and those within; then the found values.
        *[F.lit(None).cast("double").alias(f"{name}{i}") for i in ids for name in ("lo", "hi", "low", "high")],
        *[F.lit(0).cast("long").alias(f"below{i}") for i in ids],
        *[F.col("n").alias(f"held{i}") for i in ids],
    )
    wide = max(3.0 / _SKETCH, 2.0 / gather)  # every group has more rows than ``gather``
    first = True
    while True:
        if first and start is not None:
            state = settle(state.drop(*[f"{end}{i}" for i in ids for end in ("lo", "hi")]).join(start, group))
            state = _counted(rows, state, group, ids, broadcast_rows, given=True, list_now=list_at_once)
            first = False
            if state.where(~_all([_settled(i, gather) for i in ids])).isEmpty():
                break
            continue
        met = rows.join(broadcast_if_small(state, broadcast_rows), group)
        if first:
            grids = [[max(0.0, p - wide), min(1.0, p + wide)] for p in probs]
        else:
            grids = [[c / _CELLS for c in range(_CELLS + 1)]] * len(probs)
        sketched = met.groupBy(g).agg(
            *[F.percentile_approx(F.when(_within(i), F.col("v")), grids[i], _SKETCH).alias(f"grid{i}") for i in ids]
        )
        ends = {}
        for i in ids:
            if first:
                low, high = F.col(f"grid{i}")[0], F.col(f"grid{i}")[1]
            else:
                cell = [
                    F.floor((F.col(f"{r}{i}") - F.col(f"below{i}")) * F.lit(_CELLS) / F.col(f"held{i}")) for r in "km"
                ]
                low = F.get(f"grid{i}", F.greatest(cell[0] - 1, F.lit(0)).cast("int"))
                high = F.get(f"grid{i}", F.least(cell[1] + 2, F.lit(_CELLS)).cast("int"))
            # A bracket that is found, or small enough, stays.
            done = _settled(i, gather)
            ends[f"lo{i}"] = F.when(done, F.col(f"lo{i}")).otherwise(low)
            ends[f"hi{i}"] = F.when(done, F.col(f"hi{i}")).otherwise(high)
        state = settle(state.join(sketched, group).withColumns(ends).drop(*[f"grid{i}" for i in ids]))
        state = _counted(rows, state, group, ids, broadcast_rows)
        first = False
        if state.where(~_all([_settled(i, gather) for i in ids])).isEmpty():
            break
    open_ = [(F.col(f"low{i}").isNull() | F.col(f"high{i}").isNull()) for i in ids]
    left = state.where(_any(open_))
    if not left.isEmpty():
        met = rows.join(broadcast_if_small(left, broadcast_rows), group)
        # At most ``gather`` rows per probability.
        listed = met.groupBy(g).agg(
            *[F.sort_array(F.collect_list(F.when(_within(i) & open_[i], F.col("v")))).alias(f"list{i}") for i in ids]
        )
        state = state.join(listed, group, "left").withColumns(
            {
                f"{name}{i}": F.coalesce(f"{name}{i}", F.get(f"list{i}", (F.col(f"{r}{i}") - F.col(f"below{i}")).cast("int")))
                for i in ids
                for name, r in (("low", "k"), ("high", "m"))
            }
        )
    quantiles = []
    for i in ids:
        # As Spark's percentile interpolates, so that a group's size decides the plan and not the last bit.
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        between = (F.col(f"m{i}") - at[i]) * low + (at[i] - F.col(f"k{i}")) * high
        quantiles.append(F.when(low == high, low).otherwise(between))
    return state.select(g, "n", F.array(*quantiles).alias("q"))


def _counted(
    rows: DataFrame, state: DataFrame, group: str, ids: range, broadcast_rows: int, given: bool = False, list_now: bool = False
) -> DataFrame:
    """The state after one scan that counts the rows below, on and between the ends of every bracket.

    Of ``given`` brackets one that does not hold its ranks is opened to all rows; of others that is an error.
    ``list_now`` lists the rows between the ends in the same scan.
    """
    v = F.col("v")
    met = rows.join(broadcast_if_small(state, broadcast_rows), group)
    figures = []
    for i in ids:
        figures.append(F.count_if(v < F.col(f"lo{i}")).alias(f"under{i}"))
        figures.append(F.count_if(v == F.col(f"lo{i}")).alias(f"on_lo{i}"))
        figures.append(F.count_if((v > F.col(f"lo{i}")) & (v < F.col(f"hi{i}"))).alias(f"inside{i}"))
        figures.append(F.count_if(v == F.col(f"hi{i}")).alias(f"on_hi{i}"))
        if list_now:
            figures.append(F.sort_array(F.collect_list(F.when(_within(i), v))).alias(f"list{i}"))
    placed = state.join(met.groupBy(column(group)).agg(*figures), group)
    found = {}
    for i in ids:
        up_to_lo = F.col(f"under{i}") + F.col(f"on_lo{i}")
        up_to_inside = up_to_lo + F.col(f"inside{i}")
        one = F.col(f"lo{i}") == F.col(f"hi{i}")
        last = F.when(one, up_to_lo).otherwise(up_to_inside + F.col(f"on_hi{i}"))
        missed = (F.col(f"k{i}") < F.col(f"under{i}")) | (F.col(f"m{i}") >= last)
        for name, r in (("low", f"k{i}"), ("high", f"m{i}")):
            rank = F.col(r)
            lost = F.lit(None).cast("double")
            if not given:
                lost = F.raise_error(F.lit("a quantile lies outside the bracket of its sketch")).cast("double")
            held = F.get(f"list{i}", (rank - up_to_lo).cast("int")) if list_now else F.lit(None).cast("double")
            outside = missed if given else (rank < F.col(f"under{i}")) | (rank >= last)
            found[f"{name}{i}"] = (
                F.when(F.col(f"{name}{i}").isNotNull(), F.col(f"{name}{i}"))
                .when(outside, lost)
                .when(rank < up_to_lo, F.col(f"lo{i}"))
                .when(rank >= up_to_inside, F.col(f"hi{i}"))
                .otherwise(held)
            )
        found[f"below{i}"], found[f"held{i}"] = up_to_lo, F.col(f"inside{i}")
        if given:
            found[f"below{i}"] = F.when(missed, F.lit(0).cast("bigint")).otherwise(up_to_lo)
            found[f"held{i}"] = F.when(missed, F.col("n")).otherwise(F.col(f"inside{i}"))
            for end in ("lo", "hi"):
                found[f"{end}{i}"] = F.when(~missed, F.col(f"{end}{i}"))
    extra = [f"{name}{i}" for i in ids for name in ("under", "on_lo", "inside", "on_hi", *(["list"] if list_now else []))]
    return settle(placed.withColumns(found).drop(*extra))


def _within(i: int) -> Column:
    """Whether v lies strictly inside bracket i; a bracket without ends holds everything."""
    v, lo, hi = F.col("v"), F.col(f"lo{i}"), F.col(f"hi{i}")
    return (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))


def _settled(i: int, gather: int) -> Column:
    """Both values of bracket i are known, or few enough rows are left in it."""
    known = F.col(f"low{i}").isNotNull() & F.col(f"high{i}").isNotNull()
    return known | (F.col(f"lo{i}").isNotNull() & (F.col(f"held{i}") <= gather))


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def box_stats(
    df: DataFrame,
    group: str,
    col: str,
    exact: bool = True,
    accuracy: int = 10_000,
    gather: int = 10_000,
    whisker: float = 1.5,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Quartiles, whisker ends and outlier counts per group."""
    rows = _fenced(df, group, col, exact, accuracy, gather, whisker, broadcast_rows)
    low, high = F.col("low"), F.col("high")
    stats = rows.groupBy(column(group), "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("v") >= low, F.col("v"))).alias("lowest"),
        F.max(F.when(F.col("v") <= high, F.col("v"))).alias("highest"),
        F.count_if((F.col("v") < low) | (F.col("v") > high)).alias("n_outliers"),
    )
    return stats.select(
        column(group),
        "n",
        "q1",
        "median",
        "q3",
        F.least("lowest", "q1").alias("whisker_low"),
        F.greatest("highest", "q3").alias("whisker_high"),
        "n_outliers",
    )


def box_outliers(
    df: DataFrame,
    group: str,
    col: str,
    exact: bool = True,
    accuracy: int = 10_000,
    gather: int = 10_000,
    whisker: float = 1.5,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The values beyond the whiskers, one row each, as ``box_stats`` counts them: (group, value)."""
    rows = _fenced(df, group, col, exact, accuracy, gather, whisker, broadcast_rows)
    outside = (F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))
    return rows.where(outside).select(column(group), F.col("v").alias("value"))


def _fenced(
    df: DataFrame, group: str, col: str, exact: bool, accuracy: int, gather: int, whisker: float, broadcast_rows: int
) -> DataFrame:
    """Known values with their group's quartiles and the fences low and high."""
    quartiles = quantiles_by(df, group, col, (0.25, 0.5, 0.75), exact, accuracy, gather, broadcast_rows)
    q1, q3 = F.col("q")[0], F.col("q")[2]
    reach = (q3 - q1) * F.lit(whisker)
    fences = settle(
        quartiles.select(
            column(group),
            q1.alias("q1"),
            F.col("q")[1].alias("median"),
            q3.alias("q3"),
            (q1 - reach).alias("low"),
            (q3 + reach).alias("high"),
        )
    )
    rows = df.select(column(group).alias(group), nan_to_null(column(col).cast("double")).alias("v"))
    return rows.where(F.col("v").isNotNull()).join(broadcast_if_small(fences, broadcast_rows), group)


def linreg(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x in one row, over rows where both are present."""
    xs = nan_to_null(column(x).cast("double"))
    ys = nan_to_null(column(y).cast("double"))
    pairs = df.select(xs.alias("x"), ys.alias("y"))
    row = pairs.agg(
        F.regr_count("y", "x").alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
        F.regr_avgx("y", "x").alias("mean_x"),
        F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"),
        F.regr_sxy("y", "x").alias("sxy"),
        F.min(F.when(F.col("y").isNotNull(), F.col("x"))).alias("min_x"),
        F.max(F.when(F.col("y").isNotNull(), F.col("x"))).alias("max_x"),
    )
    left = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    return row.withColumn("residual_sd", F.when(F.col("n") > 2, F.sqrt(left / (F.col("n") - 2))))


def linreg_band(df: DataFrame, x: str, y: str, grid: int = 100, z: float = 1.96) -> DataFrame:
    """Fitted line on an even grid of x with its confidence band ŷ ± z·s·√(1/n + (x−x̄)²/Sxx)."""
    fit = linreg(df, x, y)
    step = (F.col("max_x") - F.col("min_x")) / F.lit(float(grid - 1))
    points = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    points = points.withColumn("x", F.col("min_x") + F.col("point") * step)
    y_hat = F.col("intercept") + F.col("slope") * F.col("x")
    gap = F.col("x") - F.col("mean_x")
    half = F.lit(z) * F.col("residual_sd") * F.sqrt(
        F.lit(1.0) / F.col("n") + F.try_divide(gap * gap, F.col("sxx"))
    )
    return points.select(
        F.col("point").cast("bigint").alias("point"),
        "x",
        y_hat.alias("y_hat"),
        (y_hat - half).alias("band_low"),
        (y_hat + half).alias("band_high"),
    )
