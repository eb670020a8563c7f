"""Panels of one frame from one scan.

A report asks a scope for its panels. A plain ``Scope`` lets every panel read the frame for itself. A
``SharedScan`` notes the keys and figures of all grouped panels that are asked for, counts them in a single pass with one
grouping set for each combination of keys, settles the result, which has one row per group, and serves the panels from it.
Panels that are not grouped, or whose groups could be as many as the rows, read the frame as before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid import operators as op
from tillgrid.operators import aggregates, statistics
from tillgrid.operators.support import column, name_list, settle, with_keys

Maker = Callable[[], DataFrame]


def then(maker: Maker, operator: Callable[..., DataFrame], *args, **options) -> Maker:
    """The panel after a further operator."""
    return lambda: operator(maker(), *args, **options)


class Scope:
    """A frame whose panels are asked for one by one."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def ask(self, operator: Callable[..., DataFrame], *args, **options) -> Maker:
        return lambda: operator(self.df, *args, **options)


class SharedScan(Scope):
    """A frame that is read once for all grouped panels asked for before the first of them is shown."""

    def __init__(self, df: DataFrame) -> None:
        super().__init__(df)
        self._sets: list[frozenset[str]] = []
        self._keys: list[str] = []
        self._figures: dict[str, tuple[str, Column]] = {}
        self._cells: DataFrame | None = None

    def ask(self, operator: Callable[..., DataFrame], *args, **options) -> Maker:
        served = _SERVED.get(operator)
        maker = served(self, *args, **options) if served else None
        return maker or super().ask(operator, *args, **options)

    def groups(self, keys: Iterable[str], figures: Mapping[str, Column]) -> Maker:
        """One row for each combination of the keys, nulls included, with the figures."""
        if self._cells is not None:
            raise ValueError("the scan has run; ask for all panels before one is shown")
        keys = list(keys)
        if frozenset(keys) not in self._sets:
            self._sets.append(frozenset(keys))
        self._keys += [k for k in keys if k not in self._keys]
        places = {}
        for name, figure in figures.items():
            places[name] = self._figures.setdefault(str(figure), (f"figure {len(self._figures)}", figure))[0]

        def rows() -> DataFrame:
            # The bit of a key is set where it is rolled up, the first key's the highest.
            bits = [int(k not in keys) for k in self._keys]
            own = reduce(lambda number, bit: 2 * number + bit, bits, 0)
            shown = [column(place).alias(name) for name, place in places.items()]
            return self.settled().where(F.col("grouping set") == own).select(*map(column, keys), *shown)

        return rows

    def settled(self) -> DataFrame:
        """The figures of all groups, computed when the first panel is shown."""
        if self._cells is None:
            figures = [figure.alias(place) for place, figure in self._figures.values()]
            keys = [column(k) for k in self._keys]
            if keys:
                sets = [[column(k) for k in self._keys if k in one] for one in self._sets]
                rows = self.df.groupingSets(sets, *keys).agg(F.grouping_id(*keys).alias("grouping set"), *figures)
            else:
                rows = self.df.agg(F.lit(0).alias("grouping set"), *figures)
            self._cells = settle(rows)
        return self._cells


def _value_counts(scan, keys, order="count", keep_null_key=False, name="n") -> Maker:
    keys = name_list(keys)
    rows = scan.groups(keys, {name: F.count(F.lit(1))})
    return lambda: aggregates.ordered_counts(with_keys(rows(), keys, keep_null_key), keys, order, name)


def _value_shares(scan, col) -> Maker:
    return then(_value_counts(scan, col, order=None), aggregates.shares_of_counts, col)


def _sum_by(scan, keys, sums, rounding=None, money=False, keep_null_key=False) -> Maker:
    keys = name_list(keys)
    rows = scan.groups(keys, aggregates.sum_figures(scan.df, sums, rounding, money))
    return lambda: with_keys(rows(), keys, keep_null_key)


def _mean_by(scan, keys, means, rounding=None, keep_null_key=False) -> Maker:
    keys = name_list(keys)
    rows = scan.groups(keys, aggregates.mean_figures(scan.df, means, rounding))
    return lambda: with_keys(rows(), keys, keep_null_key)


def _count_non_null_by(scan, key, col, name="n") -> Maker:
    rows = scan.groups([key], {name: F.count(column(col))})
    return lambda: with_keys(rows(), [key])


def _mean_ci_by(scan, keys, col, ci="normal", z=1.96, **options) -> Maker | None:
    if ci != "normal":
        return None
    keys = name_list(keys)
    rows = scan.groups(keys, statistics.interval_figures(col))
    return lambda: statistics.normal_interval(with_keys(rows(), keys), keys, z)


def _mean_pivot(scan, row, col, value, values=None) -> Maker:
    rows = _mean_by(scan, [row, col], {"mean": value})

    def wide() -> DataFrame:
        return rows().groupBy(column(row)).pivot(col, list(values) if values else None).agg(F.first("mean"))

    return wide


def _flag_matrix(scan, cols: Sequence[str], values=None) -> Maker:
    rows = {c: scan.groups([c], {"n": F.count(F.lit(1))}) for c in cols}

    def wide() -> DataFrame:
        parts = [r().select(F.lit(c).alias("flag"), column(c).cast("string").alias("value"), "n") for c, r in rows.items()]
        long = reduce(DataFrame.union, parts)
        found = aggregates.pivot_values(long, "value") if values is None else list(values)
        return long.groupBy("flag").pivot("value", found).agg(F.sum("n")).na.fill(0)

    return wide


def _imbalance_flag(scan, col, left="Male", right="Female", threshold=0.1) -> Maker:
    return then(scan.groups([], aggregates.imbalance_figures(col, left, right)), aggregates.imbalance_of, threshold)


def _kpis(scan, figures) -> Maker | None:
    # Distinct counts do not share the pass of plain figures.
    return None if any("distinct" in str(f).lower() for f in figures.values()) else scan.groups([], figures)


def _domain(scan, col, **options) -> Maker:
    return then(scan.groups([col], {"n": F.count(F.lit(1))}), op.domain, col, **options)


def _options_with_all(scan, col, **options) -> Maker:
    return then(scan.groups([col], {"n": F.count(F.lit(1))}), op.options_with_all, col, **options)


_SERVED: dict[Callable[..., DataFrame], Callable[..., Maker | None]] = {
    op.value_counts: _value_counts,
    op.value_shares: _value_shares,
    op.sum_by: _sum_by,
    op.mean_by: _mean_by,
    op.count_non_null_by: _count_non_null_by,
    op.mean_ci_by: _mean_ci_by,
    op.mean_pivot: _mean_pivot,
    op.flag_matrix: _flag_matrix,
    op.imbalance_flag: _imbalance_flag,
    op.kpis: _kpis,
    op.domain: _domain,
    op.options_with_all: _options_with_all,
}


def scope(df: DataFrame, shared: bool) -> Scope:
    return SharedScan(df) if shared else Scope(df)
