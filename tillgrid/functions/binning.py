"""Bins: declared edges with labels, and fixed-width bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut_ordinal(
    col: Column,
    edges: Sequence[float],
    right: bool = True,
    include_lowest: bool = False,
    open_top: bool = False,
) -> Column:
    """0-based bin number over ``edges``; NULL outside all bins.

    Bins are (lo, hi] when ``right``, else [lo, hi). ``include_lowest`` closes the first
    bin on both sides; ``open_top`` lets the last bin take everything above.
    """
    chain = None
    last = len(edges) - 2
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        if right:
            inside = (col > F.lit(lo)) if not (include_lowest and i == 0) else (col >= F.lit(lo))
            if not (open_top and i == last):
                inside = inside & (col <= F.lit(hi))
        else:
            inside = col >= F.lit(lo)
            if not (open_top and i == last):
                inside = inside & (col < F.lit(hi))
        chain = F.when(inside, F.lit(i)) if chain is None else chain.when(inside, F.lit(i))
    return chain


def cut_label(ordinal: Column, labels: Sequence[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), ordinal + 1)


def cut_width(col: Column, width: float, origin: float = 0.0) -> Column:
    """Number of the [lo, hi) band of this width; NULL below ``origin``.

    A floor needs no maximum, so no pass over the data is spent on finding the edges.
    """
    band = F.floor((col - F.lit(float(origin))) / F.lit(float(width))).cast("bigint")
    return F.when(col >= F.lit(float(origin)), band)


def band_low(band: Column, width: float, origin: float = 0.0) -> Column:
    return band * F.lit(float(width)) + F.lit(float(origin))


def band_high(band: Column, width: float, origin: float = 0.0) -> Column:
    return (band + 1) * F.lit(float(width)) + F.lit(float(origin))


def band_label(band: Column, width: float, origin: float = 0.0) -> Column:
    """Band as ``lo-hi`` with both edges cut to whole numbers."""
    lo = band_low(band, width, origin).cast("bigint").cast("string")
    hi = band_high(band, width, origin).cast("bigint").cast("string")
    return F.when(band.isNotNull(), F.concat(lo, F.lit("-"), hi))
