"""Text to dates and numbers, and regular-expression rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


ISO_DAY = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])\z"


def _must(parsed: Column, source: Column, what: str) -> Column:
    # raise_error keeps strict mode strict even where ANSI mode is switched off.
    failed = source.isNotNull() & parsed.isNull()
    message = F.concat(F.lit(f"not a {what}: "), source.cast("string"))
    return F.when(failed, F.raise_error(message)).otherwise(parsed)


def parse_ts(col: Column, fmt: str | None = None, mode: str = "lenient") -> Column:
    """Text to timestamp. ``lenient`` gives NULL for a bad value, ``strict`` fails the query.

    Without ``fmt`` any ISO form is read. The ISO day has a path of its own: the parsers throw
    and catch an exception for every bad row, and a look at the text first spares nearly all.
    """
    if mode not in ("lenient", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    if fmt is None:
        parsed = col.try_cast("timestamp_ntz")
    elif fmt == "yyyy-MM-dd":
        parsed = F.when(col.rlike(ISO_DAY), col.try_cast("timestamp_ntz"))
    else:
        parsed = F.try_to_timestamp(col, F.lit(fmt)).cast("timestamp_ntz")
    return parsed if mode == "lenient" else _must(parsed, col, "timestamp")


def year_of(col: Column) -> Column:
    return F.year(col)


def to_number(col: Column, mode: str = "lenient") -> Column:
    """Text to double; surrounding blanks are allowed, thousands separators are not."""
    if mode not in ("lenient", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    parsed = col.try_cast("double")
    return parsed if mode == "lenient" else _must(parsed, col, "number")


def regex_rewrite(col: Column, pattern: str, template: str) -> Column:
    """Put the first capture of ``pattern`` into ``template`` at ``{}``; no match keeps the input."""
    before, after = template.split("{}")
    found = F.regexp_extract(col, pattern, 1)
    return F.when(found != "", F.concat(F.lit(before), found, F.lit(after))).otherwise(col)


def sheet_csv_url(col: Column) -> Column:
    """Shared-sheet link to its CSV export link."""
    # The document-id pattern and the export address.
    pattern = r"/d/([a-zA-Z0-9_-]+)"
    template = "https://docs.google.com/spreadsheets/d/{}/export?format=csv"
    return regex_rewrite(col, pattern, template)
