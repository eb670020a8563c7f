"""CSV and Parquet in, typed frames out."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrid.functions import NA_TOKENS, nan_to_null, parse_ts
from tillgrid.sources.schemas import Dataset, Field


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def normalize_headers(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Headers in snake_case; ``names`` gives the ones that need another form."""
    names = names or {}
    out = []
    for header in df.columns:
        text = re.sub(r"[^0-9a-z]+", "_", header.lower().replace("%", "pct")).strip("_")
        out.append(names.get(header, text))
    if len(set(out)) < len(out):
        raise ValueError(f"headers collide after normalising: {out}")
    return df.toDF(*out)


def normalize_nulls(
    df: DataFrame, tokens: Iterable[str] = NA_TOKENS, cols: Iterable[str] | None = None
) -> DataFrame:
    """Missing-value tokens of every text column, or of ``cols``, become NULL."""
    listed = ", ".join(_sql_text(t) for t in tokens)
    wanted = set(df.columns if cols is None else cols)
    out = []
    for field in df.schema:
        name = _quoted(field.name)
        clean = bool(listed) and field.name in wanted and isinstance(field.dataType, T.StringType)
        # As SQL text the list goes to the session in one call per column, not one per token.
        out.append(f"case when {name} not in ({listed}) then {name} end as {name}" if clean else name)
    return df.selectExpr(*out)


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def read_texts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV as text columns under its own headers; only the header line is read ahead.

    Where a path holds several files, each must have the same headers in the same order; a file that
    differs fails when it is read. ``multi_line`` accepts line breaks inside quotes, at the price of
    files that cannot be split.
    """
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line, "enforceSchema": False}
    return spark.read.options(**options).csv(path)


def _typed(raw: DataFrame, header: str, field: Field, date_format: str | None) -> Column:
    col = F.col(_quoted(header))
    if isinstance(raw.schema[header].dataType, T.StringType):
        if field.dtype == "timestamp_ntz":
            return parse_ts(col, date_format, field.mode)
        if field.dtype != "string":
            parsed = col.try_cast(field.dtype)
            if field.mode == "strict":
                bad = col.isNotNull() & parsed.isNull()
                if field.dtype.startswith("decimal"):
                    # An amount with more decimals than declared must not be rounded unseen.
                    bad = bad | (parsed != col.try_cast("decimal(38,18)"))
                message = F.concat(F.lit(f"{field.name} is not {field.dtype}: "), col)
                parsed = F.when(bad, F.raise_error(message)).otherwise(parsed)
            col = parsed
    elif field.dtype.startswith("decimal") and field.mode == "strict":
        col = _strict_decimal(raw, col, raw.schema[header].dataType, field)
    else:
        col = col.cast(field.dtype)
    return nan_to_null(col) if field.dtype == "double" else col


def _strict_decimal(raw: DataFrame, col: Column, source: T.DataType, field: Field) -> Column:
    """As for text, what does not fit the declared decimals fails; what surely fits is not tested."""
    declared = T.DecimalType(*map(int, re.findall(r"\d+", field.dtype)))
    parsed = col.try_cast(field.dtype)
    if isinstance(source, T.IntegralType):
        source = T.DecimalType(20, 0)
    if isinstance(source, T.DecimalType):
        more_digits = source.precision - source.scale > declared.precision - declared.scale
        ansi = raw.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"
        if source.scale <= declared.scale and (ansi or not more_digits):
            return col.cast(field.dtype)  # too many whole digits fail in the cast
        bad = col.isNotNull() & (parsed.isNull() | (parsed != col) if source.scale > declared.scale else parsed.isNull())
    else:
        # A double with so few decimals comes back from them as it was.
        number = col.cast("double")
        bad = number.isNotNull() & ~F.isnan(number) & (parsed.isNull() | (parsed.cast("double") != number))
    message = F.concat(F.lit(f"{field.name} is not {field.dtype}: "), col.cast("string"))
    return F.when(bad, F.raise_error(message)).otherwise(parsed)


def conform(
    raw: DataFrame,
    dataset: Dataset,
    date_format: str | None = None,
    tokens: Iterable[str] = NA_TOKENS,
    bare: Iterable[str] = (),
) -> DataFrame:
    """Declared columns by header, or by name where already renamed, nulls cleaned and typed.

    Column order in the file does not matter. A missing column fails here unless optional; others
    are left out, or follow under their own headers where the dataset takes the rest. ``bare`` names
    headers known to hold no missing-value text: they stay as they are, so filters on them reach the scan.
    """
    names = raw.columns
    found = [(f, next((h for h in (f.header, f.name) if h in names), None)) for f in dataset.fields]
    missing = [f.header for f, header in found if header is None and not f.optional]
    if missing:
        raise ValueError(f"{dataset.name} lacks columns {missing}")
    held = [(f, header) for f, header in found if header is not None]
    taken = {header for _, header in held}
    rest = [c for c in names if c not in taken] if dataset.rest else []
    clean = normalize_nulls(raw, tokens, [h for h in (*taken, *rest) if h not in set(bare)])
    typed = [_typed(clean, header, f, date_format).alias(f.name) for f, header in held]
    return clean.select(*typed, *[F.col(_quoted(c)) for c in rest])


def read_table(
    spark: SparkSession,
    path: str,
    dataset: Dataset | None = None,
    fmt: str = "csv",
    date_format: str | None = None,
    tokens: Iterable[str] = NA_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """One table from a path; without a dataset all columns come back with nulls cleaned.

    Give ``tokens=()`` for a table that says null as null, such as a staged one: its text columns then
    stay bare, so filters on them reach the scan.
    """
    raw = read_texts(spark, path, multi_line) if fmt == "csv" else spark.read.format(fmt).load(path)
    if dataset is None:
        return normalize_nulls(raw, tokens)
    return conform(raw, dataset, date_format, tokens)


def read_bundle(
    spark: SparkSession,
    sources: Mapping[str, tuple[str, Dataset | None]],
    on_error: str = "raise",
    fmt: str = "csv",
    date_format: str | None = None,
    tokens: Iterable[str] = NA_TOKENS,
) -> dict[str, DataFrame]:
    """Tables that belong together: name to (path, dataset).

    ``on_error="empty"`` gives every table empty when one cannot be opened. Opening reads
    file listings and headers; bad rows still show up at the first action.
    """
    if on_error not in ("raise", "empty"):
        raise ValueError(f"unknown on_error {on_error!r}")
    try:
        return {name: read_table(spark, path, ds, fmt, date_format, tokens) for name, (path, ds) in sources.items()}
    except (PySparkException, ValueError):
        if on_error == "raise":
            raise
        none = T.StructType()
        return {
            name: spark.createDataFrame([], ds.schema() if ds else none)
            for name, (_, ds) in sources.items()
        }
