"""Reading with a quarantine: rows that do not conform go to a second frame with file, line and reason."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrid.functions import NA_TOKENS, parse_ts
from tillgrid.sources.readers import conform, normalize_nulls, read_texts
from tillgrid.sources.schemas import Dataset, Field


@dataclass(frozen=True)
class Quarantine:
    """``good`` is typed as ``read_table`` types it; ``rejects`` has (file, line, field, reason), a row for each fault.

    ``counts`` holds ``rows``, ``rejected`` and one number for each field after the first action on ``good``: they are
    taken in the pass that reads it. A first action that reads twice, as a global sort does, counts twice.
    """

    good: DataFrame
    rejects: DataFrame
    counts: Observation


def read_quarantined(
    spark: SparkSession,
    path: str | list[str],
    dataset: Dataset,
    date_format: str | None = None,
    tokens: Iterable[str] = NA_TOKENS,
) -> Quarantine:
    """CSV lines that fit the dataset, and those that do not.

    A line is rejected for each strict field whose text is no value of its type, an amount with too many
    decimals among them, and for having fewer or more columns than the header. Lenient fields become NULL
    and reject nothing. Every line is good or rejected, none is lost, and no line fails the read.
    """
    tokens = list(tokens)
    header = read_texts(spark, path).schema
    names = [f.name for f in header]
    corrupt, file = _free(names, "corrupt line"), _free(names, "source file")
    options = {"header": True, "quote": '"', "escape": '"', "columnNameOfCorruptRecord": corrupt, "enforceSchema": False}
    raw = spark.read.options(**options).schema(T.StructType([*header.fields, T.StructField(corrupt, T.StringType())]))
    lines = raw.csv(path).select("*", F.col("_metadata.file_path").alias(file))
    clean = normalize_nulls(lines, tokens, names)
    found = [(f, next((h for h in (f.header, f.name) if h in names), None)) for f in dataset.fields]
    missing = [f.header for f, h in found if h is None and not f.optional]
    if missing:
        raise ValueError(f"{dataset.name} lacks columns {missing}")
    faults = {f.name: (_bad(F.col(f"`{h}`"), f, date_format), f"not {f.dtype}") for f, h in found if h and f.mode == "strict"}
    faults = {name: fault for name, fault in faults.items() if fault[0] is not None}
    broken = F.col(f"`{corrupt}`").isNotNull()
    listed = [F.when(broken, _fault(None, f"not {len(names)} columns"))]
    # Of a line with the wrong number of columns no field is judged.
    listed += [F.when(~broken & bad, _fault(name, reason)) for name, (bad, reason) in faults.items()]
    reasons = F.array_compact(F.array(*listed))
    flagged = clean.withColumn(_free(names, "faults"), reasons)
    own = F.col(f"`{_free(names, 'faults')}`")
    line = F.coalesce(F.col(f"`{corrupt}`"), F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names])))
    rejects = flagged.where(F.size(own) > 0).select(
        F.col(f"`{file}`").alias("file"), line.alias("line"), F.inline(own)
    )
    counts = Observation()
    per_field = [F.count_if(~broken & bad).alias(name) for name, (bad, _) in faults.items()]
    watched = flagged.observe(
        counts, F.count(F.lit(1)).alias("rows"), F.count_if(F.size(own) > 0).alias("rejected"), *per_field
    )
    # Nothing left can fail: what a strict field would refuse is filtered out.
    lenient = replace(dataset, fields=tuple(replace(f, mode="lenient") for f in dataset.fields))
    kept = watched.where(F.size(own) == 0).select(*[F.col(f"`{n}`") for n in names])
    return Quarantine(conform(kept, lenient, date_format, tokens), rejects, counts)


def _bad(col: Column, field: Field, date_format: str | None) -> Column | None:
    """Whether known text is no value of the field's type; no column where any text is."""
    if field.dtype == "string":
        return None
    if field.dtype == "timestamp_ntz":
        return col.isNotNull() & parse_ts(col, date_format, "lenient").isNull()
    parsed = col.try_cast(field.dtype)
    bad = parsed.isNull()
    if field.dtype.startswith("decimal"):
        bad = bad | (parsed != col.try_cast("decimal(38,18)"))
    return col.isNotNull() & bad


def _fault(field: str | None, reason: str) -> Column:
    return F.struct(F.lit(field).cast("string").alias("field"), F.lit(reason).alias("reason"))


def _free(names: list[str], wanted: str) -> str:
    taken = {n.lower() for n in names}
    while wanted in taken:
        wanted += "_"
    return wanted
