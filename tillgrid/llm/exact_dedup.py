"""Exact dedup by skew-safe combining: local winners, then salted digest groups, then winners over all salts.

Every stage groups by the whole normalised text beside its digest, so two texts that share a digest never
merge. A group that holds a third of all rows is one row per task before the first shuffle, at most
``salts`` rows before the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrid.llm.support import col, settle

SALTS = 16


def normalised(text: Column) -> Column:
    r"""Each run of ``[\x20\x09-\x0D]`` as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _winners(texts: DataFrame, salts: int) -> DataFrame:
    """(digest, text, keep_id, group_size) over frames of (digest, text, id)."""
    ones = texts.select(
        "digest",
        "body",
        F.col("id").alias("low"),
        F.lit(1).cast("long").alias("n"),
        (F.spark_partition_id() % F.lit(salts)).alias("salt"),
    )
    salted = ones.groupBy("digest", "body", "salt").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    return salted.groupBy("digest", "body").agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest=sha256,
) -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept``, ``digest``.

    The smallest id of a group stays. Rows without an id belong to their text's group and never win over
    one with an id. Of repeated rows with one id and one text exactly one is ``kept``. A null text equals
    the empty one. An empty table gives no rows. Other columns are ignored. Texts are compared whole, however
    long. The result joins by digest alone once every digest is known to stand for a single text; digests
    with several are joined by text as well.
    """
    body = normalised(col(text_col))
    texts = df.select(col(id_col).alias("id"), body.alias("body")).withColumn("digest", digest(F.col("body")))
    groups = settle(
        _winners(texts, salts)
        .groupBy("digest")
        .agg(
            F.min("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
            F.count(F.lit(1)).alias("texts"),
        )
    )
    rows = df.select(col(id_col).alias("id"), body.alias("body")).withColumn("digest", digest(F.col("body")))
    single = groups.where("texts = 1").drop("texts")
    joined = rows.join(single, "digest").drop("body")
    shared = groups.where("texts > 1").select("digest")
    if not shared.isEmpty():
        apart = _winners(texts.join(shared, "digest", "left_semi"), salts)
        joined = joined.unionByName(rows.join(apart, ["digest", "body"]).drop("body"))
    first = Window.partitionBy("id", "digest").orderBy("keep_id")
    winner = F.col("id").eqNullSafe(F.col("keep_id"))
    # Dealt anew, so that the join above may split a hot digest.
    spread = joined.repartition("id", "digest")
    return spread.withColumn("kept", winner & (F.row_number().over(first) == 1))


BROADCAST_ROWS = 200_000  # of (id, digest), some 100 bytes each


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The rows that stay, with the columns they came with; see ``exact_groups``.

    What goes is decided on ids and digests, and rows that stay are left where they lie: those that go are
    sent to them while they are few, and joined by shuffle beyond ``broadcast_rows``. Repeated rows with one id and one text
    are cut to one of them by an aggregate, so many of them meet in no task.
    """
    decided = exact_groups(df, id_col, text_col, salts)
    gone = settle(
        decided.where(~F.col("kept"))
        .groupBy(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest"))
        .agg(F.max(F.col("id").eqNullSafe(F.col("keep_id"))).alias("repeated"))
    )
    sizes = {r["repeated"]: r["count"] for r in gone.groupBy("repeated").count().collect()}
    if sum(sizes.values()) <= broadcast_rows:
        gone = F.broadcast(gone)  # counted above
    own, said = F.col("id"), F.col("digest")
    rows = df.select(
        col(id_col).alias("id"),
        sha256(normalised(col(text_col))).alias("digest"),
        F.struct(*[col(c) for c in df.columns]).alias("row"),
    )
    same = own.eqNullSafe(F.col("gone_id")) & (said == F.col("gone_digest"))
    stay = rows.join(gone, same, "left_anti").select("row")
    if sizes.get(True):
        again = rows.join(gone.where("repeated"), same, "left_semi")
        stay = stay.union(again.groupBy("id", "digest").agg(F.first("row").alias("row")).select("row"))
    return stay.select("row.*")
