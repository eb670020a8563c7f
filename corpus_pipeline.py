"""The corpus pipeline: language, exact copies, near copies, mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of ``documents``; what they decide is which rows go on, and how often: the mix repeats documents of
sources that weigh more than their size.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrid.llm import exact_dedup as exact
from tillgrid.llm import language_id as language
from tillgrid.llm import near_dedup as near
from tillgrid.llm.mixing import mix
from tillgrid.llm.packing import pack
from tillgrid.llm.registry import ship, table
from tillgrid.llm.support import settle

LEAST_SCORE = 0.5
MIX_POWER = 0.8
TOKENIZER = "byte_bpe_50k.json"

ORACLE_SQL = None  # learned weights, tokens and packing are beyond SQL


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a score of at least one half.

    The model learns from the labelled documents of the input. Without any it rejects nothing but texts
    without a letter.
    """
    ship(spark)
    model = language.fit(docs, "text", "lang", "doc_id")
    found = language.identify(docs, model, keep=[F.struct(*docs.columns).alias("row")])
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    if not model.languages:
        known = F.col("row.text").rlike(r"\p{L}")
    return found.where(known).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    ship(spark)
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles."""
    ship(spark)
    return near.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and as often as the weight of its source asks for."""
    ship(spark)
    return mix(docs, power=MIX_POWER).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    ship(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else settle(docs), sf_dir)
    return docs
