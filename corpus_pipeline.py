"""A corpus from raw documents to packed sequences.

Each stage is written as Parquet below ``spark.checkpoint.dir`` and read again,
so a stage that is lost is redone alone. All but the last return the columns of
``documents``; the last returns the pieces with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skaldic.llm import exact_dedup, langid, mixing, neardup, packing
from skaldic.llm.catalog import tokenizer_path
from skaldic.llm.workspace import Workspace, table

MIX = mixing.MixTarget(entropy=0.97, repetitions=4.0)
"""With no fixed budget the mix draws every document at least once."""


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language no label explains (mean probability below 0.3)."""
    return langid.identified_documents(docs, least_score=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; the smallest identifier of a group stays."""
    return neardup.keep_one(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix draws them."""
    return mixing.mixed_documents(docs, MIX)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None
"""Language, similarity and packing are beyond SQL; tests compare with brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
