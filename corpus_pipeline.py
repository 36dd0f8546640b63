"""From raw documents to training ids: five stages, each written and read again.

Every stage takes null values in any column, empty and very long texts, repeated rows, ties,
further columns and an empty table; what they give is said at the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracesieve.llm import mixing, pieces, private, quality, simhash
from tracesieve.llm.common import table
from tracesieve.session import checkpoint_dir


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the stage's own documents.

    A text without words is judged as such; rows with equal texts share one fate.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, and rows without an id.

    Documents without words are one group.
    """
    return simhash.one_of_each(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; null texts stay null."""
    return private.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target of their source; documents without words are taken no times."""
    return mixing.repeated_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix; a text without pieces gives an empty list."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("private", mask_private),
    ("mixing", mix),
    ("pieces", encode),
]
#: Trained models, merge rules and iterations are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
