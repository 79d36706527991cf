"""The training-data pipeline: stages over whole tables, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from provenir.llm.common import stored, table
from provenir.llm.jaccard import representatives
from provenir.llm.packing import packed
from provenir.llm.quality import with_quality
from provenir.llm.toxicity import with_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    return with_toxicity(docs, table(spark, sf_dir, "labels")).where("not is_toxic").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return with_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (likeness of five-word shingles 0.8 or more) the document with the smallest doc_id stays."""
    return representatives(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences: where each piece of each document stands."""
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: The classifiers and the packer cannot be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents.

    Null texts count as empty. Null and repeated ids are rows of their own throughout: the classifiers
    keep or drop rows, the near-duplicate stage keeps one row of each group, and the packer gives the
    pieces of each row that is left. Columns of ``documents`` besides ``COLUMNS`` are not carried.
    An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
