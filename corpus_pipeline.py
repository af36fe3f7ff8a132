"""Corpus preparation: stages over `documents`, each an operator of sieveline.llm.

Low-quality documents go, toxic documents go, one document of each near-duplicate group stays, passages
that occur again anywhere are cut out of the texts, and what is left is packed into sequences. Every stage
works on all that the one before it kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import packing, quality, suffix_dedup, toxicity, wide_simhash
from sieveline.llm._common import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: A repeated passage: strings of so many bytes repeat, and what goes has so many words at least.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 40


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(spark, docs, _labels(spark, sf_dir))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(spark, docs, _labels(spark, sf_dir))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wide_simhash.keep_one(spark, docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, docs, PASSAGE_BYTES, PASSAGE_WORDS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("packing", packing_stage),
]

#: The classifiers' decisions can't be expressed in SQL; tests hold each stage against brute force or planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next one reads it."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
