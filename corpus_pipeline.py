"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, packing.

Each stage takes what its predecessor kept.  ``ORACLE_SQL`` is None: classifiers, XXH64 fingerprints and
tokenizers have no SQL form; ``tests/llm`` compares the stages with brute force.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.llm import op3_pii, op4_simhash, op6_packing, op8_quality, op10_decontaminate
from ledgerscope.llm.common import read
from ledgerscope.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return op8_quality.without_rejected(docs, read(spark, sf_dir, "labels"), op8_quality.in_training)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return op4_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return op10_decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that give it away replaced."""
    return op3_pii.sanitise(docs, rule=op3_pii.PRODUCTION)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the training sequences."""
    return op6_packing.pack(docs, op6_packing.word_tokenizer())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
