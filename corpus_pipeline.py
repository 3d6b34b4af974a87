"""A training corpus from ``documents`` in five stages; each is written as Parquet and read by the next.

Every stage function takes (spark, docs, folder) and returns the documents that stay, with the columns they
came with; the last one adds what the mix takes of each.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slatewise.llm import decontamination, exact_dedup, mixing, quality, simhash  # noqa: E402
from slatewise.llm.common import table, written  # noqa: E402


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject (operator 6)."""
    return quality.keep_good(docs, table(spark, folder, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each text (operator 8)."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of close fingerprints (operator 4)."""
    return simhash.drop_near(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark window (operator 1)."""
    return decontamination.decontaminate(docs, table(spark, folder, "benchmark"), remove="documents")


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents taken, with their copies (operator 5)."""
    return mixing.mixture(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mix),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of ``folder``."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)


# The classifier and the hashed draws have no SQL twin; tests/llm holds the stages against plain versions.
ORACLE_SQL = None
