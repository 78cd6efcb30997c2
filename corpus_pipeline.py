"""Documents to packed training sequences: quality, toxicity, near duplicates, packing.

Each stage works on all rows that the one before it kept.  The first three
return rows of ``documents`` as they are; the last returns a row per piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkveil.llm import near, packing, quality, toxic
from inkveil.llm.common import staged, table
from inkveil.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject, alone or by the habit of their source."""
    return quality.keep_good(docs, F.col("source"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without toxic documents; the machine learns from the labels that are not held out."""
    return toxic.keep_clean(docs, toxic.fit_on(docs, table(spark, sf_dir, "labels"), ~toxic.held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER)).drop("gap")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]
# String kernels and packing can't be put in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
