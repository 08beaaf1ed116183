"""A corpus pipeline of four stages: quality, language, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last return the columns
of the documents they got. No stage can be written in SQL (hashed features, rank-order
profiles, fingerprints, tokenizers), so there is no SQL text; tests compare the stages
with plain Python.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairlab.llm.common import read_table, store
from pairlab.llm.importance import keep_sampled
from pairlab.llm.langid import keep_identified
from pairlab.llm.packing import pack_documents
from pairlab.llm.simhash import keep_first_of_groups

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return keep_sampled(docs, read_table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a rank-order profile tells."""
    return keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates."""
    return keep_first_of_groups(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end=1)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
