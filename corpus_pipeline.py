"""Corpus pipeline: language ID, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import langid, packing, quality, simhash
from strandloom.session import remove_folder, scratch_folder, settled, spread, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.keep(docs, langid.fit(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and the label-calibrated rules."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels"), joint=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group: five-word shingles, Jaccard similarity 0.8 or more."""
    return simhash.keep_one(docs, shingle_words=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in training windows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: SQL can express neither the learned language model nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet, read by the next, and removed after it.

    Small inputs are dealt out anew first, so which documents share windows, and sequence ids, depend on the session's
    cores; what the windows hold together does not.
    """
    folder = scratch_folder(spark, "pipeline")
    docs = spread(table(spark, sf_dir, "documents"))
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done is not None:
            remove_folder(spark, f"{folder}/{done}")
        done = name
    return settled(docs, folder)
