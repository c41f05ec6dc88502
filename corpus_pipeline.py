"""From raw documents to packed training sequences: five stages, each one operator of `catalograph.llm`.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last returns packed pieces. Every
stage reads what its predecessor wrote, so a lost executor costs one stage's tasks at most. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalograph.llm import decontam, near_copies, packing, quality_rules, secrets
from catalograph.llm.tables import documents, written


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host fails them beyond doubt, go."""
    return quality_rules.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their 5-word shingles, by chains too, the least doc_id stays."""
    return near_copies.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's 5-word shingles go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span becomes a mark; the document stays."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", rule_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # tokenizer ids and XXH64 fingerprints are not SQL; the tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
