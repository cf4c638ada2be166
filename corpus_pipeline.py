"""The corpus pipeline: each stage reads what its predecessor kept.

Nulls, repeated rows, empty tables and columns of any name are handled as the operators' docstrings say; a document without
an id is judged by its text where the stage reads texts, and kept where the stage finds documents by id. Every stage but
the last returns the columns of its input. A stage's own tables are removed once its output stands, and a stage's input
once the next one's does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import decontaminate, mixing, neardup, pii, quality_rules
from linkloom.plans.scratch import release, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the certified cutoffs; null and empty texts go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest id; texts without words all stay."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item; rows without an id stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data tagged and disclosing terms generalised or removed; null texts stay null."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: every row as often as its source's target asks for, numbered by ``copy``; rows without copies go."""
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("source_mixing", mix),
]
#: DuckDB has no SQL for MinHash groups, mutual information on spans or entropy balancing; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, staged(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if i:
            release(before)
    return docs
