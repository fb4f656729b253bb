"""The corpus pipeline: stages over the documents table, each one an operator.

Every stage takes (spark, docs, sf_dir) and returns rows of ``docs`` with the
columns of documents; the last one adds ``copy``, the number of the copy that a
row of the mix is. Nulls, empty texts, repeated rows and empty tables have the
results that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brinewave.llm import op1_quality_rules, op3_mixing, op5_language_id, op6_decontaminate, op7_minhash_dedup
from brinewave.llm.common import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose host isn't rejected."""
    return op1_quality_rules.apply_rules(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return op5_language_id.keep_identified(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group."""
    return op7_minhash_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no item of the benchmark has leaked."""
    return op6_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by the target weights of their sources."""
    return op3_mixing.sample_mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Trained and sketching stages are not expressible in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
