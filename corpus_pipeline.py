"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, token-ID output.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlode.llm import decontam, jaccard_join, mixing, quality, wavelet
from siftlode.llm.common import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules and the n-gram ratio keep; ratios are against what comes in."""
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, trusted)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8 or more."""
    return jaccard_join.deduplicate(docs, size=5, num=80, den=100)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item has leaked into."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def keep_drawn(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic have their target weights."""
    return mixing.sampled(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet shards of what is left: a row for each document as read back from them."""
    return wavelet.shards_query(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", keep_distinct),
    ("benchmark_decontamination", keep_clean),
    ("source_mixing", keep_drawn),
    ("wavelet_shards", write_tokens),
]

#: Near-duplicate components and tokenization have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
