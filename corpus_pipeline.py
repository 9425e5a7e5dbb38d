"""The training-data pipeline: documents that rules keep, one of each near-duplicate group, without benchmark
passages, mixed to target weights and placed on shards.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; between stages the documents are
written as Parquet in the shared folder and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import decontaminate, mixing, ngram_join, quality, sharding
from reviewlake.llm._shared import read_table, stored

#: Five words a shingle and a Jaccard similarity of at least 0.8.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and line frequencies keep, without their boilerplate lines."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group of near copies."""
    return ngram_join.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.drawn(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with slot and shard."""
    return sharding.place(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("without_benchmark", without_benchmark),
    ("mixed", mixed),
    ("sharded", sharded),
]

#: Components of near duplicates are no SQL query; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
