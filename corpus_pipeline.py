"""A training-data pipeline: five operators of ``loomwork.llm`` one after the other over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns them with the columns of
``documents`` (the last one adds shard and slot); ``run`` writes each result as Parquet to the shared folder and reads
it again, so no stage repeats another's work and lost executors cost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import decontamination, mixing, neardup, sharding, toxicity
from loomwork.llm.shared import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the classifier learns from the labelled training folds of ``docs``.

    Rows with a null or empty text get the intercept's score; without labels nothing is dropped; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near-duplicates.

    Rows without an id all stay; different texts of one id are judged each by itself; of equal rows one stays.
    """
    return neardup.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none, rows of one id are judged by their texts."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: each document as often as it is taken whole, rounded to the nearest; a null source is one of its own."""
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, weights)


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot, equal texts side by side; columns of these names are replaced."""
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", one_of_each_class),
    ("decontamination", without_benchmark),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]

#: The classifier can't be put in SQL; test_pipeline_by_stages holds the stages against brute force on what each one was given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
