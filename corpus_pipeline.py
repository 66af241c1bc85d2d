"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; `run` writes each stage's rows to the shared folder and reads
them again.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanternrank.llm import common, decontam, mixing, neardup, quality, sharding


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a probability of at least one half; null and empty texts are judged too."""
    net = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.classify(docs, net, score="_quality").where("_quality >= 0.5").drop("_quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies: Jaccard similarity of 0.8 or more on five words."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot in it."""
    return sharding.assign(docs)


STAGES = [("quality classifier", quality_filter), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: The classifier's and SimHash's decisions can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.scratch(spark):  # a stage's own tables go once its rows are written
            docs = common.kept(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
