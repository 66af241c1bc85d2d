"""Pooling passages into papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternrank.functions.vectors import l2_normalize, norm


def paper_max_pool(postings: DataFrame) -> DataFrame:
    """paper_id, term, weight: the largest weight over a paper's passages."""
    return postings.groupBy("paper_id", "term").agg(F.max("weight").alias("weight"))


def mean_pool(vectors: DataFrame, key: str = "paper_id", vector: str = "vector") -> DataFrame:
    """key and the normalised mean of its vectors; a zero mean is dropped.

    Positions are summed apart, so rows aggregate before they move.
    """
    flat = vectors.select(key, F.posexplode(vector).alias("pos", "x"))
    mean = flat.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vector))
    return packed.where(norm(F.col(vector)) > 0).withColumn(vector, l2_normalize(F.col(vector)))


def last_token(states: Column, n_tokens: Column) -> Column:
    """The unit vector of the last token's state; null without tokens."""
    return l2_normalize(F.when(n_tokens > 0, F.element_at(states, F.greatest(n_tokens, F.lit(1)))))


def with_heads(paragraphs: DataFrame, heads: DataFrame) -> DataFrame:
    """What a paper's mean takes: its paragraph vectors and those of title and abstract, but no abstract that is a paragraph.

    paragraphs: paper_id, text, vector; heads: paper_id, part (title or
    abstract), text, vector (null ones are left out).
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    same = paragraphs.select("paper_id", strip(F.col("text")).alias("_t")).distinct()
    extra = heads.where(F.col("vector").isNotNull()).withColumn("_t", strip(F.col("text")))
    kept = extra.where(F.col("part") != "abstract").unionByName(extra.where(F.col("part") == "abstract").join(same, ["paper_id", "_t"], "left_anti"))
    return paragraphs.select("paper_id", "vector").unionByName(kept.select("paper_id", "vector"))
