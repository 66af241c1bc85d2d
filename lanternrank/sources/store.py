"""A store of passages from which single ones are read without a scan.

Passages lie in folders by a hash of their id and are sorted by id within, so a
lookup reads the folders of its ids alone, and of these the row groups whose
bounds hold one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, ROW_GROUP = 64, 1 << 20
#: Ids up to which a lookup names them in its filter; a longer list is joined.
NAMED = 1_000


def _bucket(docid: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(docid), F.lit(buckets)).cast("int")


def write_passages(passages: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes passages (docid, text); equal ids all stay."""
    rows = passages.select("docid", "text", _bucket(F.col("docid"), buckets).alias("bucket"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "docid").write.option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(f"{path}/passages")
    passages.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")


def find(spark: SparkSession, path: str, docids: list[str]) -> DataFrame:
    """docid and text of the named passages that there are; the list is the caller's and bounded."""
    names = sorted(set(docids))
    buckets = spark.read.schema("buckets int").parquet(f"{path}/layout").first()[0]
    asked = spark.createDataFrame([(n,) for n in names], "docid string")
    wanted = sorted(r[0] for r in asked.select(_bucket(F.col("docid"), buckets)).distinct().collect())
    rows = spark.read.schema("docid string, text string, bucket int").parquet(f"{path}/passages").where(F.col("bucket").isin(wanted))
    rows = rows.where(F.col("docid").isin(names)) if len(names) <= NAMED else rows.join(F.broadcast(asked), "docid", "left_semi")
    return rows.select("docid", "text")
