"""Numbers of rows in an order, without a window over all of them.

Rows are dealt to ranges of the order and sorted there; numbers within a range
come with the sorting, the few counts of ranges are summed, and each row's
number is its range's start and its place.  The rows are written once between,
so that both steps see the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternrank.sources import workspace


def numbered(rows: DataFrame, *by: Column | str, name: str = "place", count: str | None = None) -> DataFrame:
    """rows with their number, from 1, in order of `by` (ties in any order, so let it be unique), and the number of all rows if `count` names a column."""
    spark = rows.sparkSession
    order = [F.col(b) if isinstance(b, str) else b for b in by]
    at = F.monotonically_increasing_id()
    held = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    held = workspace.written(held, "numbered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["_part"]: r["n"] for r in held.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()}  # a row a range
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    first = F.broadcast(spark.createDataFrame(starts, "_part long, _start long"))
    out = held.withColumn("_part", part).join(first, "_part").withColumn(name, F.col("_start") + within + 1)
    out = out.withColumn(count, F.lit(total).cast("long")) if count else out
    return out.drop("_part", "_start", "_at")
