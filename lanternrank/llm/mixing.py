"""Mixing sources to target weights: DataFrame functions only.

Tokens are summed per source; targets and repetition rates follow from the
small table of sources; each document is then taken floor(rate) times plus one
copy more with a probability equal to the fraction, drawn from a hash of its id
and the seed, so that reruns agree.

Defined cases: null text has size 0; a null source is a source of its own, the
last in order; sources without words have target and rate 0, as all have in an
empty table; repeated rows share their draw; a null id draws as the empty
text; extra columns of any name pass through `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAX_REPEATS = 3
#: Source rows up to which their table is broadcast; a larger one joins by shuffle, where Spark splits hot sources.
BROADCAST_ROWS = 10_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: int = 3, most: int = MAX_REPEATS) -> DataFrame:
    """_mix_source, source_size and target of each source of a table (source, size).

    Sources weigh 1..weights by their order.  A source that its share of all
    words would repeat over `most` times stops there and the excess goes to the
    others by weight.  Ordered by most * size / weight, the stopped sources come
    first, so running sums give the final level of the others in one step.
    The table has a row a source: sums were taken before.  Its running sums are
    one task's, which sorts and spills: some hundred bytes a source.
    """
    sums = sized.groupBy(F.col("source").alias("_mix_source")).agg(F.sum("size").alias("source_size"))
    # UTF-8 bytes are in code point order, as Spark compares strings
    numbered = sums.withColumn("w", (F.row_number().over(Window.orderBy(F.col("_mix_source").asc_nulls_last())) - 1) % weights + 1)
    up = Window.orderBy(F.col("source_size") / F.col("w"), "source_size", F.col("_mix_source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    cap = F.col("source_size") * most
    level = numbered.select(
        "*",
        cap.alias("cap"),
        (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("weight_left"),
    ).withColumn("stops", F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("w"))
    first = F.row_number().over(Window.orderBy(F.col("stops").asc(), F.col("source_size") / F.col("w"), "source_size", F.col("_mix_source").asc_nulls_last()))
    ordered = level.withColumn("n", first)
    # the first source that doesn't stop fixes what each of the others gets for a unit of weight
    unit = lambda c: F.max(F.when((F.col("n") == 1) & ~F.col("stops"), F.col(c))).over(every)
    share = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("w") * unit("left") / unit("weight_left"))
    return ordered.select("_mix_source", "source_size", F.least(share, F.col("cap").cast("double")).alias("target"))


def draw(doc_id: str, seed: int) -> Column:
    """Uniform in [0, 1): 52 bits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _planned(sized: DataFrame, names: list[str], seed: int, weights: int, most: int) -> DataFrame:
    """sized, which has the first of the names (a document's words), with the others: words and target of its source, and its copies."""
    size, total, target, copies, of = names
    small = common.written(targets(sized.select("source", F.col(size).alias("size")), weights, most).toDF(of, total, target), "targets")
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    rate = F.when(F.col(total) > 0, F.least(F.col(target) / F.greatest(total, F.lit(1)), F.lit(float(most)))).otherwise(0.0)
    taken = F.floor(rate) + F.when(draw("doc_id", seed) < rate - F.floor(rate), 1).otherwise(0)
    return sized.join(small, sized["source"].eqNullSafe(small[of])).withColumn(copies, taken.cast("long"))


def plan(docs: DataFrame, seed: int = 1, weights: int = 3, most: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target (of its source) and taken (words that the mix takes) of every document."""
    sized = common.written(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sized")
    p = _planned(sized, ["size", "source_size", "target", "copies", "of"], seed, weights, most)
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 1, weights: int = 3, most: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    *names, copy = common.unused(docs, "size", "total", "target", "copies", "of", "copy")
    p = _planned(docs.withColumn(names[0], words(F.col("text"))), names, seed, weights, most).where(F.col(names[3]) > 0)
    rows = p.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[3]))))
    return rows.select(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source
), run AS (
  SELECT *, sum(s) OVER ()::BIGINT - coalesce(sum(3 * s) OVER before, 0)::BIGINT AS rest, sum(w) OVER ()::BIGINT - coalesce(sum(w) OVER before, 0)::BIGINT AS wrest
  FROM sums WINDOW before AS (ORDER BY s / w, s, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (SELECT *, 3 * s * wrest <= rest * w AS stops FROM run),
free AS (SELECT rest, wrest FROM stopped WHERE NOT stops ORDER BY s / w, s, source NULLS LAST LIMIT 1),
goals AS (
  SELECT source, s, least(CASE WHEN stops THEN (3 * s)::DOUBLE ELSE w * (SELECT rest FROM free) / (SELECT wrest FROM free) END, (3 * s)::DOUBLE) AS target FROM stopped
), rated AS (
  SELECT doc_id, size, g.s AS source_size, target, CASE WHEN g.s > 0 THEN least(target / greatest(g.s, 1), 3.0) ELSE 0.0 END AS rate,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':1'), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
