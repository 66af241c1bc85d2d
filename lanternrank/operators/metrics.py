"""Relevance metrics of ranked runs, and comparisons between runs.

runs: run, qid, docid, rank; qrels: qid, docid, rel.  Gains are linear, the
discount is log2(rank + 1), unjudged documents are not relevant, and judged
queries that a run lacks score zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternrank.functions.stats import p_value
from lanternrank.functions.text import sig3
from lanternrank.operators.ranking import small

METRICS = ("ndcg", "ndcg5", "mrr", "p5", "p10")


def judged(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """runs with rel, zero where a document isn't judged; queries without judgments go.

    Judgments outnumber ranked rows by far, so they stream past hashed runs and aren't sorted.
    """
    asked = small(qrels.select("qid").distinct())
    return runs.join(asked, "qid", "left_semi").hint("shuffle_hash").join(qrels, ["qid", "docid"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def ideal(graded: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """by, and the best possible gain of all places (all) and of the first five (five).

    Equal grades stand at places in a row, so judgments are counted by grade
    before they move, and each range of places that occurs is summed once.
    """
    counts = graded.groupBy(*by, "rel").agg(F.count("*").alias("n"))
    held = counts.withColumn("last", F.sum("n").over(Window.partitionBy(*by).orderBy(F.col("rel").desc()))).withColumn("first", F.col("last") - F.col("n") + 1)
    places = held.where(F.col("rel") != 0).select("first", "last").distinct().withColumn("place", F.explode(F.sequence("first", "last")))
    part = 1 / F.log2(F.col("place") + 1)
    sums = places.groupBy("first", "last").agg(F.sum(part).alias("all"), F.sum(F.when(F.col("place") <= 5, part).otherwise(0.0)).alias("five"))
    gain = lambda c: F.sum(F.col("rel") * F.coalesce(c, F.lit(0.0))).alias(c)
    return held.join(sums, ["first", "last"], "left").groupBy(*by).agg(gain("all"), gain("five"))


def _values(runs: DataFrame, qrels: DataFrame, wanted: dict[int, tuple[str, ...]]) -> DataFrame:
    """run, qid, metric, value, level: the metrics of each relevance level; grades under it don't count.

    Runs meet the judgments once, whatever the number of levels.
    """
    if unknown := {m for ms in wanted.values() for m in ms} - set(METRICS):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    if not any(wanted.values()):
        raise ValueError("no metrics are asked for")
    levels = F.explode(F.array(*[F.lit(level) for level, ms in wanted.items() if ms]))
    rel = F.when(F.col("rel") >= F.col("level"), F.col("rel")).otherwise(0)
    at_levels = lambda df: df.withColumn("level", levels).withColumn("rel", rel)
    gain, hit, at = F.col("rel") / F.log2(F.col("rank") + 1), F.col("rel") > 0, F.col("rank")
    sums = at_levels(judged(runs, qrels)).groupBy("level", "run", "qid").agg(
        F.sum(gain).alias("dcg"),
        F.sum(F.when(at <= 5, gain).otherwise(0.0)).alias("dcg5"),
        F.coalesce(1 / F.min(F.when(hit, at)), F.lit(0.0)).alias("mrr"),
        (F.sum(F.when(hit & (at <= 5), 1).otherwise(0)) / 5).alias("p5"),
        (F.sum(F.when(hit & (at <= 10), 1).otherwise(0)) / 10).alias("p10"),
    )
    best = ideal(at_levels(qrels), ("level", "qid"))
    every = runs.select("run").distinct().crossJoin(F.broadcast(best))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0.0)) / F.col(b)).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    wide = every.join(sums, ["level", "run", "qid"], "left").select("level", "run", "qid", ratio("dcg", "all").alias("ndcg"), ratio("dcg5", "five").alias("ndcg5"), *[zero(m).alias(m) for m in ("mrr", "p5", "p10")])
    long = wide.unpivot(["level", "run", "qid"], list(METRICS), "metric", "value")
    asked = [(F.col("level") == level) & F.col("metric").isin(*ms) for level, ms in wanted.items() if ms]
    return long.where(reduce(lambda a, b: a | b, asked)).select("run", "qid", "metric", "value", "level")


def per_query(runs: DataFrame, qrels: DataFrame, level: int = 1, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """run, qid, metric, value of each run and judged query; grades under `level` don't count."""
    return _values(runs, qrels, {level: tuple(metrics)}).drop("level")


def means(values: DataFrame) -> DataFrame:
    return values.groupBy("run", "metric").agg(F.avg("value").alias("value"))


def passes(runs: DataFrame, qrels: DataFrame, graded: tuple[str, ...] = METRICS, strict: tuple[str, ...] = ("mrr", "p5")) -> DataFrame:
    """Both relevance passes: level 1 with `graded`, level 2 with `strict`; an empty list skips its pass, two are an error."""
    return _values(runs, qrels, {1: tuple(graded), 2: tuple(strict)})


def pairs(values: DataFrame, by: tuple[str, ...] = ("metric",), order: tuple[str, ...] = ()) -> DataFrame:
    """by, run_a, run_b, qid, a, b for each two runs, the first of them first in `order`; runs that it doesn't name follow by name."""
    known = F.array(*[F.lit(n) for n in order]) if order else F.array().cast("array<string>")
    place = lambda c: F.struct(F.coalesce(F.nullif(F.array_position(known, c), F.lit(0)), F.lit(len(order) + 1)), c)
    a = values.select(*by, "qid", F.col("run").alias("run_a"), F.col("value").alias("a"))
    b = values.select(*by, "qid", F.col("run").alias("run_b"), F.col("value").alias("b"))
    return a.join(b, [*by, "qid"]).where(place(F.col("run_a")) < place(F.col("run_b")))


def compared(values: DataFrame, by: tuple[str, ...] = ("metric",), max_p: float = 0.05, digits: int = 12, order: tuple[str, ...] = ()) -> DataFrame:
    """Means, wins, ties and losses of run_a, paired t with degrees of freedom, p and the better run.

    t is null without spread or with one pair; `better` uses the unrounded p,
    and the higher mean (run_b if they are equal).
    """
    d = F.round(F.col("a") - F.col("b"), digits)
    s = pairs(values, by, order).withColumn("d", d).groupBy(*by, "run_a", "run_b").agg(
        F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.count("*").alias("n"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("sd"),
        *[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("wins", F.col("d") > 0), ("ties", F.col("d") == 0), ("losses", F.col("d") < 0))],
    )
    t = F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("mean_d") / (F.col("sd") / F.sqrt("n")))
    s = s.withColumn("t", t).withColumn("df", F.col("n") - 1).withColumn("p", p_value("t", F.col("df").cast("double")))
    better = F.when(F.col("p") < max_p, F.when(F.col("mean_a") > F.col("mean_b"), F.col("run_a")).otherwise(F.col("run_b")))
    return s.select(*by, "run_a", "run_b", "mean_a", "mean_b", "wins", "ties", "losses", "t", "df", "p", sig3(F.col("p")).alias("p_shown"), better.alias("better"))
