"""Training data: splits, pairs, rows, batches and losses.

Draws are orders by MD5 of a seed and ids: the same on every cluster size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternrank.operators.numbering import numbered

SEED = 42


def draw(*cols: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


# ---- splits

def _split(ids: DataFrame, size: Column, seed: int) -> DataFrame:
    """qid and is_validation for the first `size` of n ids in drawn order."""
    ids = numbered(ids.select("qid").distinct(), draw(F.col("qid"), seed=seed), "qid", count="n")
    return ids.select("qid", (F.col("place") <= size).alias("is_validation"))


def split_80_20(ids: DataFrame, seed: int = SEED) -> DataFrame:
    """max(2, n div 5) for validation; fewer than four ids are an error."""
    few = F.when(F.col("n") < 4, F.raise_error(F.lit("a split needs four ids at least")).cast("long"))
    return _split(ids, F.coalesce(few, F.greatest(F.lit(2), F.expr("n div 5"))), seed)


def split_90_10(ids: DataFrame, seed: int = SEED, share: float = 0.9) -> DataFrame:
    """max(1, floor(0.9 n)) for training, the rest (none of one id) for validation."""
    return _split(ids, F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") * share)), seed)


def split_eligible(ids: DataFrame, seed: int = SEED, share: float = 0.1) -> DataFrame:
    """min(max(1, 0.1 n rounded half to even), n - 1) for validation."""
    return _split(ids, F.least(F.greatest(F.lit(1), F.bround(F.col("n") * share)), F.col("n") - 1), seed)


# ---- judgments

def eligible(qrels: DataFrame, positive: int = 2, negative: int = 1) -> DataFrame:
    """Queries with a positive (at least that grade) and a negative (just that grade)."""
    return qrels.groupBy("qid").agg(F.bool_or(F.col("rel") >= positive).alias("p"), F.bool_or(F.col("rel") == negative).alias("n")).where("p and n").select("qid")


def max_grade_positives(qrels: DataFrame) -> DataFrame:
    """Judgments of each query's highest positive grade."""
    top = qrels.where("rel > 0").withColumn("top", F.max("rel").over(Window.partitionBy("qid")))
    return top.where("rel = top").drop("top")


def pick_positive(qrels: DataFrame, epoch: int = 0, seed: int = SEED) -> DataFrame:
    """qid with a drawn positive (new for each epoch) and the first, that of the smallest id."""
    by = F.struct(draw(F.lit(epoch), F.col("docid"), seed=seed), F.col("docid"))
    return qrels.where("rel > 0").groupBy("qid").agg(F.min_by("docid", by).alias("drawn"), F.min("docid").alias("first"))


def _shift(key: Column, turn: int, x: Column, size: Column, seed: int) -> Column:
    """A number under size: 60 bits of an MD5, so nearly uniform."""
    return F.conv(F.substring(draw(key, F.lit(turn), x, seed=seed), 1, 15), 16, 10).cast("long") % size


def training_pairs(qrels: DataFrame, most: int = 100, seed: int = SEED) -> DataFrame:
    """qid, pos, neg: up to `most` drawn pairs of a positive and a negative of each query.

    The cells of a query's grid of p positives and n negatives are permuted by
    four turns, in which rows and columns move each other by a hash, and the
    first cells are taken: a query costs its judgments and its pairs, not p * n.
    """
    number = lambda df: df.withColumn("at", (F.row_number().over(Window.partitionBy("qid").orderBy("docid")) - 1).cast("long"))
    pos = number(qrels.where("rel >= 2").select("qid", "docid").distinct())
    neg = number(qrels.where("rel = 1").select("qid", "docid").distinct())
    size = lambda df, name: df.groupBy("qid").agg(F.count("*").alias(name))
    grid = size(pos, "p").join(size(neg, "n"), "qid")
    cells = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(most), F.col("p") * F.col("n")) - 1)).alias("cell"))
    cells = cells.withColumns({"i": F.expr("cell div n"), "j": F.col("cell") % F.col("n")})
    for turn in (1, 3):
        cells = cells.withColumn("i", (F.col("i") + _shift(F.col("qid"), turn, F.col("j"), F.col("p"), seed)) % F.col("p"))
        cells = cells.withColumn("j", (F.col("j") + _shift(F.col("qid"), turn + 1, F.col("i"), F.col("n"), seed)) % F.col("n"))
    named = lambda df, at, name: df.select("qid", F.col("at").alias(at), F.col("docid").alias(name))
    return cells.join(named(pos, "i", "pos"), ["qid", "i"]).join(named(neg, "j", "neg"), ["qid", "j"]).select("qid", "pos", "neg")


def training_rows(qrels: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, query, pos and neg: texts in the order of their ids; queries that lack one of both are left out."""
    texts = qrels.where("rel > 0").join(passages.select("docid", "text"), "docid")
    side = lambda keep: F.transform(F.array_sort(F.collect_set(F.when(keep, F.struct("docid", "text")))), lambda s: s["text"])
    rows = texts.groupBy("qid").agg(side(F.col("rel") >= 2).alias("pos"), side(F.col("rel") == 1).alias("neg"))
    return rows.where((F.size("pos") > 0) & (F.size("neg") > 0)).join(queries.select("qid", "query"), "qid").where(F.length(F.trim("query")) > 0).select("qid", "query", "pos", "neg")


def training_stats(rows: DataFrame, qrels: DataFrame, passages: DataFrame) -> DataFrame:
    """Rows, positives and negatives; judged queries that gave no row (skipped), and relevant documents without a text (missing)."""
    made = rows.agg(F.count("*").alias("rows"), F.sum(F.size("pos")).alias("positives"), F.sum(F.size("neg")).alias("negatives"))
    asked = qrels.agg(F.countDistinct("qid").alias("asked"))
    missing = missing_docs(qrels.where("rel > 0"), passages).agg(F.count("*").alias("missing"))
    return made.crossJoin(asked).crossJoin(missing).select("rows", "positives", "negatives", (F.col("asked") - F.col("rows")).alias("skipped"), "missing")  # a row each


def missing_docs(qrels: DataFrame, passages: DataFrame) -> DataFrame:
    return qrels.select("docid").distinct().join(passages.select("docid"), "docid", "left_anti")


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the first of each key in the given order left, in that order."""
    first = rows.groupBy(key).agg(F.min(order).alias(order))
    return rows.join(first, [key, order], "left_semi").dropDuplicates([key]).orderBy(order)


# ---- batches

def batches(picked: DataFrame, size: int = 8, seed: int = SEED) -> DataFrame:
    """picked (one row a query) with batch, consecutive in drawn order."""
    placed = numbered(picked, draw(F.col("qid"), seed=seed), "qid", name="_place")
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("int")).drop("_place")


def usable(batched: DataFrame, item: str = "docid", size: int = 8) -> DataFrame:
    """Batches whose documents are `size` different ones; a short last batch is none."""
    return batched.groupBy("batch").agg(F.countDistinct(item).alias("n")).where(F.col("n") == size).select("batch")


def farthest_first(vectors: np.ndarray, size: int, start: int) -> list[list[int]]:
    """Batches that grow by the row whose largest similarity to the batch is the smallest; each row once."""
    left, out = list(range(len(vectors))), []
    first = start
    while left:
        batch = [left.pop(first % len(left))]
        closest = vectors @ vectors[batch[0]]
        while len(batch) < size and left:
            k = int(np.argmin(closest[left]))
            batch.append(left.pop(k))
            closest = np.maximum(closest, vectors @ vectors[batch[-1]])
        out.append(batch)
        first = 0
    return out


def diverse_batches(queries: DataFrame, size: int = 4, seed: int = SEED, pool: int = 2_048) -> DataFrame:
    """qid, pool, batch: greedy farthest-point batches within pools of about `pool` queries, dealt by hash, so no task holds all."""
    pools = max(1, -(-queries.count() // pool))
    dealt = queries.select("qid", F.pmod(F.xxhash64("qid", F.lit(seed)), F.lit(pools)).cast("int").alias("pool"), "vector")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("qid").reset_index(drop=True)
        found = farthest_first(np.stack(pdf["vector"].to_numpy()).astype(float), size, seed)
        return pd.DataFrame([(pdf["qid"][i], pdf["pool"][i], b) for b, rows in enumerate(found) for i in rows], columns=["qid", "pool", "batch"])

    return dealt.groupBy("pool").applyInPandas(run, f"qid {queries.schema['qid'].dataType.simpleString()}, pool int, batch int")


# ---- losses



def infonce(scores: DataFrame) -> DataFrame:
    """qid and loss: log-sum-exp of all candidates minus that of the positives; queries without a positive are left out.

    scores: qid, score (over the temperature), positive.
    """
    top = scores.withColumn("top", F.max("score").over(Window.partitionBy("qid")))
    e = F.exp(F.col("score") - F.col("top"))
    sums = top.groupBy("qid").agg(F.sum(e).alias("a"), F.sum(F.when(F.col("positive"), e)).alias("p"))
    return sums.where("p is not null").select("qid", (F.log("a") - F.log("p")).alias("loss"))


def flops(postings: DataFrame, n: int) -> DataFrame:
    """Sum over terms of the squared mean weight of n items."""
    return postings.groupBy("term").agg((F.sum("weight") / F.lit(float(n))).alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("flops"))


def pairwise_logistic(pairs: DataFrame) -> DataFrame:
    """Mean of log(1 + exp(neg - pos))."""
    x = F.col("neg_score") - F.col("pos_score")
    return pairs.agg(F.avg(F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))).alias("loss"))


def epoch_loss(steps: DataFrame, by: str = "epoch") -> DataFrame:
    """Mean over batches, and the mean weighted by their queries."""
    return steps.groupBy(by).agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("weighted"), F.avg("loss").alias("plain"))


def best_epoch(history: DataFrame, by: str = "model") -> DataFrame:
    """The earliest and the latest epoch of the lowest validation loss."""
    return history.groupBy(by).agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("earliest"), F.min_by("epoch", F.struct(F.col("val_loss"), -F.col("epoch"))).alias("latest"))
