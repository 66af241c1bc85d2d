"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, common, ctw, decontam, mixing, pii, quality, sharding, simhash, tiff, turns, urlfilter, warc


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains."""
    return decontam.contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest document that links of 3 bits reach; null and empty texts have fingerprint zero."""
    return simhash.classes(common.table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record reads back from the archives: sizes, digest, response or revisit; a null html is an empty payload."""
    return warc.round_trip(common.table(spark, sf_dir, "pages"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's size and target and the words that the mix takes of it; a null source is the last, a null text has size 0."""
    return mixing.plan(common.table(spark, sf_dir, "documents"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one of 40 shards of nearly equal bytes and its slot there; null texts have 16 bytes."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.assign(docs, shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as it reads back from the pages of its TIFF file, page by page; a null text is a payload of spaces."""
    return tiff.digests(tiff.stored(common.table(spark, sf_dir, "documents")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with host, path, the longest rule that fits, its template and its verdict; null urls have neither host nor path and are allowed."""
    return urlfilter.judge(common.table(spark, sf_dir, "pages"))


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its tokens, base score and log10 probability under the trees; a null text has only its end."""
    return ctw.score(common.table(spark, sf_dir, "documents"), stable=True)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base spans, counted and hashed, and all spans; null texts have none."""
    return pii.report(common.table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probability of label 1; empty texts are scored like any other."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.train(docs, common.table(spark, sf_dir, "labels"))
    scored = quality.classify(docs, net)
    return scored.select("doc_id", (common.doc_hash_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with the faults of its damaged rows, the cheapest edits that repair it and the repaired text's digest."""
    return turns.judged(common.table(spark, sf_dir, "conversations"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that holds the template's marks, rebuilt from a log of events, formatted and read back."""
    rows = chat.tried(common.table(spark, sf_dir, "conversations"))
    return chat.digests(chat.rendered(chat.folded(chat.log(chat.numbered(rows)))))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose components are all numbers with its code, its error and that of its label, and the codebooks' digest."""
    coded, books = codes.compressed(common.table(spark, sf_dir, "embeddings"))
    return codes.with_label_error(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_simhash, op3_warc, op4_mix, op5_shard, op6_tiff, op7_url_filter, op8_context_tree, op9_pii, op10_quality, op11_turns, op12_chat, op13_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontam.SQL, "op3_warc": warc.SQL, "op4_mix": mixing.SQL, "op5_shard": sharding.SQL, "op7_url_filter": urlfilter.SQL, "op12_chat": chat.SQL, "op13_codes": codes.SQL}
