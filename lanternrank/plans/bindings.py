"""The concepts bound to tables: papers, passages, topics, judgments and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import json

from lanternrank.functions.text import paper_id_last
from lanternrank.functions.vectors import dot
from lanternrank.operators.encoders import hashed_loader, term_weights
from lanternrank.operators.ranking import dense_top, small
from lanternrank.sources import corpus as C
from lanternrank.sources import store, workspace
from lanternrank.sources.indexes import DenseIndex, SparseIndex, build_dense, build_sparse, encode_dense, update_sparse


class Tables:
    """Text: a document is a paper, its non-blank lines are passages, line 0 the front.  Vectors: five to a paper."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        """The documents in at least as many partitions as there are cores: a small table is one file, and tokenising it is work for all."""
        docs = self.table("documents")
        cores = self.spark.sparkContext.defaultParallelism
        return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs

    def passages(self) -> DataFrame:
        lines = self.documents().select(F.col("doc_id").cast("string").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        return lines.where(F.length(F.trim("text")) > 0).select("paper_id", F.concat_ws("_", "paper_id", F.col("pos").cast("string")).alias("docid"), "pos", (F.col("pos") == 0).alias("is_front"), "text")

    def papers_with_passages(self) -> int:
        """How many papers an index of the passages holds, from the documents themselves."""
        return self.passages().select(paper_id_last(F.col("docid"))).distinct().count()

    # ---- files and indexes, made once in the shared folder

    def _made(self, name: str, table: str, make, **settings) -> str:
        signature = C.signature(C.files_of(self.spark, f"{self.dir}/{table}.parquet"), settings).first()[0]
        return workspace.made(self.spark, name, signature, lambda path: make(path, signature))

    def papers(self) -> DataFrame:
        """The documents as papers, written as JSON and read back: title is the source, abstract the language."""
        docs = self.documents().select(F.col("doc_id").cast("string").alias("paper_id"), F.col("source").alias("title"), F.col("lang").alias("abstract"), F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
        entry = F.transform("l", lambda x, i: F.struct(F.concat_ws("_", "paper_id", i.cast("string")).alias("key"), x.alias("value")))
        rows = docs.withColumn("paragraphs", F.map_from_entries(F.filter(entry, lambda e: F.length(F.trim(e["value"])) > 0)))
        return C.papers(self.spark, self._made("papers", "documents", lambda path, _: C.write_papers(rows, path)), lines=True)

    def topic_file(self) -> str:
        """The topics (a bounded set) as a JSON list in order of their ids."""

        def write(path, _):
            rows = sorted(self.topics().collect(), key=lambda r: int(r.qid))
            text = json.dumps([{"query_id": int(r.qid), "query": r.query} for r in rows])
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)

        return self._made("topics", "benchmark", write)

    def qrel_file(self) -> str:
        return self._made("qrels", "embeddings", lambda path, _: C.write_qrels(self.qrels(), path))

    def index(self) -> SparseIndex:
        path = self._made("sparse", "documents", lambda path, signature: build_sparse(self.passages(), path, signature), encoder="ln(1 + count)", format=3)
        return SparseIndex(self.spark, path)

    def passage_store(self) -> str:
        return self._made("store", "documents", lambda path, _: store.write_passages(C.passages(self.papers()), path), buckets=store.BUCKETS)

    def followed_index(self) -> SparseIndex:
        """An index that was built from an earlier state of the documents and brought up to them as they are.

        Then every seventh paper was missing, every fifth had another text, and
        for every eleventh there was one more that is gone now.  It is searched for
        paragraphs alone, so papers of pooled terms are not made.
        """
        levels = ("paragraph",)

        def make(path, signature):
            now = self.passages().select("docid", "text")
            number = F.substring_index("docid", "_", 1).cast("long")
            before = now.where(number % 7 != 0).withColumn("text", F.when(number % 5 == 0, F.concat("text", F.lit(" earlier draft"))).otherwise(F.col("text")))
            gone = now.where(number % 11 == 0).withColumn("docid", F.concat(F.lit("gone"), "docid"))
            update_sparse(before.unionByName(gone), path, signature, levels=levels)
            update_sparse(now, path, signature, whole=True)

        return SparseIndex(self.spark, self._made("followed", "documents", make, encoder="ln(1 + count)", format=3, levels=levels))

    def dense(self) -> DenseIndex:
        path = self._made("dense", "embeddings", lambda path, signature: build_dense(self.vectors(), path, signature), format=2)
        return DenseIndex(self.spark, path)

    def encoded_index(self) -> DenseIndex:
        """A dense index of the passages' texts by the stand-in encoder."""
        path = self._made("encoded", "documents", lambda path, signature: encode_dense(self.passages(), path, signature, hashed_loader()), encoder="hashed 64")
        return DenseIndex(self.spark, path)

    def _line(self, rows: DataFrame) -> DataFrame:
        """rows (vec_id) with text: the line of the vector's document at its place among the document's vectors, all of it if that line is blank."""
        docs = self.documents().select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
        line = F.get(F.split("_text", "\n"), (F.col("vec_id") % 5).cast("int"))
        text = F.when(F.length(F.trim(line)) > 0, line).otherwise(F.col("_text"))
        found = rows.withColumn("_doc", F.expr("vec_id div 5")).join(docs, "_doc", "left")
        return found.withColumn("text", F.coalesce(text, F.concat(F.lit("vector "), F.col("vec_id").cast("string")))).drop("_doc", "_text")

    def text_index(self) -> SparseIndex:
        """A sparse index of the vectors' texts, so that both kinds of systems answer the same topics."""
        path = self._made("texts", "embeddings", lambda path, signature: build_sparse(self.dense_texts(), path, signature), documents=C.signature(C.files_of(self.spark, f"{self.dir}/documents.parquet"), {}).first()[0], format=3)
        return SparseIndex(self.spark, path)

    def paper_qrels(self) -> DataFrame:
        """A paper's grade is the best of its passages."""
        return self.qrels().groupBy("qid", F.substring_index("docid", "_", 1).alias("docid")).agg(F.max("rel").alias("rel"))

    def dense_topics(self) -> DataFrame:
        return self._line(self.queries().select("qid", F.col("qid").alias("vec_id"))).select("qid", F.col("text").alias("query"))

    def dense_texts(self) -> DataFrame:
        return self._line(self.vectors().select("docid", "vec_id")).select("docid", "text")

    def topics(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))

    def topic_terms(self) -> DataFrame:
        return term_weights(self.topics().withColumnRenamed("query", "text"), "qid")

    def vectors(self) -> DataFrame:
        """paper_id, docid, vector of the corpus."""
        e = self.table("embeddings").where("vec_id % 25 <> 0")
        paper = F.expr("vec_id div 5").cast("string")
        return e.select("vec_id", paper.alias("paper_id"), F.concat_ws("_", paper, (F.col("vec_id") % 5).cast("string")).alias("docid"), "label", F.col("embedding").alias("vector"))

    def queries(self) -> DataFrame:
        return self.table("embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("vector"))

    def qrels(self) -> DataFrame:
        """Same label: grade 2 for even ids, 1 for odd ones."""
        judged = self.vectors().select("docid", "label", F.when(F.col("vec_id") % 2 == 0, 2).otherwise(1).alias("rel"))
        return judged.join(small(self.queries().select("qid", "label")), "label").select("qid", "docid", "rel")

    def half(self, df: DataFrame) -> DataFrame:
        return df.withColumn("vector", F.slice("vector", 1, 32))

    def run_full(self, k: int | None = 100) -> DataFrame:
        return dense_top(self.queries(), self.vectors(), k)

    def run_half(self, k: int | None = 100) -> DataFrame:
        return dense_top(self.half(self.queries()), self.half(self.vectors()), k)

    def runs(self) -> DataFrame:
        cols = ("qid", "docid", "score", "rank")
        full, half = (r.select(F.lit(n).alias("run"), *cols) for n, r in (("full", self.run_full()), ("half", self.run_half())))
        return full.unionByName(half)

    def written_runs(self) -> DataFrame:
        """The runs as a written table, for what reads them more than once: each search is done once."""
        return workspace.written(self.runs(), "runs")

    def query_texts(self) -> DataFrame:
        return self.queries().select("qid", F.concat(F.lit("query "), F.col("qid").cast("string")).alias("query"))

    def vector_texts(self) -> DataFrame:
        return self.vectors().select("docid", F.concat(F.lit("passage "), F.col("docid")).alias("text"))

    def pair_scores(self, pairs: DataFrame, item: str, name: str) -> DataFrame:
        """pairs (qid, item) with the dot product of their vectors."""
        v = self.vectors().select(F.col("docid").alias(item), F.col("vector").alias("_d"))
        q = small(self.queries().select("qid", F.col("vector").alias("_q")))
        return pairs.join(v, item).join(q, "qid").withColumn(name, dot(F.col("_d"), F.col("_q"))).drop("_d", "_q")
