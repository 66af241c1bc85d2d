"""Incremental, resumable indexing: paper files go into the index that `SparseIndex` searches.

`build` consumes new files in intervals (Structured Streaming); each micro-batch
is one update of the index.  A batch that is run again after a failure finds its
papers' prints there and leaves no doubled rows.  Streams don't see files that
were changed or deleted, so `refresh` compares the content of all papers with
the index.  Settings are part of the signature, and a resume with others is
refused.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternrank.operators.encoders import SparseEncoder, term_weights
from lanternrank.sources import workspace
from lanternrank.sources.corpus import PAPER, papers, passages
from lanternrank.sources.indexes import SparseIndex, _versions, update_sparse

SEGMENTS = "segment string, items long, postings long, papers long"


def _signed(signature: str, interval: int) -> str:
    if interval < 1:
        raise ValueError("an interval has a file at least")
    return json.dumps({"signature": signature, "interval": interval}, sort_keys=True)


def _texts(rows: DataFrame) -> DataFrame:
    return passages(rows, front=True).select("docid", F.coalesce("text", F.lit("")).alias("text"))


def open_index(spark: SparkSession, folder: str, signature: str, interval: int = 100) -> SparseIndex:
    """The index as the last whole update left it; one of other settings is an error."""
    return SparseIndex(spark, folder, _signed(signature, interval))


def build(spark: SparkSession, source: str, folder: str, signature: str, interval: int = 100, encoder: SparseEncoder = term_weights) -> SparseIndex | None:
    """Indexes the files that are new under `source`; nothing if there were none yet."""
    signed = _signed(signature, interval)
    if _versions(spark, folder):
        SparseIndex(spark, folder, signed)  # refuses other settings before any file is consumed

    def index(batch: DataFrame, _: int) -> None:
        # cut from the stream's files, as an update reads its rows twice
        path = workspace.new_path(spark, "batch")
        _texts(batch.where("paper_id is not null and paragraphs is not null")).write.parquet(path)
        try:
            update_sparse(spark.read.schema("docid string, text string").parquet(path), folder, signed, encoder)
        finally:
            workspace.delete(spark, path)

    rows = spark.readStream.schema(PAPER).option("multiLine", True).option("maxFilesPerTrigger", interval).option("pathGlobFilter", "*.json").json(source)
    rows.writeStream.foreachBatch(index).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return SparseIndex(spark, folder, signed) if _versions(spark, folder) else None


def refresh(spark: SparkSession, source: str, folder: str, signature: str, interval: int = 100, encoder: SparseEncoder = term_weights) -> SparseIndex:
    """Brings the index up to the files as they are: new and changed papers are indexed, papers without a file deleted."""
    return update_sparse(_texts(papers(spark, source)), folder, _signed(signature, interval), encoder, whole=True)


def manifest(index: SparseIndex) -> DataFrame:
    """A row a live segment: items and postings at paragraph level, and papers, dead ones included."""
    rows = [(s, *index.held[s, "paragraph"], index.papers_of[s]) for s in index.segments]
    return index.spark.createDataFrame(rows, SEGMENTS)


def complete(index: SparseIndex, files: int) -> bool:
    return index.papers() == files
