"""Sparse and dense indexes: made of segments, changed by commits, checked when they are opened, and searched.

A sparse index has segments, each with the items of its papers (also those
without terms), blocks of passages with the bounds that let a search skip them,
the same for papers of pooled terms, and a print of each paper's content.  A
commit names the live segments and the papers in them that count no more,
because they were changed or deleted; an update compares prints, writes a
segment of what is new and the next commit, and nothing else.  What a failed
update leaves behind no commit names.  Beyond a stated number of segments or
dead papers an update merges the segments, from their blocks, without encoding.

A dense index has blocks of vectors, and of each paper the sum and the number of
its vectors, which new vectors add to.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternrank.functions import text as X
from lanternrank.functions.vectors import FLOOR, l2_normalize, norm
from lanternrank.operators import blocks as B
from lanternrank.operators import ranking as R
from lanternrank.operators.encoders import SparseEncoder, encoded, gathered, term_weights
from lanternrank.sources import workspace
from lanternrank.sources.corpus import content_print, index_bytes

LEVELS, STRATEGIES = ("paragraph", "paper"), ("maxp", "pool")
COMMIT = "segment string, level string, items long, postings long, signature string, papers long"
ITEMS, DEAD, PRINTS = "docid string, paper_id string, is_front boolean", "segment string, paper_id string", "paper_id string, print string"
#: Beyond these an update merges all segments; the dead papers of a commit are broadcast to its searches.
MOST_SEGMENTS, MOST_DEAD = 16, 100_000


# ---- sparse: writing

def _path(folder: str, what: str, segment: str, level: str | None = None) -> str:
    return f"{folder}/{what}{f'/level={level}' if level else ''}/segment={segment}"


def _vectors(postings: DataFrame) -> DataFrame:
    """PASSAGE rows of postings (docid, term, weight), which are partitioned by docid; paper and front follow from the id."""
    entries = F.array_sort(F.collect_list(F.struct("term", "weight")))
    rows = postings.groupBy("docid").agg(entries.alias("v"))
    total = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]))
    return rows.select("docid", total.alias("norm"), F.col("v.term").alias("terms"), F.col("v.weight").alias("weights"))


def _encoded(rows: DataFrame, encoder: SparseEncoder) -> DataFrame:
    """docid, norm, terms and weights of passages (docid, text), a paper's passages together where the encoder gives whole rows."""
    if vectors := getattr(encoder, "vectors", None):
        return vectors(rows.select("docid", "text", X.paper_id_last(F.col("docid")).alias("paper_id")), "docid", "paper_id")
    return _vectors(encoder(rows.select("docid", "text").repartition("docid"), "docid"))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"paper_id": X.paper_id_last(F.col("docid")), "is_front": X.is_front(F.col("docid"))})


def _opened(blocks: DataFrame) -> DataFrame:
    """The rows in blocks: PASSAGE, and segment where blocks have it."""
    more = [c for c in blocks.columns if c == "segment"]
    rows = blocks.select(*more, "bound_terms", F.inline("passages"))
    return rows.withColumn("terms", F.transform("terms", lambda i: F.get("bound_terms", i))).drop("bound_terms")


def _pool(spark: SparkSession, folder: str, name: str) -> None:
    """The paper level of a segment from its paragraphs."""
    items = spark.read.schema(ITEMS).parquet(_path(folder, "items", name, "paragraph"))
    items.select(F.col("paper_id").alias("docid"), "paper_id", F.lit(False).alias("is_front")).distinct().write.parquet(_path(folder, "items", name, "paper"))
    rows = _opened(spark.read.schema(B.SPARSE).parquet(_path(folder, "blocks", name, "paragraph")))
    pooled = gathered(rows.select(F.col("paper_id").alias("docid"), "terms", "weights"), "docid").withColumns({"paper_id": F.col("docid"), "is_front": F.lit(False)})
    B.pack_sparse(pooled).write.parquet(_path(folder, "blocks", name, "paper"))


def _segment(rows: DataFrame, prints: DataFrame, folder: str, encoder: SparseEncoder, levels: tuple[str, ...] = LEVELS) -> str:
    """Writes passages (docid, text) as a segment; texts are exchanged once, by paper, for counts, norms and blocks."""
    spark, name = rows.sparkSession, f"s{uuid.uuid4().hex}"
    prints.write.parquet(_path(folder, "prints", name))
    _named(rows.select("docid")).select("docid", "paper_id", "is_front").write.parquet(_path(folder, "items", name, "paragraph"))
    B.pack_sparse(_named(_encoded(rows, encoder))).write.parquet(_path(folder, "blocks", name, "paragraph"))
    if "paper" in levels:
        _pool(spark, folder, name)
    return name


def _counted(spark: SparkSession, folder: str, name: str, signature: str, levels: tuple[str, ...] = LEVELS) -> list[tuple]:
    """Commit rows of a segment."""
    papers = spark.read.schema(PRINTS).parquet(_path(folder, "prints", name)).count()
    out = []
    for level in levels:
        items = spark.read.schema(ITEMS).parquet(_path(folder, "items", name, level)).count()
        postings = spark.read.schema(B.SPARSE).parquet(_path(folder, "blocks", name, level)).select(F.aggregate("passages", F.lit(0), lambda s, p: s + F.size(p["terms"])).alias("n")).agg(F.sum("n")).first()[0] or 0
        out.append((name, level, items, postings, signature, papers))
    return out


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of whole commits, ascending."""
    found = [n for n in workspace.children(spark, f"{folder}/commits") if n.isdigit()]
    return sorted(int(n) for n in found if workspace.exists(spark, f"{folder}/commits/{n}/_SUCCESS"))


def _commit(spark: SparkSession, folder: str, version: int, rows: list[tuple], dead: DataFrame | None) -> None:
    """Makes a version known: its dead papers first, then its segments; a version that another writer has made is an error."""
    if dead is not None:
        dead.select("segment", "paper_id").write.mode("overwrite").parquet(f"{folder}/dead/{version}")
    spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/commits/{version}")


def build_sparse(rows: DataFrame, folder: str, signature: str, encoder: SparseEncoder = term_weights) -> SparseIndex:
    """Indexes passages (docid, text; the paper's id is the docid up to its last underscore, `_0` is its front) in a new folder."""
    return update_sparse(rows, folder, signature, encoder)


def prints_of(rows: DataFrame) -> DataFrame:
    """paper_id and a print of the content of each paper's passages (docid, text), in any order."""
    return rows.select(X.paper_id_last(F.col("docid")).alias("paper_id"), content_print(F.col("docid"), F.col("text")).alias("h")).groupBy("paper_id").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum("h").cast("string")).alias("print"))


def update_sparse(rows: DataFrame, folder: str, signature: str, encoder: SparseEncoder = term_weights, whole: bool = False, levels: tuple[str, ...] = LEVELS) -> SparseIndex:
    """Brings an index up to passages (docid, text): papers that are new or whose content is another are indexed, others left alone.

    whole: the rows are the whole corpus, so papers that they lack are deleted.
    Run again after a failure it does what is left to do, and with nothing new
    it makes no commit.  rows are read twice: give a table, not a long plan.
    levels: what a new index is made for; paragraphs are part of any, papers
    of pooled terms may be left out. Later updates keep the levels of the index.
    """
    spark = rows.sparkSession
    if "paragraph" not in levels or set(levels) - set(LEVELS):
        raise ValueError(f"levels are of {LEVELS}, paragraph among them")
    versions = _versions(spark, folder)
    if not versions:
        fresh = prints_of(rows)
        name = _segment(rows, fresh, folder, encoder, levels)
        _commit(spark, folder, 1, _counted(spark, folder, name, signature, levels), None)
        return SparseIndex(spark, folder, signature)
    index = SparseIndex(spark, folder, signature)
    told = index.prints().withColumnsRenamed({"paper_id": "old_id", "print": "old"})
    joined = prints_of(rows).join(told, F.col("paper_id") == F.col("old_id"), "full_outer" if whole else "left")
    path = workspace.new_path(spark, "changes")
    joined.where(~F.col("print").eqNullSafe(F.col("old"))).write.parquet(path)
    changes = spark.read.schema(joined.schema).parquet(path)
    try:
        stale = changes.where("old is not null").select("segment", F.col("old_id").alias("paper_id"))
        fresh = changes.where("print is not null").select("paper_id", "print")
        if changes.isEmpty():
            return index
        segments = [(s, level, *index.held[s, level], signature, index.papers_of[s]) for s in index.segments for level in index.levels]
        if not fresh.isEmpty():
            mine = rows.withColumn("paper_id", X.paper_id_last(F.col("docid"))).join(fresh.select("paper_id"), "paper_id", "left_semi")
            segments += _counted(spark, folder, _segment(mine, fresh, folder, encoder, index.levels), signature, index.levels)
        _commit(spark, folder, versions[-1] + 1, segments, index.dead().unionByName(stale))
    finally:
        workspace.delete(spark, path)
    index = SparseIndex(spark, folder, signature)
    return merge_sparse(index) if len(index.segments) > MOST_SEGMENTS or index.dead_papers > MOST_DEAD else index


def merge_sparse(index: SparseIndex) -> SparseIndex:
    """One segment of all live papers, from the blocks that there are, as the next commit."""
    spark, folder = index.spark, index.folder
    name = f"s{uuid.uuid4().hex}"
    index.prints().select("paper_id", "print").write.parquet(_path(folder, "prints", name))
    index.items("paragraph").write.parquet(_path(folder, "items", name, "paragraph"))
    B.pack_sparse(index.passages("paragraph").repartition("docid")).write.parquet(_path(folder, "blocks", name, "paragraph"))
    if "paper" in index.levels:
        _pool(spark, folder, name)
    signature = index.signature or index.told
    _commit(spark, folder, index.version + 1, _counted(spark, folder, name, signature, index.levels), None)
    return SparseIndex(spark, folder, signature)


# ---- sparse: reading

@dataclass
class SparseIndex:
    """A commit of an index, the last one unless a version is named; an index of another signature is refused."""

    spark: SparkSession
    folder: str
    signature: str | None = None
    version: int | None = None
    met: B.Met | None = field(default=None, repr=False)

    def __post_init__(self):
        versions = _versions(self.spark, self.folder)
        if not versions or (self.version is not None and self.version not in versions):
            raise ValueError(f"no such index or version: {self.folder}")
        self.version = self.version or versions[-1]
        rows = self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits/{self.version}").collect()  # a row a segment and level
        self.told = rows[0].signature
        if self.signature is not None and {r.signature for r in rows} != {self.signature}:
            raise ValueError("the index was built from other files or settings")
        self.segments = sorted({r.segment for r in rows})
        self.held = {(r.segment, r.level): (r["items"], r.postings) for r in rows}
        self.papers_of = {r.segment: r.papers for r in rows}
        self.levels = tuple(level for level in LEVELS if any((s, level) in self.held for s in self.segments))
        self.counts = {level: tuple(sum(self.held[s, level][i] for s in self.segments) for i in (0, 1)) for level in self.levels}
        self._has_dead = workspace.exists(self.spark, f"{self.folder}/dead/{self.version}")
        self.dead_papers = self.dead().count()

    def _level(self, level: str) -> str:
        if level not in LEVELS:
            raise ValueError(f"level is one of {LEVELS}")
        if level not in self.levels:
            raise ValueError(f"the index was made for {self.levels}")
        return level

    def _read(self, what: str, schema: str, level: str | None = None) -> DataFrame:
        """The rows of all live segments, with segment."""
        paths = [_path(self.folder, what, s, level) for s in self.segments]
        return self.spark.read.schema(f"{schema}, segment string").option("basePath", paths[0].rpartition("/")[0]).parquet(*paths)

    def dead(self) -> DataFrame:
        """segment and paper_id of papers that this commit doesn't count any more."""
        return self.spark.read.schema(DEAD).parquet(f"{self.folder}/dead/{self.version}") if self._has_dead else self.spark.createDataFrame([], DEAD)

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.join(R.small(self.dead()), ["segment", "paper_id"], "left_anti") if self.dead_papers else rows

    def prints(self) -> DataFrame:
        """segment, paper_id and print of every live paper."""
        return self._live(self._read("prints", PRINTS))

    def items(self, level: str) -> DataFrame:
        """docid (at paper level the paper's id), paper_id and is_front of every live item, with or without terms."""
        return self._live(self._read("items", ITEMS, self._level(level))).select("docid", "paper_id", "is_front")

    def blocks(self, level: str) -> DataFrame:
        """segment and the columns of blocks.SPARSE, dead papers included."""
        return self._read("blocks", B.SPARSE, self._level(level))

    def passages(self, level: str) -> DataFrame:
        """paper_id, docid, is_front, norm, terms and weights of every live item with terms."""
        return self._live(_opened(self.blocks(level))).drop("segment")

    def postings(self, level: str) -> DataFrame:
        """docid, term, weight, norm, paper_id and is_front."""
        flat = self.passages(level).select("docid", F.explode(F.arrays_zip("terms", "weights")).alias("x"), "norm", "paper_id", "is_front")
        return flat.select("docid", F.col("x.terms").alias("term"), F.col("x.weights").alias("weight"), "norm", "paper_id", "is_front")

    def check(self, level: str, papers: int | None = None) -> None:
        """Raises if a segment has other numbers of rows than were written, or the index not as many live papers as it should."""
        rows = lambda df, c: {r.segment: r.n for r in df.groupBy("segment").agg(c.alias("n")).collect()}  # noqa: E731  a row a segment
        items = rows(self._read("items", ITEMS, self._level(level)), F.count("*"))
        postings = rows(self.blocks(level).select("segment", F.aggregate("passages", F.lit(0), lambda s, p: s + F.size(p["terms"])).alias("p")), F.sum("p"))
        for s in self.segments:
            if (found := (items.get(s, 0), postings.get(s, 0))) != self.held[s, level]:
                raise ValueError(f"the index holds {found} items and postings in {s}, its manifest says {self.held[s, level]}")
        if papers is not None and (live := self.papers()) != papers:
            raise ValueError(f"incomplete index: {live} of {papers} papers")

    def papers(self) -> int:
        """Live papers, by the commit."""
        return sum(self.papers_of.values()) - self.dead_papers

    def size(self, level: str) -> DataFrame:
        """files and bytes of a level."""
        parts = [index_bytes(self.spark, _path(self.folder, what, s, self._level(level))) for s in self.segments for what in ("items", "blocks")]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))

    def scores(self, queries: DataFrame, level: str, body: bool = False) -> DataFrame:
        """qid, docid, paper_id, is_front and the cosine of each query (qid, term, weight) and item with a common term; body: without fronts."""
        return B.sparse_scores(self.blocks(level), queries.select("qid", "term", _unit().alias("weight")), self._gone(), body)

    def ranked(self, queries: DataFrame, level: str, body: bool = False) -> DataFrame:
        """qid, docid, score and rank of all `scores`, as R.rank gives them; pairs don't move."""
        return B.sparse_ranked(self.blocks(level), queries.select("qid", "term", _unit().alias("weight")), self._gone(), body)

    def dots(self, queries: DataFrame, level: str) -> DataFrame:
        """qid, docid and the dot product of each query (qid, term, weight) and item with a common term."""
        return B.sparse_scores(self.blocks(level), queries.select("qid", "term", "weight"), self._gone(), raw=True).select("qid", "docid", F.col("score").alias("dot"))

    def best(self, queries: DataFrame, level: str, strategy: str = "maxp", k: int = 100) -> DataFrame:
        """The k best of `scores` for each query (qid, term, weight), ranked: qid, docid (at paper level paper_id), score and rank; as in `search`, without what only fills up."""
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy is one of {STRATEGIES}")
        body = self._level(level) == "paragraph"
        item = "docid" if body else "paper_id"
        rows = self.blocks("paragraph" if body or strategy == "maxp" else "paper")
        found = B.sparse_search(rows, queries.select("qid", "term", _unit().alias("weight")), item, k, self._gone(), body, self.met)
        found = found.groupBy("qid", item).agg(F.max("score").alias("score"))  # a paper's passages may stand in several blocks
        return R.rank(found, item, k=k)

    def search(self, topics: DataFrame, queries: DataFrame, level: str, strategy: str = "maxp", k: int = 100) -> DataFrame:
        """qid, docid (at paper level paper_id), score and rank 1..k; items without a common term follow with score zero, in order of ids.

        Paragraphs are ranked without fronts.  A paper's score is that of its
        best passage (maxp) or of its pooled terms (pool).
        """
        body = self._level(level) == "paragraph"
        item = "docid" if body else "paper_id"
        items = self.items(level).where(~F.col("is_front")) if body else self.items(level)
        return R.padded(self.best(queries, level, strategy, k), topics, items, k, item)

    def _gone(self):
        """A broadcast of the dead papers by segment (MOST_DEAD and those of one update at most), or nothing."""
        if not self.dead_papers:
            return None
        held: dict[str, list[str]] = {}
        for r in self.dead().toLocalIterator():
            held.setdefault(r.segment, []).append(r.paper_id)
        return self.spark.sparkContext.broadcast({s: pa.array(v, pa.string()) for s, v in held.items()})


def _unit() -> Column:
    """A query term's weight over the query's norm."""
    return F.col("weight") / F.greatest(F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("qid"))), F.lit(FLOOR))


# ---- dense

MANIFEST = "part string, level string, items long, signature string"
STATE = "paper_id string, n long, total array<double>"


def build_dense(vectors: DataFrame, folder: str, signature: str) -> DenseIndex:
    """Indexes docid, paper_id and vector of rows whose vectors are normalised by their encoder; null and zero vectors are left out."""
    return add_dense(vectors, folder, signature)


def states(vectors: DataFrame) -> DataFrame:
    """paper_id, and the number and sum of its vectors: batches are summed before they move, and papers where they meet."""
    def folded(batches):
        for b in batches:
            if not b.num_rows:
                continue
            column = "total" if "total" in b.schema.names else "vector"
            codes = b.column("paper_id").dictionary_encode(null_encoding="encode")
            owner = codes.indices.to_numpy()
            n = b.column("n").to_numpy() if column == "total" else np.ones(b.num_rows, np.int64)
            rows = b.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            order = np.argsort(owner, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], np.diff(owner[order]) > 0)))
            sums = np.add.reduceat(rows[order], start, axis=0)
            ends = pa.array(np.arange(len(start) + 1) * rows.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(owner[order][start])), pa.array(np.add.reduceat(n[order], start)), pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], names=["paper_id", "n", "total"])

    def met(batches):
        """A paper's rows stand together: the last paper of a batch, summed, goes before the next."""
        rest = None
        for b in batches:
            if b.num_rows:
                t = next(folded(pa.Table.from_batches([rest, b] if rest is not None else [b]).combine_chunks().to_batches()))
                rest = t.slice(t.num_rows - 1)
                yield t.slice(0, t.num_rows - 1)
        if rest is not None:
            yield rest

    parts = vectors.select("paper_id", "vector").mapInArrow(folded, STATE)
    return parts.repartition("paper_id").sortWithinPartitions("paper_id").mapInArrow(met, STATE)


def add_dense(vectors: DataFrame, folder: str, signature: str) -> DenseIndex:
    """Adds new vectors: their blocks and their papers' sums become a part of the index; means follow from the sums of all parts."""
    spark, part = vectors.sparkSession, f"p{uuid.uuid4().hex}"
    if workspace.exists(spark, f"{folder}/manifest"):
        DenseIndex(spark, folder, signature)  # refuses another signature
    kept = vectors.where(F.col("vector").isNotNull()).where(norm(F.col("vector")) > 0).select("docid", "paper_id", "vector")
    B.pack_dense(kept).write.parquet(f"{folder}/blocks/part={part}")
    states(kept).write.parquet(f"{folder}/papers/part={part}")
    n = spark.read.schema(B.DENSE).parquet(f"{folder}/blocks/part={part}").agg(F.sum(F.size("passages"))).first()[0] or 0
    papers = spark.read.schema(STATE).parquet(f"{folder}/papers/part={part}").count()
    spark.createDataFrame([(part, "paragraph", n, signature), (part, "paper", papers, signature)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return DenseIndex(spark, folder, signature)


def encode_dense(passages: DataFrame, folder: str, signature: str, load, batch: int = 16) -> DenseIndex:
    """Encodes passages (docid, text) and adds them; `dropped` keeps those that got no vector, with what went wrong.

    load gives an encoder, once a task.  Texts of like length stand together,
    so a batch isn't padded to one long text.
    """
    spark = passages.sparkSession
    rows = passages.select("docid", "text").repartition("docid").sortWithinPartitions(F.length("text"))
    path = workspace.new_path(spark, "encoded")
    encoded(rows, load, batch=batch, error="error").select("docid", "vector", "error").write.parquet(path)
    held = spark.read.schema("docid string, vector array<double>, error string").parquet(path)
    try:
        wild = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        why = F.when(F.col("vector").isNull(), F.coalesce("error", F.lit("no vector"))).when(wild, "not a number").when(norm(F.col("vector")) == 0, "zero vector")
        told = held.withColumns({"reason": why, "paper_id": X.paper_id_last(F.col("docid"))})
        told.where("reason is not null").select("docid", "reason").write.mode("append").parquet(f"{folder}/dropped")
        return add_dense(told.where("reason is null"), folder, signature)
    finally:
        workspace.delete(spark, path)


@dataclass
class DenseIndex:
    spark: SparkSession
    folder: str
    signature: str | None = None
    met: B.Met | None = field(default=None, repr=False)

    def __post_init__(self):
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").collect()  # two rows a part
        if self.signature is not None and {r.signature for r in rows} != {self.signature}:
            raise ValueError("the index was built from other files or settings")
        self.parts = sorted({r.part for r in rows})
        self.counts = {level: sum(r["items"] for r in rows if r.level == level) for level in LEVELS}

    def _read(self, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{what}/part={p}" for p in self.parts])

    def blocks(self) -> DataFrame:
        return self._read("blocks", B.DENSE)

    def vectors(self) -> DataFrame:
        """docid, paper_id, vector."""
        return self.blocks().select(F.inline("passages"))

    def dropped(self) -> DataFrame:
        """docid and reason of passages that got no vector."""
        schema = "docid string, reason string"
        path = f"{self.folder}/dropped"
        return self.spark.read.schema(schema).parquet(path) if workspace.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def papers(self) -> DataFrame:
        """paper_id and the normalised mean of its vectors; a zero mean is dropped."""
        rows = self._read("papers", STATE)
        if len(self.parts) > 1:  # a paper has a row a part at most
            plus = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
            rows = rows.groupBy("paper_id").agg(F.sum("n").alias("n"), F.collect_list("total").alias("totals"))
            rows = rows.select("paper_id", "n", F.aggregate("totals", F.array().cast("array<double>"), plus).alias("total"))
        mean = rows.select("paper_id", F.transform("total", lambda x: x / F.col("n")).alias("vector"))
        return mean.where(norm(F.col("vector")) > 0).withColumn("vector", l2_normalize(F.col("vector")))

    def check(self, papers: int | None = None) -> None:
        if (found := self.vectors().count()) != self.counts["paragraph"]:
            raise ValueError(f"the index holds {found} vectors, its manifest says {self.counts['paragraph']}")
        if papers is not None and (found := self._read("papers", STATE).select("paper_id").distinct().count()) != papers:
            raise ValueError(f"incomplete index: {found} of {papers} papers")

    def search(self, queries: DataFrame, level: str, method: str = "cosine", k: int = 100, scorer=None, texts: DataFrame | None = None, topics: DataFrame | None = None) -> DataFrame:
        """qid, docid (at paper level paper_id), score and rank 1..k of queries (qid, vector).

        cosine: by dot products, papers by their best passage; mean: papers by
        the mean of their vectors; crossencoder: the k best by cosine, ranked
        anew by `scorer` on topics (qid, query) and texts (docid, text).
        """
        if level not in LEVELS:
            raise ValueError(f"level is one of {LEVELS}")
        methods = ("cosine", "crossencoder") if level == "paragraph" else ("cosine", "mean", "crossencoder")
        if method not in methods:
            raise ValueError(f"method is one of {methods}")
        if method == "crossencoder" and (scorer is None or texts is None or topics is None):
            raise ValueError("reranking needs a scorer, texts and topics")
        if method == "mean":
            return R.rank(R.dense_scores(queries, self.papers(), "paper_id", k=k), "paper_id", k=k)
        item = "docid" if level == "paragraph" else "paper_id"
        best = B.dense_search(self.blocks(), queries, item, k, self.met)
        found = R.rank(best.drop("paper_id") if item == "docid" else R.best_passage(best), item, k=k)
        return R.rerank(found, topics, texts, scorer, item, k=k) if method == "crossencoder" else found
