"""Exact top-k search over blocks of passages, most of which a bound lets it skip.

A sparse block holds passages that share a rare-looking term, and of each of its
terms the largest weight that a passage has, over its norm; a dense block holds
vectors near each other, their centre and radius.  No passage of a block scores
more than the query does on these bounds (dense: the triangle inequality), so a
block whose bound is under the k-th best score known is skipped.

A search has two passes.  The first takes a sample of the blocks, scores those
with the best bounds and so finds a score that k items reach; every task of the
second knows it.  Ties at that score are kept, so results are those of a search
without bounds.  Queries go in groups whose matrix is of bounded size.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import TaskContext
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from lanternrank.functions.vectors import FLOOR

PASSAGE = "paper_id string, docid string, is_front boolean, norm double, terms array<string>, weights array<double>"
#: A passage in a block has its terms as places among the block's.
SPARSE = "block long, bound_terms array<string>, bound_weights array<double>, passages array<struct<paper_id:string,docid:string,is_front:boolean,norm:double,terms:array<int>,weights:array<double>>>"
DENSE = "block long, centre array<double>, radius double, passages array<struct<docid:string,paper_id:string,vector:array<double>>>"
SPARSE_SIZE, DENSE_SIZE = 32, 64
#: Entries of a group's matrix of queries (8 bytes each), and queries of a group; vectors are short, so more go together and blocks are read less often.
MATRIX, GROUP, DENSE_GROUP = 1 << 23, 256, 1024
#: One block in so many is looked at for the first threshold, and of these one in so many is scored.
SAMPLE, SEEDS = 8, 4
#: Rankings go by nine digits, and scores differ by the order of sums: what is this little under the threshold isn't skipped.
SLACK = 2e-9
#: Blocks of a step (fewer with more than GROUP queries): their scores of a group of queries stay within some ten MB.
STEP = 64
#: Blocks of a step that hands on all its scores: some hundred thousand rows.
PAIRS_STEP = 16
#: Passages of a slab, which is ranked as one, and of a step of its scores; bits of a score in billionths that a range of scores leaves out.
SLAB, SLAB_STEP, RANGE_BITS = 8_192, 1_024, 26


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _lists(column) -> tuple[np.ndarray, pa.Array]:
    """Offsets and the flat values of a list column, whatever slice of a batch it is."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64), column.flatten()


def _floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


# ---- packing

def _runs(batches, size: int, most: int = STEP) -> Iterator[pa.RecordBatch]:
    """Batches of whole blocks, of `most` at most: what is left of one goes before the next."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([rest, b] if rest is not None else [b]).combine_chunks()
        cut = t.num_rows - t.num_rows % size
        rest = t.slice(cut).to_batches()[0] if cut < t.num_rows else None
        for at in range(0, cut, most * size):
            yield from t.slice(at, min(most * size, cut - at)).combine_chunks().to_batches()
    if rest is not None:
        yield rest


def pack_sparse(vectors: DataFrame) -> DataFrame:
    """Blocks of PASSAGE rows: a partition's rows are sorted by the least hash of a term, so that alike passages meet, and packed as they come."""
    key = F.array_min(F.transform("terms", lambda t: F.xxhash64(t)))
    out = _arrow(SPARSE)
    fields = [c.split()[0] for c in PASSAGE.split(", ")]

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for b in _runs(batches, SPARSE_SIZE):
            n = -(-b.num_rows // SPARSE_SIZE)
            offsets, terms = _lists(b.column("terms"))
            codes = terms.dictionary_encode()
            row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            weight = _floats(b.column("weights").flatten()) / np.maximum(_floats(b.column("norm")), FLOOR)[row]
            width = max(len(codes.dictionary), 1)
            keys, place = np.unique(row // SPARSE_SIZE * width + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            best = np.zeros(len(keys))
            np.maximum.at(best, place, weight)
            ends = np.searchsorted(keys // width, np.arange(n + 1))
            inner = pa.array(place - ends[row // SPARSE_SIZE], pa.int32())
            held = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner) if c == "terms" else b.column(c) for c in fields]
            cuts, ends = pa.array(np.minimum(np.arange(n + 1) * SPARSE_SIZE, b.num_rows), pa.int32()), pa.array(ends, pa.int32())
            columns = [pa.array(number + np.arange(n), pa.int64()), pa.ListArray.from_arrays(ends, codes.dictionary.take(pa.array(keys % width))), pa.ListArray.from_arrays(ends, pa.array(best)), pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(held, names=fields))]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)
            number += n

    return vectors.select(*fields, key.alias("_key")).sortWithinPartitions("_key", "docid").select(*fields).mapInArrow(run, SPARSE)


def _chain(points: np.ndarray) -> np.ndarray:
    """The points in an order in which each is followed by the nearest of those left, so that blocks across two of them stay small."""
    left, out = list(range(1, len(points))), [0]
    while left:
        gap = ((points[left] - points[out[-1]]) ** 2).sum(axis=1)
        out.append(left.pop(int(gap.argmin())))
    return points[out]


def pack_dense(vectors: DataFrame, pivots: int = 128) -> DataFrame:
    """Blocks of docid, paper_id, vector rows: a partition's rows are sorted by the nearest of a bounded sample of vectors, and packed as they come."""
    drawn = vectors.orderBy(F.xxhash64("docid"), "docid").limit(pivots).select("vector").collect()
    out = _arrow(DENSE)
    if not drawn:
        return vectors.sparkSession.createDataFrame([], DENSE)
    shared = vectors.sparkSession.sparkContext.broadcast(_chain(np.array([r.vector for r in drawn], np.float64)))
    doubles = vectors.select("docid", "paper_id", F.col("vector").cast("array<double>").alias("vector"))

    def nearest(batches):
        for b in batches:
            if b.num_rows:
                v = _floats(b.column("vector").flatten()).reshape(b.num_rows, -1)
                p = shared.value
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(((p * p).sum(axis=1) - 2 * v @ p.T).argmin(axis=1), pa.int64())], names=["docid", "paper_id", "vector", "pivot"])

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for b in _runs(batches, DENSE_SIZE):
            v = _floats(b.column("vector").flatten()).reshape(b.num_rows, -1)
            start = np.arange(0, b.num_rows, DENSE_SIZE)
            ends = np.append(start[1:], b.num_rows)
            centre = np.add.reduceat(v, start, axis=0) / (ends - start)[:, None]
            far = np.sqrt(((v - np.repeat(centre, ends - start, axis=0)) ** 2).sum(axis=1))
            passages = pa.StructArray.from_arrays([b.column(c) for c in ("docid", "paper_id", "vector")], names=["docid", "paper_id", "vector"])
            columns = [pa.array(number + np.arange(len(start)), pa.int64()), pa.array(list(centre), pa.list_(pa.float64())), pa.array(np.maximum.reduceat(far, start)), pa.ListArray.from_arrays(pa.array(np.append(start, b.num_rows), pa.int32()), passages)]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)
            number += len(start)

    clustered = doubles.mapInArrow(nearest, "docid string, paper_id string, vector array<double>, pivot long")
    return clustered.sortWithinPartitions("pivot", "paper_id", "docid").drop("pivot").mapInArrow(run, DENSE)


# ---- queries, in groups

def sparse_groups(queries: DataFrame) -> Iterator[tuple[list, pa.Array, np.ndarray]]:
    """(ids, terms, terms x queries) of queries (qid, term, weight), whose matrices are bounded; a query's vector is bounded by its text."""
    held, terms = [], set()

    def group():
        names = sorted(terms)
        at, matrix = {t: i for i, t in enumerate(names)}, np.zeros((len(names), len(held)))
        for j, r in enumerate(held):
            for x in r.v:
                matrix[at[x.term], j] = x.weight
        return [r.qid for r in held], pa.array(names, pa.string()), matrix

    for r in queries.groupBy("qid").agg(F.collect_list(F.struct("term", "weight")).alias("v")).toLocalIterator():
        more = terms | {x.term for x in r.v}
        if held and (len(held) == GROUP or len(more) * (len(held) + 1) > MATRIX):
            yield group()
            held, more = [], {x.term for x in r.v}
        held.append(r)
        terms = more
    if held:
        yield group()


def dense_groups(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, queries x dimensions) of queries (qid, vector); null vectors are left out."""
    held = []
    for r in queries.select("qid", "vector").where(F.col("vector").isNotNull()).toLocalIterator():
        if held and (len(held) == DENSE_GROUP or len(r.vector) * (len(held) + 1) > MATRIX):
            yield [x.qid for x in held], np.array([x.vector for x in held], np.float64)
            held = []
        held.append(r)
    if held:
        yield [x.qid for x in held], np.array([x.vector for x in held], np.float64)


# ---- search

def _best(scores: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each column, without -inf; ties by place."""
    keep = scores > -np.inf
    if len(many := np.flatnonzero(keep.sum(axis=0) > k)):
        held = scores[:, many]
        keep[:, many] &= held >= np.partition(held, len(held) - k, axis=0)[len(held) - k]
    for j in np.flatnonzero(keep.sum(axis=0) > k):
        keep[:, j] = False
        keep[np.lexsort((place, -scores[:, j]))[:k], j] = True
    return np.nonzero(keep)


def _folded(scores: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's best score and the row that has it (ties: smaller place), and the owners."""
    order = np.lexsort((place, owner))
    sorted_, start = scores[order], np.flatnonzero(np.concatenate(([True], np.diff(owner[order]) > 0)))
    best = np.maximum.reduceat(sorted_, start, axis=0)
    n = np.diff(np.append(start, len(order)))
    at = np.where(sorted_ == np.repeat(best, n, axis=0), np.arange(len(order))[:, None], len(order))
    first = np.minimum.reduceat(at, start, axis=0)
    return best, order[np.minimum(first, len(order) - 1)], owner[order][start]


def _places(names: pa.Array) -> np.ndarray:
    """The rank of each name among all, equal names alike (UTF-8 order, as Spark compares strings)."""
    held = names.dictionary_encode()
    known = np.array([x.encode() for x in held.dictionary.to_pylist()], dtype=object)
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(known)] = np.arange(len(known))
    return rank[held.indices.to_numpy(zero_copy_only=False)]


def _sparse_step(batch, terms: pa.Array, matrix: np.ndarray, raw: bool = False):
    """Bounds of all queries for each block, and a function that scores some queries on the passages of a block: small dense products; raw: passages' weights are not over their norm."""
    offsets, names = _lists(batch.column("bound_terms"))
    place = pa.compute.fill_null(pa.compute.index_in(names, value_set=terms), -1).to_numpy(zero_copy_only=False)
    top = _floats(batch.column("bound_weights").flatten())
    bounds, known, weights_of = np.zeros((batch.num_rows, matrix.shape[1])), [], []
    for i in range(batch.num_rows):
        p = place[offsets[i] : offsets[i + 1]]
        known.append(np.flatnonzero(p >= 0))
        weights_of.append(matrix[p[known[i]]])
        bounds[i] = top[offsets[i] : offsets[i + 1]][known[i]] @ weights_of[i]
    cuts, passages = _lists(batch.column("passages"))
    held = dict(zip((f.name for f in passages.type), passages.flatten()))
    ends, inner = _lists(held["terms"])
    inner = inner.to_numpy(zero_copy_only=False)
    weights = _floats(held["weights"].flatten())
    weights = weights if raw else weights / np.repeat(np.maximum(_floats(held["norm"]), FLOOR), np.diff(ends))

    def score(i: int, chosen: np.ndarray) -> np.ndarray:
        a, b = cuts[i], cuts[i + 1]
        lo, hi = ends[a], ends[b]
        column = np.full(offsets[i + 1] - offsets[i], -1)
        column[known[i]] = np.arange(len(known[i]))
        at = column[inner[lo:hi]]
        hit = at >= 0
        held = np.zeros((b - a, len(known[i])))
        held[np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))[hit], at[hit]] = weights[lo:hi][hit]
        return held @ (weights_of[i] if len(chosen) == matrix.shape[1] else weights_of[i][:, chosen])

    return bounds, cuts, held, score, 0.0


def _dense_step(batch, matrix: np.ndarray):
    centre = _floats(batch.column("centre").flatten()).reshape(batch.num_rows, -1)
    reach = _floats(batch.column("radius"))[:, None] * np.sqrt((matrix * matrix).sum(axis=1))
    cuts, passages = _lists(batch.column("passages"))
    held = dict(zip((f.name for f in passages.type), passages.flatten()))
    vectors = _floats(held["vector"].flatten()).reshape(len(passages), -1)
    return centre @ matrix.T + reach, cuts, held, lambda i, chosen: vectors[cuts[i] : cuts[i + 1]] @ matrix[chosen].T, -np.inf


def _scorer(step: Callable, qids: list, shared, kind, by: str, k: int, seeds: int | None, dead, fronts: bool, met) -> Callable:
    """What a task does with its blocks: the k best items of each step for every query.

    shared: matrix of queries and their thresholds; seeds: of so many blocks the
    one with the best bound is scored, whatever the threshold; by: docid, or
    paper_id for papers by their best passage; dead: papers left out, by segment;
    met: takes what was met, by query.
    """
    sums = _Sums()
    size = max(1, STEP * GROUP // max(GROUP, len(qids)))

    def run(batches):
        began, told = time.perf_counter(), {}
        args, least = shared.value
        gone = dead.value if dead is not None else {}
        cold = True
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                began = began if cold else time.perf_counter()
                b = batch.slice(at, size)
                bounds, cuts, held, score, floor = step(b, *args)
                if seeds:
                    m = -(-b.num_rows // seeds)
                    wanted = (bounds >= np.partition(bounds, b.num_rows - m, axis=0)[b.num_rows - m]) & (bounds > floor)
                else:
                    wanted = (bounds >= least - SLACK) & (bounds > floor)
                rows = np.diff(cuts)
                work = (rows[:, None] * wanted).sum(axis=0)
                sums.addInPlace(told, {"every": int(rows.sum()) * len(qids), "scored": int(work.sum())})
                work = work + len(rows)
                some = np.flatnonzero(wanted.any(axis=1))
                out = best_of(b, some, wanted, cuts, rows, held, score, floor, least, gone) if len(some) else None
                spent = (time.perf_counter() - began) * work / work.sum()
                sums.addInPlace(told, {("cold" if cold else "warm", q): x for q, x in zip(qids, spent.tolist())} | ({("warm", q): 0.0 for q in qids} if cold else {}))
                cold = False
                if out is not None:
                    yield out
        met.add(told)

    def best_of(b, some, wanted, cuts, rows, held, score, floor, least, gone):
        at_rows = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in some])
        scores = np.full((len(at_rows), len(qids)), -np.inf)
        n = 0
        for i in some:
            chosen = np.flatnonzero(wanted[i])
            scores[n : n + rows[i], chosen] = score(i, chosen)
            n += rows[i]
        scores[scores <= floor] = -np.inf
        if not seeds:
            scores[scores < least - SLACK] = -np.inf
        names = {c: held[c].take(pa.array(at_rows)) for c in ("docid", "paper_id")}
        if fronts:
            scores[held["is_front"].take(pa.array(at_rows)).to_numpy(zero_copy_only=False)] = -np.inf
        if gone:
            segment = np.repeat(b.column("segment").to_pylist(), rows)[at_rows]
            for s in set(segment) & set(gone):
                lost = pa.compute.is_in(names["paper_id"], value_set=gone[s]).to_numpy(zero_copy_only=False)
                scores[lost & (segment == s)] = -np.inf
        place, shown = _places(names["docid"]), np.round(scores, 9)
        if by == "paper_id":
            best, row, owners = _folded(shown, _places(names["paper_id"]), place)
            r, c = _best(best, owners, k)
            passage = row[r, c]
        else:
            passage, c = _best(shown, place, k)
        found = scores[passage, c]
        take = pa.array(passage)
        return pa.RecordBatch.from_arrays([pa.array([qids[x] for x in c], kind), names["paper_id"].take(take), names["docid"].take(take), pa.array(found)], names=["qid", "paper_id", "docid", "score"])

    return run


class _Sums(AccumulatorParam):
    """Sums by key."""

    def zero(self, value):
        return {}

    def addInPlace(self, a, b):
        for k, v in b.items():
            a[k] = a.get(k, 0) + v
        return a


class Met:
    """What the searches that it was given to have met: passages of all queries, those scored, and the seconds of each query.

    A step's seconds are split by what it did for each query: passages scored,
    and a bound a block.  The first step of a task, which fetches the queries and
    finds nothing in caches, counts as cold.  A task that runs twice counts twice.
    """

    def __init__(self, spark: SparkSession):
        self._held = spark.sparkContext.accumulator({}, _Sums())

    def add(self, found: dict):
        self._held.add(found)

    def __getstate__(self):
        return self._held

    def __setstate__(self, held):
        self._held = held

    @property
    def share(self) -> float:
        held = self._held.value
        return held.get("scored", 0) / held["every"] if held.get("every") else 0.0

    def seconds(self) -> dict:
        """(all seconds, those of cold steps) by query id."""
        held = self._held.value
        return {k[1]: (v + held.get(("cold", k[1]), 0.0), held.get(("cold", k[1]), 0.0)) for k, v in held.items() if k[0] == "warm"}


def _searched(blocks: DataFrame, groups, step: Callable, qid: str, by: str, k: int, dead, fronts: bool, met: Met | None) -> DataFrame:
    spark, kind = blocks.sparkSession, to_arrow_type(StructType.fromDDL(f"q {qid}")["q"].dataType)
    schema, out = f"qid {qid}, paper_id string, docid string, score double", None
    met = met or Met(spark)
    for qids, *args in groups:
        start = spark.sparkContext.broadcast((args, np.full(len(qids), -np.inf)))
        sample = blocks.where(F.col("block") % SAMPLE == 0).mapInArrow(_scorer(step, qids, start, kind, by, k, SEEDS, dead, fronts, met), schema)
        each = sample.groupBy("qid", by).agg(F.max("score").alias("score"))
        least = {r.qid: r.score for r in _kth(each, k).collect()}  # a row a query of the group
        known = np.array([least.get(q, -np.inf) for q in qids])
        shared = spark.sparkContext.broadcast((args, known))
        part = blocks.mapInArrow(_scorer(step, qids, shared, kind, by, k, None, dead, fronts, met), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """qid and the k-th best score of queries with so many."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc()))
    return scores.withColumn("place", place).where(F.col("place") == k).select("qid", "score")


def sparse_search(blocks: DataFrame, queries: DataFrame, by: str, k: int, dead=None, fronts: bool = False, met: Met | None = None) -> DataFrame:
    """qid, paper_id, docid and score: among them the k best items of each query (qid, term, weight: unit vectors) with a common term.

    blocks: segment and the columns of SPARSE; fronts: leaves front passages out;
    dead: a broadcast of the papers to leave out, by segment.
    """
    return _searched(blocks, sparse_groups(queries), _sparse_step, queries.schema["qid"].dataType.simpleString(), by, k, dead, fronts, met)


def sparse_scores(blocks: DataFrame, queries: DataFrame, dead=None, fronts: bool = False, raw: bool = False) -> DataFrame:
    """qid, docid, paper_id, is_front and score of every query (qid, term, weight) and passage with a common term (weights are over zero); nothing is exchanged.

    raw: the products of the weights as they are; the others as in `sparse_search`.
    """
    spark, qid = blocks.sparkSession, queries.schema["qid"].dataType.simpleString()
    schema, out, kind = f"qid {qid}, docid string, paper_id string, is_front boolean, score double", None, to_arrow_type(queries.schema["qid"].dataType)

    def scorer(qids: list, shared):
        def run(batches):
            ids, every = pa.array(qids, kind), np.arange(len(qids))
            for batch in batches:
                for at in range(0, batch.num_rows, PAIRS_STEP):
                    b = batch.slice(at, PAIRS_STEP)
                    _, _, held, score, _ = _sparse_step(b, *shared.value, raw)
                    scores = np.concatenate([score(i, every) for i in range(b.num_rows)])
                    if fronts:
                        scores[held["is_front"].to_numpy(zero_copy_only=False)] = 0.0
                    if dead is not None:
                        segment = np.repeat(b.column("segment").to_pylist(), np.diff(_lists(b.column("passages"))[0]))
                        for s in set(segment) & set(dead.value):
                            scores[pa.compute.is_in(held["paper_id"], value_set=dead.value[s]).to_numpy(zero_copy_only=False) & (segment == s)] = 0.0
                    r, c = np.nonzero(scores > 0)
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(c)), *(held[n].take(take) for n in ("docid", "paper_id", "is_front")), pa.array(scores[r, c])], names=["qid", "docid", "paper_id", "is_front", "score"])

        return run

    for qids, *args in sparse_groups(queries):
        part = blocks.mapInArrow(scorer(qids, spark.sparkContext.broadcast(args)), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


# ---- ranks of all pairs

def _packed(values: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, of which the upper ones are mostly zero and so compress."""
    wide = values.astype("<u4" if not len(values) or values.max() < 1 << 32 else "<u8")
    return wide.view(np.uint8).reshape(len(values), wide.itemsize).T.tobytes()


def _unpacked(b: bytes, n: int) -> np.ndarray:
    width = len(b) // max(n, 1)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64) if n else np.zeros(0, np.int64)


def _slab_scores(docids: int, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """passages x queries; products are added term by term, so that each computation of a slab gives the same bits."""
    out = np.zeros((docids, matrix.shape[1]))
    for at in range(0, docids, SLAB_STEP):
        first, n, part = ends[:-1][at : at + SLAB_STEP], np.diff(ends)[at : at + SLAB_STEP], out[at : at + SLAB_STEP]
        for j in range(n.max(initial=0)):
            rows = np.flatnonzero(n > j)
            part[rows] += weights[first[rows] + j, None] * matrix[terms[first[rows] + j]]
    return out


def _slab_parts(row: dict, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query of a slab: rows with a score, their scores, and of these in billionths (halves up) the distinct ones and each row's place among them."""
    scores = _slab_scores(row["n"], row["ends"], row["terms"], row["weights"], matrix)
    for j in range(matrix.shape[1]):
        rows = np.flatnonzero(scores[:, j] > 0)
        found = scores[rows, j]
        low = np.floor(found * 1e9)
        shown, place = np.unique((low + (found * 1e9 - low >= 0.5)).astype(np.int64), return_inverse=True)
        yield rows, found, shown, place


def _slab_rows(t) -> Iterator[dict]:
    for i in range(t.num_rows):
        held = {c: t.column(c)[i].values for c in ("docids", "lengths", "terms", "weights")}
        lengths = held["lengths"].to_numpy(zero_copy_only=False).astype(np.int64)
        yield {"slab": t.column("slab")[i].as_py(), "n": len(lengths), "docids": held["docids"], "ends": np.concatenate(([0], np.cumsum(lengths))), "terms": held["terms"].to_numpy(zero_copy_only=False), "weights": _floats(held["weights"])}


def sparse_ranked(blocks: DataFrame, queries: DataFrame, dead=None, fronts: bool = False) -> DataFrame:
    """`sparse_scores` (qid, docid, score) with the rank of each pair among the query's: by falling score to nine digits, ties by docid.

    No pair moves.  Passages are sorted by id once, with the query terms that
    they have, into slabs (a written table); of each slab and query the distinct
    scores and their numbers are merged, by ranges of scores, and the ranks at
    which they begin come back to the slab, which gives its pairs.
    """
    from lanternrank.sources import workspace

    spark, qid = blocks.sparkSession, queries.schema["qid"].dataType.simpleString()
    schema, out, kind = f"qid {qid}, docid string, score double, rank int", None, to_arrow_type(queries.schema["qid"].dataType)
    for qids, terms, matrix in sparse_groups(queries):
        known, shared = spark.sparkContext.broadcast(terms), spark.sparkContext.broadcast(matrix)
        slabs = workspace.written(_slabs(blocks, known, dead, fronts), "slabs")
        begin = slabs.mapInArrow(_distinct(shared), "slab long, q int, part int, above long, n int, shown binary, counts binary")
        begin = begin.groupBy("q", "part").applyInArrow(_begin, "slab long, q int, part int, n int, ranks binary")
        part = slabs.groupBy("slab").cogroup(begin.groupBy("slab")).applyInArrow(_pairs(qids, kind, shared), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _slabs(blocks: DataFrame, known, dead, fronts: bool) -> DataFrame:
    def met(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                b = batch.slice(at, STEP)
                offsets, names = _lists(b.column("bound_terms"))
                place = pa.compute.fill_null(pa.compute.index_in(names, value_set=known.value), -1).to_numpy(zero_copy_only=False)
                cuts, passages = _lists(b.column("passages"))
                held = dict(zip((f.name for f in passages.type), passages.flatten()))
                ends, inner = _lists(held["terms"])
                of, lengths = np.repeat(np.arange(b.num_rows), np.diff(cuts)), np.diff(ends)
                row = np.repeat(np.arange(len(lengths)), lengths)
                at_term = place[np.repeat(offsets[:-1][of], lengths) + inner.to_numpy(zero_copy_only=False)]
                weights = _floats(held["weights"].flatten()) / np.maximum(_floats(held["norm"]), FLOOR)[row]
                keep = np.ones(len(lengths), bool)
                if fronts:
                    keep &= ~held["is_front"].to_numpy(zero_copy_only=False)
                if dead is not None:
                    segment = np.array(b.column("segment").to_pylist())[of]
                    for s in set(segment) & set(dead.value):
                        keep &= ~(pa.compute.is_in(held["paper_id"], value_set=dead.value[s]).to_numpy(zero_copy_only=False) & (segment == s))
                hit = (at_term >= 0) & keep[row]
                n = np.bincount(row[hit], minlength=len(lengths))
                some = np.flatnonzero(n)
                inside = pa.array(np.concatenate(([0], np.cumsum(n[some]))), pa.int32())
                yield pa.RecordBatch.from_arrays([held["docid"].take(pa.array(some)), pa.ListArray.from_arrays(inside, pa.array(at_term[hit], pa.int32())), pa.ListArray.from_arrays(inside, pa.array(weights[hit]))], names=["docid", "terms", "weights"])

    def pack(batches):
        number = TaskContext.get().partitionId() << 33
        for b in _runs(batches, SLAB, 1):
            columns = [b.column("docid"), b.column("terms").value_lengths(), b.column("terms").flatten(), b.column("weights").flatten()]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns)], names=["slab", "docids", "lengths", "terms", "weights"])
            number += 1

    rows = blocks.mapInArrow(met, "docid string, terms array<int>, weights array<double>")
    return rows.repartitionByRange("docid").sortWithinPartitions("docid").mapInArrow(pack, "slab long, docids array<string>, lengths array<int>, terms array<int>, weights array<double>")


def _distinct(shared) -> Callable:
    """Of each slab, query and range of scores: the distinct scores as steps, how many rows have each, and how many rows are above the range."""
    def run(batches):
        for t in batches:
            for row in _slab_rows(t):
                held = []
                for q, (rows, _, shown, place) in enumerate(_slab_parts(row, shared.value)):
                    counts, ranges = np.bincount(place, minlength=len(shown)), shown >> RANGE_BITS
                    above = len(rows)
                    for p in range(int(ranges[-1]) + 1 if len(ranges) else 0):
                        a, b = np.searchsorted(ranges, [p, p + 1])
                        above -= int(counts[a:b].sum())
                        if above or b > a:
                            held.append((row["slab"], q, p, above, b - a, _packed(np.diff(shown[a:b], prepend=0)), _packed(counts[a:b])))
                columns = list(zip(*held)) if held else [[]] * 7
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["slab", "q", "part", "above", "n", "shown", "counts"])

    return run


def _begin(t: pa.Table) -> pa.Table:
    """The number of a query's rows before the first with each of a slab's scores; slabs are in order of ids."""
    n = t.column("n").to_numpy().astype(np.int64)
    shown = np.concatenate([np.cumsum(_unpacked(b, k)) for b, k in zip(t.column("shown").to_pylist(), n)])
    counts = np.concatenate([_unpacked(b, k) for b, k in zip(t.column("counts").to_pylist(), n)])
    order = np.lexsort((np.repeat(t.column("slab").to_numpy(), n), -shown))
    before = np.empty(len(order), np.int64)
    before[order] = np.cumsum(counts[order]) - counts[order] + int(t.column("above").to_numpy().sum())
    ends = np.concatenate(([0], np.cumsum(n)))
    ranks = pa.array([_packed(before[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())
    return pa.table([t.column("slab"), t.column("q"), t.column("part"), t.column("n"), ranks], names=["slab", "q", "part", "n", "ranks"]).filter(pa.array(n > 0))


def _pairs(qids: list, kind, shared) -> Callable:
    def run(slab: pa.Table, begin: pa.Table) -> pa.Table:
        held = {}
        for q, part, n, b in sorted(zip(*(begin.column(c).to_pylist() for c in ("q", "part", "n", "ranks")))):
            held.setdefault(q, []).append(_unpacked(b, n))
        ids, names, parts = pa.array(qids, kind), None, []
        for row in _slab_rows(slab.combine_chunks()):
            names = row["docids"]
            for q, (rows, found, shown, place) in enumerate(_slab_parts(row, shared.value)):
                if not len(rows):
                    continue
                first = np.concatenate(held[q])
                if len(first) != len(shown):
                    raise RuntimeError("a slab's scores have changed")
                order = np.argsort(place, kind="stable")  # rows are in order of ids
                start = np.searchsorted(place[order], np.arange(len(shown)))
                rank = np.empty(len(rows), np.int64)
                rank[order] = first[place[order]] + np.arange(len(rows)) - start[place[order]] + 1
                parts.append((np.full(len(rows), q), rows, found, rank))
        q, rows, found, rank = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
        docids = (names if names is not None else pa.array([], pa.string())).take(pa.array(rows, pa.int64()))
        return pa.table([ids.take(pa.array(q, pa.int64())), docids, pa.array(found, pa.float64()), pa.array(rank, pa.int32())], names=["qid", "docid", "score", "rank"])

    return run


def dense_search(blocks: DataFrame, queries: DataFrame, by: str, k: int, met: Met | None = None) -> DataFrame:
    """qid, paper_id, docid and score: among them the k best items of each query (qid, vector), papers by their best passage."""
    return _searched(blocks, dense_groups(queries), _dense_step, queries.schema["qid"].dataType.simpleString(), by, k, None, False, met)
