"""Vector code compression: every part of a vector becomes the number of its nearest codebook entry.

Vectors become whole numbers, floor(256 x), in columnar NumPy blocks: a row a
dimension.  A round assigns each part of each block, adding squared distances
dimension by dimension, and gathers int64 sums and counts with ``np.add.at``;
``treeAggregate`` merges these small tensors, so the driver sees one of them,
whatever the number of rows.  Whole numbers make every order of merging give
the same codebooks, and a lost task is worked out again from the written blocks.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped; shorter vectors, and lengths that the number of parts doesn't
divide, are filled up with zeros; components beyond 2^27 in size (x beyond
524,288) are held at that bound, as their squared distances would leave a long;
with fewer rows than entries a codebook has an entry a row; of repeated ids the
smaller vector comes first, null ids come last; equal labels share their error,
null labels too; an empty table gives no rows.  Columns other than vec_id,
embedding and label are left out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from . import common

SCALE, BOUND = 256, 1 << 27
#: Bytes of a block's matrix and of its distances to a codebook.
BLOCK_BYTES = 8 << 20
#: A label of at least this share of the rows is hot; so there are that many at most, which is broadcast.
HOT = 1_000


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows whose components are all numbers."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & ~bad)


def whole(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of each component, a row a dimension."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.clip(np.floor(flat * SCALE), -BOUND, BOUND).astype(np.int64)
    out = np.zeros((width, len(lengths)), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = flat
    return out


@dataclass
class Blocks:
    """A written table: vec_ids, labels and the block of their vectors; how wide vectors are, and how many parts they have."""

    table: DataFrame
    width: int
    parts: int


def blocks(rows: DataFrame, parts: int = 16, entries: int = 64) -> Blocks:
    """The rows of `kept` as blocks of bounded size."""
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(-(-longest // parts), 1) * parts
    most = max(1, BLOCK_BYTES // (8 * max(width, entries)))
    schema = StructType([StructField("vec_ids", ArrayType(rows.schema["vec_id"].dataType)), StructField("labels", ArrayType(rows.schema["label"].dataType)), StructField("block", BinaryType())])

    def run(batches):
        listed = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                b = batch.slice(at, most)
                ids, labels = (pa.concat_arrays([b.column(n)]) for n in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays([listed(ids), listed(labels), pa.array([whole(b.column("embedding"), width).tobytes()], pa.binary())], names=schema.names)

    return Blocks(common.written(rows.mapInArrow(run, schema), "blocks"), width, parts)


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each part's nearest entry, a row a part; ties go to the smaller number.

    block: dimensions x vectors; books: parts x entries x positions.
    """
    parts, entries, size = books.shape
    n = block.shape[1]
    found, far = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
    for p in range(parts):
        total = np.zeros((n, entries), np.int64)
        for d in range(size):
            gap = block[p * size + d][:, None] - books[p, :, d]
            total += gap * gap
        found[p] = total.argmin(axis=1)
        far[p] = total[np.arange(n), found[p]]
    return found, far


def first_books(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """Codebooks of the parts of the rows of smallest id: parts x entries x positions."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    held = whole(pa.array([r.embedding for r in first], pa.list_(pa.float64())), width)
    return np.ascontiguousarray(held.reshape(parts, width // parts, len(first)).transpose(0, 2, 1))


def refined(told: Blocks, books: np.ndarray, depth: int = 2) -> np.ndarray:
    """One round: every part is assigned, and each used entry becomes floor(sum / count) of its parts."""
    parts, _, size = books.shape
    shared = told.table.sparkSession.sparkContext.broadcast(books)

    def add(state, row):
        block, held = np.frombuffer(row.block, np.int64).reshape(parts * size, -1), shared.value
        sums, counts = state or (np.zeros(held.shape, np.int64), np.zeros(held.shape[:2], np.int64))
        found, _ = nearest(block, held)
        for p in range(parts):
            np.add.at(sums[p], found[p], block[p * size : (p + 1) * size].T)
            np.add.at(counts[p], found[p], 1)
        return sums, counts

    def merge(a, b):
        return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

    sums, counts = told.table.select("block").rdd.treeAggregate(None, add, merge, depth)
    shared.unpersist()
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)


def train(rows: DataFrame, told: Blocks, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """Codebooks after that many rounds; `rows` are those that the blocks hold."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    books = first_books(rows, told.width, told.parts, entries)
    if books.shape[1]:
        for _ in range(rounds):
            books = refined(told, books)
    return books


def encode(told: Blocks, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (a byte a part) and error (squared distances summed over parts) of every row of the blocks."""
    kinds = {f.name: f.dataType.elementType for f in told.table.schema.fields if f.name != "block"}
    schema = StructType([StructField("vec_id", kinds["vec_ids"]), StructField("label", kinds["labels"]), StructField("code", BinaryType()), StructField("error", LongType())])
    parts = told.parts

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                found, far = nearest(np.frombuffer(b.column("block")[0].as_py(), np.int64).reshape(books.shape[0] * books.shape[2], -1), books)
                flat = np.ascontiguousarray(found.T.astype(np.uint8)).tobytes()
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), found.shape[1], [None, pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("vec_ids").flatten(), b.column("labels").flatten(), codes, pa.array(far.sum(axis=0))], names=schema.names)

    return told.table.mapInArrow(run, schema)


def decoded(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and the vector that its code stands for."""
    schema = StructType([coded.schema["vec_id"], StructField("embedding", ArrayType(DoubleType()))])
    parts = books.shape[0]

    def run(batches):
        for b in batches:
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, parts)
            rows = books[np.arange(parts), code].reshape(b.num_rows, -1) / SCALE
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(list(rows), pa.list_(pa.float64()))], names=schema.names)

    return coded.select("vec_id", "code").mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded (a written table) with label_error, the sum of errors of equal labels.

    Sums are taken before anything moves.  Labels of a thousandth of the rows
    and more, a thousand at most, are broadcast; the others have fewer rows than that each
    and join by shuffle.
    """
    sums = common.written(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels").withColumnRenamed("label", "of_label")
    total = coded.count()
    hot, rest = F.broadcast(sums.where(F.col("n") * HOT >= total)), sums.where(F.col("n") * HOT < total)
    same = F.col("label").eqNullSafe(F.col("of_label"))
    often, seldom = coded.join(hot, same), coded.join(hot, same, "left_anti").join(rest, same)
    return often.unionByName(seldom).drop("of_label", "n")


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """The written codes of all kept vectors (vec_id, label, code, error) and the codebooks."""
    rows = kept(vectors)
    told = blocks(rows, parts, entries)
    books = train(rows, told, entries, rounds)
    return common.written(encode(told, books), "codes"), books


SQL = """
WITH held AS (
  SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT vec_id, p, v[p * 4 + 1:p * 4 + 4] AS v FROM held, range(16) r(p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts WHERE vec_id IN (SELECT vec_id FROM held ORDER BY vec_id LIMIT 64)),
""" + "".join(f"""
near{i} AS (
  SELECT a.vec_id, a.p, min(((a.v[1] - b.v[1]) ** 2 + (a.v[2] - b.v[2]) ** 2 + (a.v[3] - b.v[3]) ** 2 + (a.v[4] - b.v[4]) ** 2)::BIGINT * 64 + b.e) AS best, any_value(a.v) AS v
  FROM parts a JOIN book{i} b ON a.p = b.p GROUP BY a.vec_id, a.p
), book{i + 1} AS (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN (
    SELECT p, best % 64 AS e, list_transform([sum(v[1]), sum(v[2]), sum(v[3]), sum(v[4])], lambda s: floor(s::DOUBLE / count(*))::BIGINT) AS v FROM near{i} GROUP BY ALL) m ON m.p = b.p AND m.e = b.e
),""" for i in range(3)) + """
coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', best % 64)), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM near2 GROUP BY vec_id
), told AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT c.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded c JOIN held h ON h.vec_id = c.vec_id, told
"""
