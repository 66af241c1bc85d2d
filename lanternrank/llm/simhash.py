"""SimHash near-duplicates found by BK-trees over shards of fingerprints.

`fingerprints` turns each whole text into 64 bits.  `links` finds fingerprints
within a Hamming radius: every distinct fingerprint is dealt to shards, each
shard's BK-tree keys children by their integer distance to the parent, and a
search follows only edges within the radius.  `components` joins the links.

The shard trees are not broadcast whole: all fingerprints of a corpus have no
size bound.  Two fingerprints within `radius` bits agree on one of radius + 1
blocks of bits; a shard holds those with the same first bits of a block, as
many bits as give about `shard_size` fingerprints a shard (all bits of the block
at most).  So each tree and its queries meet in one task, every link is found,
and a hot fingerprint is one node however many rows have it.

Defined cases: null and empty texts have no words and fingerprint zero, which
links like any other; fewer words than a shingle give one shingle of all;
repeated rows and null ids get their class like other rows (a class of null
ids only has a null component_id); an empty table gives an empty result;
extra columns do not matter to `classes`, and `keep_one` passes them on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ONE = np.uint64(1)


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash: a bit is one if over half of the shingles' XXH64 have it."""
    words = common.tokens(data)
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - width + 1].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(start, end[width - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_hash (tells texts of one id apart) and fp, the fingerprint as a signed long."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType(), False)])

    def run(batches):
        for b in common.pieces(batches):
            fps = np.array([fingerprint(t, width, seed) for t in common.utf8(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fps)], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


# ---- BK-trees: a forest of one tree a shard, built and searched level by level


def bk_build(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root of each row's shard, sorted edge keys parent * 65 + distance, child of each edge).

    Nodes are row numbers; rows are distinct within a shard and sorted by it.
    In each round the rows that have not become nodes yet stand at a node; the
    first one at a distance becomes its child there and the others go down to it.
    """
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = shard[1:] != shard[:-1]
    root = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rest, at = np.flatnonzero(~new), root[~new]
    keys, kids = [], []
    while len(rest):
        key = at * 65 + np.bitwise_count(fp[rest] ^ fp[at])
        order = np.argsort(key, kind="stable")
        rest, key = rest[order], key[order]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(head)
        keys.append(key[first])
        kids.append(rest[first])
        at = rest[first][np.cumsum(head) - 1][~head]
        rest = rest[~head]
    if not keys:
        return root, np.empty(0, np.int64), np.empty(0, np.int64)
    keys, kids = np.concatenate(keys), np.concatenate(kids)
    order = np.argsort(keys)
    return root, keys[order], kids[order]


def bk_search(fp: np.ndarray, root: np.ndarray, keys: np.ndarray, kids: np.ndarray, radius: int, most: int = 1 << 19, queries: np.ndarray | None = None, visits: list[int] | None = None):
    """Blocks of links (query row, found row) within the radius; at most about `most` open pairs at once.

    Without `queries` (row numbers) all rows are queries, and query > found; with them, a query finds itself too.
    `visits` takes the number of nodes met at each step.
    """
    every = queries is None
    queries = np.arange(len(fp)) if every else queries
    for lo in range(0, len(queries), most):
        open_ = [(queries[lo : lo + most], root[queries[lo : lo + most]])]
        while open_:
            query, node = open_.pop()
            if len(query) > most:
                half = len(query) // 2
                open_ += [(query[half:], node[half:]), (query[:half], node[:half])]
                continue
            if visits is not None:
                visits.append(len(node))
            d = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
            hit = (d <= radius) & (query > node) if every else d <= radius
            if hit.any():
                yield query[hit], node[hit]
            a = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
            b = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), side="right")
            n = b - a
            if total := int(n.sum()):
                at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
                open_.append((np.repeat(query, n), kids[at]))


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def shard_forest(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within shards, as a star of each linked group: (fingerprint, the group's smallest).  Never all pairs."""
    order = np.lexsort((fp, shard))
    shard, fp = shard[order], fp[order]
    alone = np.ones(len(fp), bool)
    if len(fp) > 1:
        same = shard[1:] == shard[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
    shard, fp = shard[~alone], fp[~alone]
    if not len(fp):
        return fp, fp
    bits = fp.view(np.uint64)
    parent = np.arange(len(fp))
    for a, b in bk_search(bits, *bk_build(shard, bits), radius):
        _union(parent, a, b)
    own = np.arange(len(fp))
    linked = parent != own
    return fp[linked], fp[parent[linked]]


def _routes(radius: int, bits: int):
    """Shard keys of a column fp: the first `bits` bits of each of radius + 1 blocks, and which block it is."""
    k, out = radius + 1, []
    for i in range(k):
        lo, hi = 64 * i // k, 64 * (i + 1) // k
        lo = max(lo, hi - bits)
        block = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        out.append(block * F.lit(k) + F.lit(i))
    return F.explode(F.array(*out))


def links(fps: DataFrame, radius: int = 3, shard_size: int = 1024, rows_per_task: int = 4_000_000) -> DataFrame:
    """Edges (u, v), u > v, that connect just the fingerprints which links within the radius connect.

    fps: distinct fp.  Rows travel as 16 bytes and each shard is one task's; the
    number of partitions follows the rows.
    """
    spark = fps.sparkSession
    n = fps.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * (radius + 1) // rows_per_task + 1)
    bits = max(0, math.ceil(math.log2(max(1, n) / shard_size)))

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            u, v = shard_forest(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]), radius)
            for at in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(u[at : at + (1 << 16)]), pa.array(v[at : at + (1 << 16)])], names=["u", "v"])

    routed = fps.select(_routes(radius, bits).alias("shard"), "fp").repartition(tasks, "shard")
    return routed.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node with an edge: label is the smallest node of its component.

    Alternating large-star and small-star steps; each step's edges are written
    to the shared folder (and the ones before deleted), and nothing but two
    counts reaches the driver.
    """
    spark = edges.sparkSession
    with common.scratch(spark):
        edges, before = common.kept(edges, "edges"), None
        while True:
            state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before or not state[0]:
                return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
            before = state
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            down = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(down, "u")
            out = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            edges = common.kept(out, "edges")


def _labelled(docs: DataFrame, radius: int, width: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows doc_id, text_hash, fp as a written table; distinct fp with label and first, its smallest doc)."""
    rows = common.written(fingerprints(docs, width, seed), "fingerprints")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash", "fp"))
    fps = common.written(rows.groupBy("fp").agg(first.alias("first")), "fps")
    label = components(links(fps.select("fp"), radius))
    return rows, fps.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "first")


def classes(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    Skew: a fingerprint's rows are aggregated before its links, and the last
    join back to the rows is one whose large partitions Spark can split.
    """
    rows, fps = _labelled(docs, radius, width, seed)
    least = fps.groupBy("label").agg(F.min("first").alias("least"))
    named = common.written(fps.join(least, "label").select("fp", F.col("least.doc_id").alias("component_id")), "named")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """docs with one row of each class left, of the smallest doc_id; all columns stay."""
    with common.scratch(docs.sparkSession):
        _, fps = _labelled(docs, radius, width, seed)
        best = fps.groupBy("label").agg(F.min("first").alias("b")).select(F.col("b.doc_id").alias("_id"), F.col("b.text_hash").alias("_hash"))
        return only(docs, best)


def only(docs: DataFrame, best: DataFrame) -> DataFrame:
    """One row of docs for each _id and _hash (of the text) of best, which is written first.

    Join and deduplication share one key without nulls, so whole rows are exchanged once.
    """
    key, = common.unused(docs, "_key")
    best = common.kept(best.select(row_key(F.col("_hash"), F.col("_id")).alias(key)), "survivors")
    return docs.withColumn(key, row_key(F.xxhash64("text"), F.col("doc_id"))).join(best, key, "left_semi").dropDuplicates([key]).drop(key)


def row_key(text_hash: Column, doc_id: Column) -> Column:
    """What tells rows apart, without nulls: a null id is left out."""
    return F.concat_ws(":", text_hash.cast("string"), doc_id.cast("string"))
