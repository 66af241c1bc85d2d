"""Near copies by exact similarity of word shingles, and one row of each group of them.

Two texts are near copies if the Jaccard similarity of their sets of `width`-word
shingles is at least `similarity`; groups are the connected near copies.
Candidates share one of `BANDS` bands of `ROWS` MinHash values; then SimHash
fingerprints of the same shingles, in BK-trees over the shards, must lie within
`RADIUS` bits, and `AGREE` of the MinHash values must agree.  Each candidate
that can join two groups is verified on the whole shingle sets (64-bit hashes).
At a similarity of 0.8 all bands differ with probability 7e-6, fewer values
agree with 6e-6, and fingerprints are about 10 bits apart.  The pigeonhole rule
has no blocks for such a radius: bands make the shards instead.

Pairs are never listed.  First each text is verified against one leader, the
row of its shards that shares bands with the most others.  These links make
groups, and texts that try for one leader a home, whether they link or not.
Then, in each shard, rows outside the largest group ask for the homes of rows
of other groups that are candidates; a question meets the home's members once
and stops at the first of a group that links.  Shards, leaders and homes of any
size are cut into blocks of bounded size.

Defined cases: texts are nodes by their 64-bit hash, so exact copies are one;
fewer words than a shingle give one shingle of all; texts without words, null
ones too, have no shingles and are copies of each other; an empty table gives
an empty result; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, decontam, simhash

WIDTH, SIMILARITY, RADIUS, BANDS, ROWS = 5, 0.8, 26, 30, 5
#: MinHash values, of BANDS * ROWS, in which candidates agree at least; at a similarity of 0.8 the mean is 120 and the deviation 4.9.
AGREE = 98
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, known: dict[bytes, int], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = common.tokens(text)
    return np.unique(decontam.rolling(decontam.word_hashes(words, known), min(width, len(words)))) if words else np.empty(0, np.uint64)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; one of two empty ones."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def sketch(found: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    """SimHash fingerprint, band keys, and a byte of each MinHash value of a shingle set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 11):
        part = found[at : at + (1 << 11)]
        np.minimum(least, (part[None, :] * FACTORS[:, None]).min(axis=1), out=least)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * decontam.MIX
        keys ^= keys >> np.uint64(29)
    mixed = (least ^ (least >> np.uint64(31))) * decontam.MIX
    fp = int(np.packbits(ones * 2 > len(found), bitorder="little").view(np.int64)[0])
    return fp, keys.view(np.int64), (mixed >> np.uint64(56)).astype(np.uint8).tobytes()


def _known(known: dict) -> dict:
    if len(known) > 400_000:
        known.clear()
    return known


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, node (the text's hash), fp, bands, values (a byte of each MinHash value) and size (shingles) of every row."""
    fields = [T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("values", T.BinaryType()), T.StructField("size", T.LongType())]
    schema = T.StructType([docs.schema["doc_id"], *fields])

    def run(batches):
        known: dict[bytes, int] = {}
        for b in common.pieces(batches):
            sets = [shingle_set(t, _known(known), width) for t in common.utf8(b.column("text"))]
            fps, keys, values = zip(*map(sketch, sets))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), pa.array(fps, pa.int64()), bands, pa.array(values, pa.binary()), pa.array([len(s) for s in sets], pa.int64())], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("node"), "text").mapInArrow(run, schema)


# ---- candidates


def stars(nodes: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(node, leader) of each node that has a leader within the radius in its shards; and the nodes that share a shard with others.

    A shard's leader is the row that meets the most others in its shards; of a
    node's leaders it is the one who meets the most.  Shards of any size are
    aggregated, never gathered.
    """
    rows = nodes.select(F.explode("bands").alias("shard"), "node", "fp")
    shared = rows.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    met = common.written(rows.join(shared, "shard"), "met")
    known = met.groupBy("node").agg(F.sum("n").alias("meets"))
    leaders = met.join(known, "node").groupBy("shard").agg(F.max(F.struct("meets", "node", "fp")).alias("l"))
    near = met.join(leaders, "shard").where((F.col("node") != F.col("l.node")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("l.fp"))) <= radius))
    return near.groupBy("node").agg(F.max(F.struct("l.meets", "l.node")).alias("l")).select("node", F.col("l.node").alias("leader")), met.select("node").distinct()


def near_rows(block: np.ndarray, query: np.ndarray, fp: np.ndarray, values: np.ndarray, label: np.ndarray, radius: int, least: int = AGREE, most: int = 1 << 16):
    """Arrays of row pairs (query row, other row of its block) of different labels, within the radius and agreeing.

    Rows are sorted by block and fingerprint.  A BK-tree a block holds its
    distinct fingerprints, and those of query rows walk it.
    """
    if not len(fp):
        return
    new = np.concatenate(([True], (block[1:] != block[:-1]) | (fp[1:] != fp[:-1])))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(fp)))
    asked = np.flatnonzero(query)
    of = (np.cumsum(new) - 1)[asked]  # in order, so each fingerprint's query rows stand together
    begin, rows = np.searchsorted(of, np.arange(len(first))), np.bincount(of, minlength=len(first))
    for a, b in simhash.bk_search(fp[first], *simhash.bk_build(block[first], fp[first]), radius, most, np.unique(of)):
        for found, place in _spread(b, a, begin, rows, most):  # each query row of a fingerprint, then each row that it finds
            for x, y in _spread(asked[place], found, first, size, most):
                keep = label[x] != label[y]
                x, y = x[keep], y[keep]
                keep = (values[x] == values[y]).sum(axis=1) >= least
                yield x[keep], y[keep]


def _spread(tag: np.ndarray, group: np.ndarray, first: np.ndarray, size: np.ndarray, most: int):
    """(tag, member) for each member first .. first + size - 1 of each group, about `most` at once."""
    total = np.cumsum(size[group])
    at = 0
    while at < len(group):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        n = size[group[at:end]]
        yield np.repeat(tag[at:end], n), np.repeat(first[group[at:end]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        at = end


def between(nodes: DataFrame, radius: int, most_rows: int = 20_000, rows_per_task: int = 200_000) -> DataFrame:
    """Distinct (node, home): the homes in which a node's shards have candidates of another label.

    nodes: node, fp, bands, values, label, home.  In each shard the rows outside
    the largest label are queries.  A shard is cut into blocks of about
    `most_rows` rows and queries: a row goes to its part with each part of the
    queries.
    """
    spark = nodes.sparkSession
    rows = nodes.select(F.explode("bands").alias("shard"), "node", "fp", "values", "label", "home")
    count = rows.groupBy("shard", "label").agg(F.count("*").alias("n"))
    top = count.groupBy("shard").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top")).where("n > top.n")
    parts = top.select("shard", F.col("top.label").alias("top"), F.ceil(F.col("n") / most_rows).cast("int").alias("parts"), F.ceil((F.col("n") - F.col("top.n")) / most_rows).cast("int").alias("queries"))
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = lambda i, j, q: F.struct(i.alias("i"), j.alias("j"), F.lit(q).alias("query"))
    as_row = F.transform(every("queries"), lambda j: block(own("parts"), j, False))
    as_query = F.when(F.col("label") != F.col("top"), F.transform(every("parts"), lambda i: block(i, own("queries"), True))).otherwise(F.slice(as_row, 1, 0))
    placed = rows.join(parts, "shard").select(F.explode(F.concat(as_row, as_query)).alias("b"), "shard", "node", "fp", "values", "label", "home")
    # a row may stand in a block both as row and as query
    facts = ("fp", "values", "label", "home")
    merged = placed.groupBy(F.xxhash64("shard", "b.i", "b.j").alias("block"), "node").agg(*[F.first(c).alias(c) for c in facts], F.max("b.query").alias("query"))
    merged = common.written(merged, "blocks")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), merged.count() // rows_per_task + 1)

    def run(batches):
        got = [[*(b.column(n).to_numpy(zero_copy_only=False) for n in ("block", "node", "fp", "label", "home", "query")), _values(b.column("values"))] for b in batches if b.num_rows]
        if not got:
            return
        shard, node, fp, label, home, query, values = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((fp, shard))
        shard, node, fp, label, home, query, values = (x[order] for x in (shard, node, fp.view(np.uint64), label, home, query.astype(bool), values))
        held = []
        for a, b in near_rows(shard, query, fp, values, label, radius):
            held.append(np.unique(np.stack((node[a], home[b]), axis=1), axis=0))
            if sum(map(len, held)) > 1 << 18:
                held = [np.unique(np.concatenate(held), axis=0)]
            if len(held) == 1 and len(held[0]) > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop().T], names=["node", "home"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.concatenate(held), axis=0).T], names=["node", "home"])

    return merged.repartition(tasks, "block").select("block", "node", "fp", "label", "home", "query", "values").mapInArrow(run, "node long, home long").distinct()


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


# ---- verification


def links(asks: DataFrame, members: DataFrame, facts: DataFrame, similarity: float = SIMILARITY, least: int = AGREE, block_bytes: int = 4 << 20) -> DataFrame:
    """(u, v), u > v: for each asking node and each other label of the members it meets, the likeliest member that is similar, if any.

    asks, members: node, home; facts: node, label, values, size, shingles.  A
    home's members and the nodes that ask for it are cut into parts of about
    `block_bytes`; a block is a part of each and holds their sets once.
    """
    cut = lambda df, n: df.groupBy("home").agg(F.ceil(F.greatest(F.sum("size") * 8 / block_bytes, F.lit(1.0))).cast("int").alias(n))
    sized = lambda df: df.join(facts.select("node", "size"), "node")
    parts = common.written(cut(sized(asks), "asked").join(cut(sized(members), "parts"), "home"), "parts")
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(parts, "home").select("home", "node", part("asked").alias("i"), every("parts").alias("j"))
    right = members.join(parts, "home").select("home", "node", part("parts").alias("j"), every("asked").alias("i"))
    # names apart for the two sides, which come from the same tables
    key = lambda df, end: df.join(facts, "node").select(F.xxhash64("home", "i", "j").alias(f"block{end}"), *[F.col(c).alias(c + end) for c in ("home", "node", "label", "values", "shingles")]).groupBy(f"block{end}", f"home{end}")

    def check(asking: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asking.num_rows and held.num_rows:
            node, label = held.column("node_of").to_numpy(), held.column("label_of").to_numpy()
            values, sets = _values(held.column("values_of")), [np.frombuffer(s, np.uint64) for s in held.column("shingles_of").to_pylist()]
            for x, own, v, s in zip(*(asking.column(c).to_pylist() for c in ("node", "label", "values", "shingles"))):
                mine, agree = np.frombuffer(s, np.uint64), (values == np.frombuffer(v, np.uint8)).sum(axis=1)
                met = np.flatnonzero((agree >= least) & (label != own))
                done = set()
                for k in met[np.argsort(-agree[met], kind="stable")].tolist():
                    y = sets[k]
                    if label[k] not in done and min(len(mine), len(y)) >= similarity * max(len(mine), len(y)) - 1e-9 and similarity_of(mine, y) >= similarity - 1e-9:
                        done.add(label[k])
                        out.append((max(x, int(node[k])), min(x, int(node[k]))))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return key(left, "").cogroup(key(right, "_of")).applyInArrow(check, "u long, v long").distinct()


def shingle_sets(docs: DataFrame, needed: DataFrame, width: int = WIDTH) -> DataFrame:
    """node, size and shingles of the rows whose `simhash.row_key` is in `needed`."""

    def sets(batches):
        known: dict[bytes, int] = {}
        for b in common.pieces(batches):
            found = [shingle_set(t, _known(known), width) for t in common.utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "size", "shingles"])

    named = docs.select(F.xxhash64("text").alias("node"), "text", simhash.row_key(F.xxhash64("text"), F.col("doc_id")).alias("key"))
    texts = named.join(needed, "key", "left_semi")
    return texts.mapInArrow(sets, "node long, size long, shingles binary").dropDuplicates(["node"])


def _named(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """nodes with the component of each, a node without an edge being its own."""
    found = simhash.components(edges).select("node", F.col("label").alias("_found"))
    return nodes.join(found, "node", "left").withColumn(name, F.coalesce("_found", "node")).drop("_found")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group of near copies left, of the smallest doc_id; all columns stay."""
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "node"))
    edge = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    with common.scratch(docs.sparkSession):
        rows = common.written(sketches(docs, width), "sketches")
        nodes = common.written(rows.groupBy("node").agg(first.alias("first"), *[F.first(c).alias(c) for c in ("fp", "bands", "values")]), "nodes")
        led, met = stars(nodes, radius)
        led, met = common.written(led, "led"), common.written(nodes.join(met, "node", "left_semi"), "met")
        sets = common.written(shingle_sets(docs, met.select(simhash.row_key(F.col("node"), F.col("first.doc_id")).alias("key")), width), "shingles")
        facts = lambda df: df.select("node", "label", "values").join(sets, "node")
        # at first every node is a label of its own, and a leader alone is a home
        leaders = led.select(F.col("leader").alias("node"), F.col("leader").alias("home")).distinct()
        near = common.written(links(led.select("node", F.col("leader").alias("home")), leaders, facts(met.withColumn("label", F.col("node"))), similarity), "near")
        met = _named(_named(met, near, "label"), led.select(*edge(F.col("node"), F.col("leader"))), "home")
        met = common.written(met, "met")
        asks = common.written(between(met, radius), "asks")
        near = near.unionByName(common.written(links(asks, met.select("node", "home"), facts(met), similarity), "near"))
        best = _named(nodes.select("node", "first"), near, "label").groupBy("label").agg(F.min("first").alias("b"))
        return simhash.only(docs, best.select(F.col("b.doc_id").alias("_id"), F.col("b.node").alias("_hash")))
