"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is in a document if the document holds at least `threshold` of the
item's distinct word shingles, wherever they stand.  Items are partitioned by
the number of their shingles.  An item of n shingles is sketched by its
k(n) = n - ceil(threshold * n) + 1 smallest shingle hashes (a bottom-k
MinHash): a document that misses all of them misses too many shingles to
contain the item, so the sketch finds every true pair.  (Banded signatures of
equal length can't: a 30-shingle item in a 20,000-shingle document has a
Jaccard similarity near 0.001.)  A partition is searched only if the document
has as many shingles as its smallest item needs.  Each candidate is then
verified by exact containment of the shingles themselves, not of hashes.

The items are a stated query set; they reach the tasks in blocks of at most
`block_shingles` shingles each (or one item), one block after the other, so
what is broadcast has a proven bound and no worker holds two blocks.

Defined cases: shingles are `width` lower-cased (A-Z) words; an item of fewer
words is one shingle of all of them, searched among the document's runs of as
many words; items without words, null items and null or empty documents match
nothing; repeated items and documents are judged row by row; empty tables give
no pairs; extra columns of `clean` pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIX = np.uint64(0x9E3779B97F4A7C15)


def needed(n: int, threshold: float) -> int:
    """Shared shingles that make an item of n shingles contained."""
    return max(1, int(np.ceil(round(threshold * n, 9))))


def shingles(words: list[bytes], width: int) -> list[bytes]:
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


def build(items: list[tuple[int, bytes]], width: int, threshold: float) -> tuple[list, list]:
    """The index of some items, as plain values for broadcasting.

    Partitions by shingle width and size class (1, 2-3, 4-7, ... shingles):
    (width, shared shingles that the smallest item needs, sorted sketch hashes,
    items of each hash); and the items: (id, width, shingles).
    """
    parts, known_items, known = [], [], {}
    classes: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    least: dict[tuple[int, int], int] = {}
    for item_id, text in items:
        words = common.tokens(text)
        if not words:
            continue
        w = min(width, len(words))
        grams = frozenset(shingles(words, w))
        n, at = len(grams), len(known_items)
        known_items.append((item_id, w, grams))
        key = (w, n.bit_length())
        least[key] = min(least.get(key, n), needed(n, threshold))
        hashes = sorted(set(rolling(word_hashes(words, known), w).tolist()))
        for h in hashes[: n - needed(n, threshold) + 1]:
            classes[key][h].append(at)
    for (w, c), owners in sorted(classes.items()):
        sketch = np.array(sorted(owners), np.uint64)
        parts.append((w, least[w, c], sketch, [owners[int(h)] for h in sketch]))
    return parts, known_items


def search(index: tuple[list, list], text: bytes, known: dict[bytes, int], threshold: float) -> list[tuple[int, int, int]]:
    """(item id, its shingles, shared ones) of each item that the text contains."""
    words = common.tokens(text)
    if not words:
        return []
    hashes, runs, found = word_hashes(words, known), {}, set()
    for w, least, sketch, owners in index[0]:
        if w not in runs:
            runs[w] = rolling(hashes, w)
        have = runs[w]
        if len(have) < least:
            continue
        at = np.minimum(np.searchsorted(sketch, have), len(sketch) - 1)
        for k in set(at[sketch[at] == have].tolist()):
            found.update(owners[k])
    out, exact = [], {}
    for i in sorted(found):
        item_id, w, grams = index[1][i]
        if w not in exact:
            exact[w] = set(shingles(words, w))
        shared = len(grams & exact[w])
        if shared >= needed(len(grams), threshold):
            out.append((item_id, len(grams), shared))
    return out


def _blocks(items: DataFrame, width: int, threshold: float, block_shingles: int) -> Iterator[tuple[list, bool]]:
    """(items, whether they are the last) of each block of at most block_shingles shingles, or one item; one without items if there are none."""
    held, n = [], 0
    for r in items.select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t")).toLocalIterator():
        size = len(r.t) // 2 + 1  # words at most
        if held and n + size > block_shingles:
            yield held, False
            held, n = [], 0
        held.append((r.item_id, bytes(r.t)))
        n += size
    yield held, True


FOUND = "array<struct<item_id:bigint,item_shingles:bigint,shared:bigint>>"


def _lookup(index, threshold: float, of):
    """An Arrow map that applies `of(batch, list of finds of each row)`."""

    def run(batches):
        known: dict[bytes, int] = {}
        for b in common.pieces(batches):
            if len(known) > 400_000:
                known.clear()
            yield of(b, [search(index.value, t, known, threshold) for t in common.utf8(b.column("text"))])

    return run


def contained(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, block_shingles: int = 500_000) -> DataFrame:
    """doc_id, item_id, item_shingles, shared and containment of each pair of a document and an item that it contains."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("found", T._parse_datatype_string(FOUND))])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "item_shingles", "shared")]))

    def pairs(b, found):
        keep = pa.array([bool(f) for f in found])
        rows = [[dict(zip(("item_id", "item_shingles", "shared"), x)) for x in f] for f in found if f]
        return pa.RecordBatch.from_arrays([b.column("doc_id").filter(keep), pa.array(rows, kind)], names=["doc_id", "found"])

    sc, out = docs.sparkSession.sparkContext, None
    for block, last in _blocks(items, width, threshold, block_shingles):
        index = sc.broadcast(build(block, width, threshold))
        part = docs.select("doc_id", "text").mapInArrow(_lookup(index, threshold, pairs), schema)
        if not last:
            part = common.written(part, "found")
            index.destroy()
        out = part if out is None else out.unionByName(part)
    x = F.col("found")
    return out.select("doc_id", F.explode("found").alias("found")).select("doc_id", x.item_id.alias("item_id"), x.item_shingles.alias("item_shingles"), x.shared.alias("shared"), (x.shared / x.item_shingles).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, block_shingles: int = 500_000) -> DataFrame:
    """docs without those that contain an item; one pass for each block of items, no shuffle."""
    sc = docs.sparkSession.sparkContext
    for block, last in _blocks(items, width, threshold, block_shingles):
        index = sc.broadcast(build(block, width, threshold))
        docs = docs.mapInArrow(_lookup(index, threshold, lambda b, found: b.filter(pa.array([not f for f in found], pa.bool_()))), docs.schema)
        if not last:
            docs = common.written(docs, "cleaned")
            index.destroy()
    return docs


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), item_words AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), items AS (
  SELECT item_id, least(5, len(w)) AS k, unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' ')))) AS g
  FROM item_words WHERE len(w) > 0
), sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
widths AS (SELECT DISTINCT k FROM items),
grams AS (
  SELECT row_id, doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS g
  FROM (SELECT row_number() OVER () AS row_id, doc_id, w FROM words), widths WHERE len(w) >= k
)
SELECT d.doc_id, i.item_id, s.n AS item_shingles, count(*) AS shared, count(*) / s.n AS containment
FROM grams d JOIN items i ON d.g = i.g AND d.k = i.k JOIN sizes s ON s.item_id = i.item_id
GROUP BY d.row_id, d.doc_id, i.item_id, s.n
HAVING count(*) >= greatest(1, ceil(round(0.8 * s.n, 9)))
"""
