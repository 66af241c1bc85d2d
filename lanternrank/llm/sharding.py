"""Sharding by a histogram sort: DataFrame functions only.

Rows are ordered by a 60-bit hash of the text, then by doc_id, so equal texts
stand together and any order of arrival is gone.  Key ranges ("cells") are cut
by equidistant probes between their smallest and largest key; one aggregation
counts exact bytes and rows of all cells at once.  Cells that a splitter falls
into, or that hold too much for one task, are probed again until each splitter
meets a key boundary (no tolerance is left) or stands among equal rows, and
each cell is small.  Then the rows are exchanged once, by cell, and numbered
within their cell.

The driver holds the cells only: `probes` for each splitter and round, and
about two for each `most_rows` rows or `most_bytes` bytes.  Cells of equal texts
are cut by doc_id, so a hot group is spread as well.

Defined cases: null and empty texts share one hash and have 16 bytes; a null
doc_id comes before all others; rows with equal text and doc_id can't be told
apart: they have one size, stay in one cell, are numbered in any order, and are
dealt by their number where a splitter stands among them; an empty table gives
an empty result; columns named like the results of `assign` are replaced, all
others pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

OVERHEAD = 16
#: Cell names have four hexadecimal digits for each round.
MOST_PROBES = 1 << 16


@dataclass
class Cell:
    size: int
    rows: int
    low: int  # smallest and largest hash
    high: int
    low_id: int
    high_id: int
    low_end: int
    high_end: int

    def key(self) -> tuple[str, int, int] | None:
        """The first key in which its rows differ, with its range."""
        ranges = (("h", self.low, self.high), ("d", self.low_id, self.high_id), ("e", self.low_end, self.high_end))
        return next((r for r in ranges if r[1] != r[2]), None)


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), h (60 bits), d and e (order of doc_id: its upper 62 bits as a number from 0, null -1, and its lower two), size and crc."""
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    half = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    order = F.coalesce(F.shiftrightunsigned(doc_id.bitwiseXOR(F.lit(-(1 << 63))), 2), F.lit(-1))
    end = F.coalesce(doc_id.bitwiseAND(F.lit(3)), F.lit(0)).cast("long")
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return docs.select(row.alias("row"), half.alias("h"), order.alias("d"), end.alias("e"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("crc"))


def _count(cells: DataFrame) -> list:
    ends = [f(k).alias(f"{n}{k}") for k in "hde" for n, f in (("low_", F.min), ("high_", F.max))]
    return cells.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), *ends).orderBy("cell").collect()


def _probe(rows: DataFrame, cut: list[tuple[str, int, int, str]], how: str) -> DataFrame:
    """rows with a finer cell where it is cut; cut: (cell, lowest key, width of a probe, which key)."""
    if cut[0][0] == "":  # the one cell of all rows: nothing to look up
        _, low, width, key = cut[0]
        return rows.withColumn("cell", F.lpad(F.lower(F.hex(F.expr(f"({key} - ({low}L)) div {width}L"))), 4, "0"))
    small = F.broadcast(rows.sparkSession.createDataFrame(cut, "cell string, low long, width long, key string"))
    step = F.lpad(F.lower(F.hex(F.expr("(CASE key WHEN 'h' THEN h WHEN 'd' THEN d ELSE e END - low) div width"))), 4, "0")
    return rows.join(small, "cell", how).withColumn("cell", F.concat("cell", F.coalesce(step, F.lit("")))).drop("low", "width", "key")


def cells(keyed: DataFrame, shards: int, probes: int, most_rows: int, most_bytes: int) -> tuple[dict[str, Cell], list[list[tuple]]]:
    """The final cells by name (names sort as keys do), and the cuts of each round.

    Every cut narrows the range of a key, so the rounds end by themselves.
    """
    done: dict[str, Cell] = {}
    total, cuts, rows = None, [], keyed.withColumn("cell", F.lit(""))
    fresh = _count(rows)
    while True:
        open_ = {r["cell"]: Cell(*r[1:]) for r in fresh}
        done |= open_
        total = sum(c.size for c in done.values()) if total is None else total
        cut, below = [], 0
        for name in sorted(done):
            c = done[name]
            # a splitter k * total / shards inside the cell, past its first byte
            splits = (below + c.size - 1) * shards // total > below * shards // total
            below += c.size
            parts = max(-(-c.rows // most_rows), -(-c.size // most_bytes))
            if name in open_ and (splits or parts > 1) and (differ := c.key()):
                key, lo, hi = differ
                cut.append((name, lo, (hi - lo) // min(MOST_PROBES, max(probes if splits else 2, 2 * parts)) + 1, key))
        if not cut:
            return done, cuts
        cuts.append(cut)
        for name, *_ in cut:
            del done[name]
        rows = _probe(rows, cut, "inner")
        fresh = _count(rows)


def _places(found: dict[str, Cell], shards: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """For each cell its runs: (number of the first row, shard, slot of that row); only cells of equal rows have several."""
    total, below, slots, out = sum(c.size for c in found.values()), 0, [0] * shards, []
    for name in sorted(found):
        c = found[name]
        each, low = c.size // c.rows, below * shards // total
        high = low if c.key() else (below + c.size - each) * shards // total
        # row i has below + i * each bytes before it: shard s begins with the first whose share reaches s
        starts = [0, *(-((below * shards - s * total) // (each * shards)) for s in range(low + 1, high + 1)), c.rows]
        runs = []
        for s, a, b in zip(range(low, high + 1), starts, starts[1:]):
            if a < b:
                runs.append((a, s, slots[s]))
                slots[s] += b - a
        out.append((name, runs))
        below += c.size
    return out


def assign(docs: DataFrame, shards: int = 40, probes: int = 1024, most_rows: int = 1_000_000, most_bytes: int = 512 << 20) -> DataFrame:
    """docs with shard, slot (gapless from 0 in each shard), size and text_crc32.

    Shard k takes the rows before which between k and k + 1 shares of all
    bytes stand, so sizes differ by the largest row at most.
    """
    if not 2 <= probes <= MOST_PROBES:
        raise ValueError(f"probes must be from 2 to {MOST_PROBES}")
    docs = docs.drop("shard", "slot", "size", "text_crc32")
    keyed = _keyed(docs)
    keys = common.written(keyed.select("h", "d", "e", "size"), "keys")
    found, cuts = cells(keys, shards, probes, most_rows, most_bytes)
    place = F.broadcast(docs.sparkSession.createDataFrame(_places(found, shards), "cell string, runs array<struct<start:long,shard:int,slot:long>>"))
    rows = keyed.withColumn("cell", F.lit(""))
    for cut in cuts:
        rows = _probe(rows, cut, "left")
    within = (F.row_number().over(Window.partitionBy("cell").orderBy("h", F.col("row.doc_id").asc_nulls_first())) - 1).cast("long")
    run = F.element_at(F.filter("runs", lambda r: r["start"] <= F.col("n")), -1)
    numbered = rows.withColumn("n", within).join(place, "cell").withColumn("run", run)
    return numbered.select("row.*", F.col("run.shard").alias("shard"), (F.col("run.slot") + F.col("n") - F.col("run.start")).alias("slot"), "size", F.col("crc").alias("text_crc32"))


SQL = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step
), keyed AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS below, sum(size) OVER () AS total FROM keyed
), dealt AS (SELECT *, (below * 40 // total)::INTEGER AS shard FROM placed)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard FROM dealt, steps
"""
