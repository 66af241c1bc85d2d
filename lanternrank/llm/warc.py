"""WARC records in ZIP-packaged archives, read in place.

An archive is a ZIP file whose members are stored, not compressed: a `.warc.gz`
member of one gzip member a record, and an index of offsets (`.cdxj`).
`directory` reads a ZIP's end record, its ZIP64 records and its central
directory, and locates each member's bytes; `spans` reads the index members,
walks what they leave out, in plain or gzip members, and cuts the records into ranges; `records` reads
those ranges only.  Nothing is extracted, and no task holds more than a range
and an archive's index.

Archives lie in a folder that all executors reach, and are opened by URI
(file, hdfs, s3 or gs).  A task writes archives under new names and tells them
in its rows; the table of names is written before it is used, so what a lost or
repeated task left behind is never read.

Defined cases: a null url has no target header, a null payload is empty; equal
payloads (empty ones too) have one response, of the largest page_id, and
repeated rows of that page beyond the first revisit it; null ids are the
smallest; an empty table gives no archives and no rows; a truncated archive or
record, a wrong index line or a WARC member that the ZIP compresses raises
ValueError; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MEMBERS = "path string, member string, method int, offset long, size long, crc32 long"
SPANS = "path string, offset long, lengths array<long>"
RECORD = "path string, offset long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"
NAME = "urn:page:"
#: Records of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
FULL, FULL2 = 0xFFFFFFFF, 0xFFFF


def digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


# ---- writing

def record(kind: str, record_id: str, payload: bytes, size: int, sha1: str, url: str | None, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def zip_parts(members: list[tuple[str, list]], zip64: bool = False) -> Iterator:
    """The parts of a ZIP file of stored members, each given as a list of buffers; ZIP64 records where sizes need them, or always."""
    at, central = 0, bytearray()
    for name, parts in members:
        raw, n, crc = name.encode(), sum(map(len, parts)), 0
        for part in parts:
            crc = zlib.crc32(part, crc)
        large = zip64 or n >= FULL or at >= FULL
        extra = struct.pack("<HHQQ", 1, 16, n, n) if large else b""
        head = struct.pack("<4s5HIIIHH", LOCAL, 45 if large else 20, 0x800, 0, 0, 33, crc, FULL if large else n, FULL if large else n, len(raw), len(extra)) + raw + extra
        yield head
        yield from parts
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if large else b""
        central += struct.pack("<4s6HIIIHHHHHII", CENTRAL, 45, 45 if large else 20, 0x800, 0, 0, 33, crc, FULL if large else n, FULL if large else n, len(raw), len(extra), 0, 0, 0, 0, FULL if large else at) + raw + extra
        at += len(head) + n
    n = len(members)
    yield bytes(central)
    large = zip64 or at >= FULL or n >= FULL2
    if large:
        yield struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, len(central), at)
        yield struct.pack("<4sIQI", LOCATOR, 0, at + len(central), 1)
    yield struct.pack("<4sHHHHIIH", END, 0, 0, FULL2 if large else n, FULL2 if large else n, FULL if large else len(central), FULL if large else at, 0)


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    return b"".join(zip_parts([(name, [data]) for name, data in members], zip64))


def _opened(uri: str):
    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, most: int, zip64: bool, date: str):
    def run(batches):
        where, root = _opened(folder)

        def close(data: list[bytes], index: list[dict]):
            name = f"archive-{uuid.uuid4().hex}.wacz"
            lines = "".join(json.dumps(x) + "\n" for x in index).encode()
            with where.open_output_stream(f"{root}/{name}") as f:
                for part in zip_parts([("archive/data.warc.gz", data), ("indexes/index.cdxj", [lines])], zip64):
                    f.write(part)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n": pa.array([len(index)], pa.int64())})

        data, index, held = [], [], 0
        for b in common.pieces(batches, 1 << 20, "html"):
            for page, url, html, sha1, first, leads in zip(*(b.column(c).to_pylist() for c in ("page_id", "url")), common.utf8(b.column("html")), *(b.column(c).to_pylist() for c in ("sha1", "leads_to", "leads"))):
                kind = "response" if leads else "revisit"
                raw = zlib.compress(record(kind, f"{NAME}{page}", html if leads else b"", len(html), digest(bytes.fromhex(sha1)), url, None if leads else f"{NAME}{first}", date), 6, 31)
                index.append({"offset": held, "length": len(raw), "type": kind, "url": url})
                data.append(raw)
                held += len(raw)
                if held >= most:
                    yield close(data, index)
                    data, index, held = [], [], 0
        if index:
            yield close(data, index)

    return run


def write(pages: DataFrame, archive_bytes: int = 32 << 20, zip64: bool = False, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row (page_id, url, html); returns path and n, a row an archive.

    The roles of rows are settled on ids and digests alone; the payloads are
    exchanged once, by page, so copies of one payload are spread.
    """
    spark = pages.sparkSession
    folder = common.new_path(spark, "archives")
    where, root = _opened(folder)
    where.create_dir(root)
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    # one key without nulls, so that join and numbering use the same exchange
    base = base.withColumn("key", F.concat_ws(":", "sha1", F.col("page_id").cast("string")))
    keys = base.groupBy("key", "page_id", "sha1").agg(F.count("*").alias("n"))
    last = keys.groupBy("sha1").agg(F.max("page_id").alias("leads_to"))
    roles = keys.join(last, "sha1").select("key", "leads_to")
    first = F.row_number().over(Window.partitionBy("key").orderBy("url"))
    rows = base.join(roles, "key").withColumn("leads", F.col("page_id").eqNullSafe(F.col("leads_to")) & (first == 1))
    return common.written(rows.select("page_id", "url", "html", "sha1", "leads_to", "leads").mapInArrow(_writer(folder, archive_bytes, zip64, date), "path string, n long"), "manifest", 64)


# ---- reading

def _range(f, offset: int, n: int) -> bytes:
    data = f.read_at(n, offset)
    if len(data) != n:
        raise ValueError("the archive ends too early")
    return data


def directory(f) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, method, offset of its bytes, stored size, CRC-32) of each member of an open ZIP file.

    f offers size() and read_at(n, offset).  A comment may stand at the end, and
    other data before the archive.
    """
    try:
        yield from _directory(f)
    except (struct.error, IndexError, OverflowError, OSError) as e:
        raise ValueError(f"the ZIP directory is damaged: {e}") from None


def _directory(f) -> Iterator[tuple[str, int, int, int, int]]:
    size = f.size()
    tail_at = max(0, size - 65557)
    tail = _range(f, tail_at, size - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no ZIP end record")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    n, length, start = struct.unpack_from("<10xHII", tail, at)
    end = tail_at + at
    if n == FULL2 or length == FULL or start == FULL:
        mark, _, end64, _ = struct.unpack("<4sIQI", _range(f, end - 20, 20))
        if mark != LOCATOR:
            raise ValueError("no ZIP64 locator")
        head = f.read_at(56, end64)
        if head[:4] != END64:  # data stand before the archive
            end64 = end - 20 - 56
            head = _range(f, end64, 56)
        if head[:4] != END64:
            raise ValueError("no ZIP64 end record")
        n, length, start = struct.unpack_from("<32xQQQ", head)
        end = end64
    shift = end - length - start
    if shift < 0:
        raise ValueError("the ZIP directory is damaged")
    central, pos = _range(f, start + shift, length), 0
    for _ in range(n):
        if central[pos : pos + 4] != CENTRAL:
            raise ValueError("the ZIP directory is damaged")
        method, = struct.unpack_from("<H", central, pos + 10)
        crc, packed, plain, a, b, c, _, _, _, offset = struct.unpack_from("<IIIHHHHHII", central, pos + 16)
        name = central[pos + 46 : pos + 46 + a].decode("utf-8", "replace")
        extra, k = central[pos + 46 + a : pos + 46 + a + b], 0
        while k + 4 <= len(extra):
            kind, m = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                values = list(struct.unpack_from(f"<{m // 8}Q", extra, k + 4))
                plain = values.pop(0) if plain == FULL else plain
                packed = values.pop(0) if packed == FULL else packed
                offset = values.pop(0) if offset == FULL else offset
            k += 4 + m
        local = _range(f, offset + shift, 30)
        if local[:4] != LOCAL:
            raise ValueError("a member's header is damaged")
        skip = sum(struct.unpack_from("<HH", local, 26))
        yield name, method, offset + shift + 30 + skip, packed, crc
        pos += 46 + a + b + c


def _each(of):
    """An Arrow map that opens each path of a batch once."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                where, path = _opened(row["path"])
                with where.open_input_file(path) as f:
                    yield from of(f, row)

    return run


def members(archives: DataFrame) -> DataFrame:
    """The members of each archive of a column path."""

    def of(f, row):
        rows = [(row["path"], *m) for m in directory(f)]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "member", "method", "offset", "size", "crc32"])

    return archives.select("path").mapInArrow(_each(of), MEMBERS)


def _lengths(f, offset: int, size: int, step: int = 1 << 16) -> Iterator[int]:
    """Lengths of the records in a range, gzip members or plain, where no index lists them."""
    at, end = offset, offset + size
    while at < end:
        pos = at
        if _range(f, at, min(2, end - at)) == b"\x1f\x8b":
            gz = zlib.decompressobj(31)
            while not gz.eof:
                if pos >= end:
                    raise ValueError("a record ends too early")
                data = _range(f, pos, min(step, end - pos))
                try:
                    gz.decompress(data)
                except zlib.error as e:
                    raise ValueError(f"a record is damaged: {e}") from None
                pos += len(data)
            pos -= len(gz.unused_data)
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                if pos >= end or len(head) > 1 << 20 or not head.startswith(b"WARC/"[: len(head)]):
                    raise ValueError("not a WARC record")
                data = _range(f, pos, min(step, end - pos))
                head += data
                pos += len(data)
            head = head.partition(b"\r\n\r\n")[0]
            found = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", head)
            if not head.startswith(b"WARC/") or not found:
                raise ValueError("not a WARC record")
            pos = at + len(head) + 4 + int(found[1]) + 4
            if pos > end:
                raise ValueError("a record ends too early")
        yield pos - at
        at = pos


def _lines(f, index: list) -> Iterator[tuple[str | None, int, int]]:
    """(file, offset, length) of each line of the index members: JSON, after a key and a time or alone; numbers may be strings."""
    for m in index:
        data = _range(f, m[2], m[3])
        while m[0].endswith(".gz") and data:
            gz = zlib.decompressobj(31)
            try:
                part = gz.decompress(data)
            except zlib.error as e:
                raise ValueError(f"an index is damaged: {e}") from None
            data = gz.unused_data
            yield from _parsed(part)
        if not m[0].endswith(".gz"):
            yield from _parsed(data)


def _parsed(data: bytes) -> Iterator[tuple[str | None, int, int]]:
    for line in data.splitlines():
        if line.strip() and not line.startswith(b"!"):
            try:
                x = json.loads(line[max(0, line.find(b"{")) :])
                yield x.get("filename"), int(x["offset"]), int(x["length"])
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                raise ValueError(f"an index line is wrong: {e}") from None


def _listed(f, lines: list[tuple[int, int]], offset: int, size: int) -> Iterator[int]:
    """Lengths of all records in a range: those that the index lists at its offsets, and the others as they are found between."""
    known: dict[int, int] = {}
    for at, n in lines:
        if n <= 0 or known.setdefault(at, n) != n:
            raise ValueError("an index line is wrong")
    at = 0
    for start, n in sorted(known.items()):
        if start < at or start + n > size:
            raise ValueError("an index line is wrong")
        yield from _lengths(f, offset + at, start - at)
        yield n
        at = start + n
    yield from _lengths(f, offset + at, size - at)


def spans(archives: DataFrame, span_bytes: int = 4 << 20) -> DataFrame:
    """Ranges of whole records: path, offset and the lengths of the records that follow one another there."""

    def of(f, row):
        found = list(directory(f))
        data = [m for m in found if m[0].endswith((".warc.gz", ".warc"))]
        if any(m[1] for m in data):
            raise ValueError("a WARC member is compressed by the archive, so its records have no ranges")
        listed: dict[str, list[tuple[int, int]]] = {}
        for file, at, n in _lines(f, [m for m in found if m[0].endswith((".cdxj", ".cdx.gz", ".cdxj.gz")) and m[1] == 0]):
            if file is None and len(data) > 1:
                raise ValueError("an index line names no file, and there are several")
            listed.setdefault((file or data[0][0]).rpartition("/")[2] if data else "", []).append((at, n))
        for name, _, offset, size, _ in data:
            lengths = _listed(f, listed.get(name.rpartition("/")[2], []), offset, size)
            at, held, total = offset, [], 0
            for n in lengths:
                held.append(n)
                total += n
                if total >= span_bytes:
                    yield pa.RecordBatch.from_pydict({"path": [row["path"]], "offset": [at], "lengths": pa.array([held], pa.list_(pa.int64()))})
                    at, held, total = at + total, [], 0
            if held:
                yield pa.RecordBatch.from_pydict({"path": [row["path"]], "offset": [at], "lengths": pa.array([held], pa.list_(pa.int64()))})

    return archives.select("path").mapInArrow(_each(of), SPANS)


def parse(raw: bytes) -> dict:
    """One record: headers that matter here and its payload, checked against lengths and digest."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    h = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if len(rest) != len(block) + 4 or len(block) != int(h["content-length"]):
        raise ValueError("a record's length is wrong")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}
    kind, found = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if digest(hashlib.sha1(payload).digest()) != found:
            raise ValueError("a payload's digest is wrong")
    url = h.get("warc-target-uri")
    return {
        "record_type": kind, "record_id": h["warc-record-id"].strip("<>"), "refers_to": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None,
        "target_uri": url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if url is not None else None, "payload_digest": found,
        "payload_bytes": len(payload) if kind == "response" else int(fields["content-length"]), "payload": payload if kind == "response" else None,
    }


def records(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of each range, with or without their payloads; a revisit has none."""
    schema = T._parse_datatype_string(RECORD)
    schema = schema if payloads else T.StructType(schema.fields[:-1])

    def of(f, row):
        raw, at, rows = _range(f, row["offset"], sum(row["lengths"])), 0, []
        for n in row["lengths"]:
            part = raw[at : at + n]
            try:
                text = zlib.decompress(part, 31) if part[:2] == b"\x1f\x8b" else part
            except zlib.error as e:
                raise ValueError(f"a record is damaged: {e}") from None
            found = {"path": row["path"], "offset": row["offset"] + at} | parse(text)
            rows.append({name: found[name] for name in schema.names})
            at += n
        kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array([r[x.name] for r in rows], kinds[x.dataType]) for x in schema.fields], names=schema.names)

    return ranges.mapInArrow(_each(of), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, as read back from its archive."""
    ranges = common.written(spans(write(pages)), "spans", 64)
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = records(ranges.repartition(tasks, "path", "offset"), payloads=False)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(NAME) + 1}) AS BIGINT)")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
ranked AS (
  SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS s, row_number() OVER newest AS k, first_value(page_id) OVER newest AS newest
  FROM payloads WINDOW newest AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST)
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN newest END AS refers_to
FROM ranked
"""
