"""TIFF media columns: walk image directories, decode, one row a page.

Reads classic and big files of either byte order: strips and tiles, chunky and
planar samples of 1 to 64 bits; no compression, PackBits, LZW and deflate; no,
horizontal and floating-point prediction.  `encode` writes the files that the
query stores.

Defined cases: a null or empty media value has no pages; a damaged file raises
ValueError, whatever is damaged, or with `strict=False` has no pages; so does a
page that declares more samples than its data could give, before any memory is
taken for it; a directory chain that loops ends where it would repeat; repeated rows are read one by one; an empty table
gives an empty result; columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Field types of the format: number to numpy type.
TYPES = {1: "u1", 2: "u1", 3: "u2", 4: "u4", 5: "u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 10: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
PAGE_ROWS, WIDTH = 1024, 192


# ---- compression

def packbits_decode(data: bytes, most: int | None = None) -> bytes:
    out, i, n, held = [], 0, len(data), 0
    while i < n and (most is None or held < most):
        c = data[i]
        if c < 128:
            part = data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            part = data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            part = b""
            i += 1
        out.append(part)
        held += len(part)
    return b"".join(out)


RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    """One row: the format packs each row by itself."""
    out, at = [], 0

    def literal(a, b):
        for k in range(a, b, 128):
            part = data[k : min(k + 128, b)]
            out.append(bytes([len(part) - 1]) + part)

    for m in RUN.finditer(data):
        literal(at, m.start())
        out.append(bytes([257 - (m.end() - m.start())]) + m[1])
        at = m.end()
    literal(at, len(data))
    return b"".join(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, high bit first, one code early; 256 clears and 257 ends."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, prior, made = base[:], [], b"", 0
    held, bits, width = 0, 0, 9
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, prior, width = base[:], b"", 9
            continue
        if code == 257 or most is not None and made >= most:
            break
        size = len(table)
        if code > size or code == size and not prior:
            raise ValueError("LZW code out of order")
        word = table[code] if code < size else prior + prior[:1]
        if prior:
            table.append(prior + word[:1])
            size += 1
            width = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12
        out.append(word)
        made += len(word)
        prior = word
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code):
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    width = 9
    put(256)
    table: dict[int, int] = {}  # code of a string << 8 | its next byte -> the longer string's code
    following, code = 258, -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        key = code << 8 | byte
        longer = table.get(key)
        if longer is not None:
            code = longer
            continue
        put(code)
        table[key] = following
        following += 1
        code = byte
        if following == 4094:
            width = 12
            put(256)
            table, following, width = {}, 258, 9
        elif following in WIDER:
            width += 1
    if code >= 0:
        put(code)
        if following + 1 in WIDER:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


#: Table sizes from which codes are one bit longer.
WIDER = (512, 1024, 2048)
#: Bytes that a byte of compressed data gives at most.
EXPANDS = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}


def decompress(data: bytes, kind: int, most: int) -> bytes:
    """The first `most` bytes or a few more of what a block holds."""
    if kind == NONE:
        return data
    if kind == PACKBITS:
        return packbits_decode(data, most)
    if kind == LZW:
        return lzw_decode(data, most)
    if kind in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, max(1, most))
        except zlib.error as e:
            raise ValueError(f"damaged deflate data: {e}") from None
    raise ValueError(f"compression {kind} is not read")


# ---- reading

def directories(data: bytes) -> Iterator[tuple[str, dict[int, np.ndarray]]]:
    """(byte order, tags) of each image directory in its chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        raise ValueError("not a TIFF file")
    magic = struct.unpack(order + "H", data[2:4])[0]
    big = magic == 43
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    number, entry, room = ("Q", 20, 8) if big else ("I", 12, 4)
    pointer = lambda at: struct.unpack_from(order + number, data, at)[0]
    at, seen = pointer(8 if big else 4), set()
    try:
        while at and at not in seen:
            seen.add(at)
            n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
            first = at + (8 if big else 2)
            tags = {}
            for k in range(n):
                here = first + k * entry
                tag, kind = struct.unpack_from(order + "HH", data, here)
                count = pointer(here + 4)
                if kind not in TYPES:
                    continue
                count *= 2 if kind in (5, 10) else 1
                dtype = np.dtype(order + TYPES[kind])
                value = here + entry - room
                tags[tag] = np.frombuffer(data, dtype, count, value if count * dtype.itemsize <= room else pointer(value))
            yield order, tags
            at = pointer(first + n * entry)
    except struct.error as e:
        raise ValueError(f"damaged directory: {e}") from None


def _samples(raw: bytes, rows: int, width: int, spp: int, bits: int, fmt: int, predictor: int, order: str) -> np.ndarray:
    """A block as rows x width x samples, prediction undone."""
    per_row = width * spp
    if bits < 8 or bits not in (8, 16, 32, 64):
        line = (per_row * bits + 7) // 8
        flat = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : per_row * bits]
        weights = 1 << np.arange(bits - 1, -1, -1)
        return (flat.reshape(rows, per_row, bits) @ weights).astype("u1" if bits <= 8 else "u4").reshape(rows, width, spp)
    size = bits // 8
    if predictor == 3:
        line = np.frombuffer(raw, np.uint8, rows * per_row * size).reshape(rows, width * size, spp)
        line = np.add.accumulate(line, axis=1, dtype=np.uint8).reshape(rows, size, per_row)
        return np.ascontiguousarray(line.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, width, spp)
    kind = {1: "u", 2: "i", 3: "f"}.get(fmt, "u")
    out = np.frombuffer(raw, np.dtype(f"{order}{'u' if predictor == 2 else kind}{size}"), rows * per_row).reshape(rows, width, spp)
    if predictor == 2:
        out = np.add.accumulate(out.astype(f"u{size}"), axis=1, dtype=f"u{size}").view(f"{kind}{size}")
    return out


def pages(data: bytes) -> Iterator[tuple[dict[str, int], np.ndarray]]:
    """(facts, samples as rows x columns x channels) of each page; any damage raises ValueError."""
    try:
        yield from _pages(data)
    except (struct.error, IndexError, KeyError, TypeError, ZeroDivisionError, OverflowError, MemoryError) as e:
        raise ValueError(f"damaged file: {e}") from None


def _pages(data: bytes) -> Iterator[tuple[dict[str, int], np.ndarray]]:
    for order, tags in directories(data):
        one = lambda tag, default: int(tags[tag][0]) if tag in tags and len(tags[tag]) else default  # noqa: B023, E731
        width, height, spp, bits = one(256, 0), one(257, 0), one(277, 1), one(258, 1)
        kind, predictor, planar, fmt = one(259, NONE), one(317, 1), one(284, 1), one(339, 1)
        tiled = 324 in tags
        offsets, lengths = tags.get(324 if tiled else 273), tags.get(325 if tiled else 279)
        if offsets is None or lengths is None or not width or not height:
            raise ValueError("a page lacks its size, offsets or lengths")
        bw, bh = (one(322, width), one(323, height)) if tiled else (width, min(one(278, height), height))
        across, down = -(-width // bw), -(-height // bh)
        planes, deep = (spp, 1) if planar == 2 else (1, spp)
        if min(len(offsets), len(lengths)) < across * down * planes:
            raise ValueError("a page lacks blocks")
        if not 0 < bits <= 64 or spp < 1 or bw < 1 or bh < 1 or kind not in EXPANDS:
            raise ValueError("a page's form is not read")
        if -(-width * spp * bits // 8) * height > EXPANDS[kind] * sum(min(int(n), len(data)) for n in lengths[: across * down * planes]) + 64:
            raise ValueError("a page declares more than its data can hold")
        image = None
        for k in range(across * down * planes):
            plane, (row, col) = k // (across * down), divmod(k % (across * down), across)
            a = int(offsets[k])
            rows = bh if tiled else min(bh, height - row * bh)
            raw = decompress(data[a : a + int(lengths[k])], kind, -(-bw * deep * bits // 8) * rows)
            try:
                block = _samples(raw, rows, bw, deep, bits, fmt, predictor, order)
            except ValueError as e:
                raise ValueError(f"a block is too short: {e}") from None
            if image is None:
                image = np.empty((height, width, spp), block.dtype.newbyteorder("="))
            y, x = row * bh, col * bw
            part = block[: height - y, : width - x]
            image[y : y + part.shape[0], x : x + part.shape[1], slice(None) if planar != 2 else slice(plane, plane + 1)] = part
        yield {"width": width, "height": height, "samples": spp, "bits": bits, "compression": kind, "predictor": predictor, "tiled": int(tiled)}, image


def read(df: DataFrame, media: str = "media", pixels: bool = True, strict: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """A row for each page of each file of df, in order: its columns but media, page, pages (of the file), facts and, if asked for, pixels (big-endian bytes)."""
    facts = ("width", "height", "samples", "bits", "compression", "predictor", "tiled")
    names = ["page", "pages", *facts, *(["pixels"] if pixels else [])]
    keep = [c for c in df.columns if c not in (media, *names)]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, T.BinaryType() if n == "pixels" else T.LongType()) for n in names)])

    def found(data):
        """(number of pages, facts, samples) of each page."""
        try:
            n = sum(1 for _ in directories(data)) if data else 0
            if not strict:
                for _ in pages(data) if data else ():  # a damaged file has no pages at all
                    pass
            yield from ((n, f, image) for f, image in (pages(data) if data else ()))
        except ValueError:
            if strict:
                raise

    def run(batches):
        for b in common.pieces(batches, column=media):
            rows, where, held = [], [], 0

            def batch():
                chosen = b.take(pa.array(where, pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays([*(chosen.column(c) for c in keep), *(pa.array([r[n] for r in rows], pa.binary() if n == "pixels" else pa.int64()) for n in names)], names=schema.names)  # noqa: B023

            for i in range(b.num_rows):
                for k, (n, f, image) in enumerate(found(b.column(media)[i].as_py())):
                    where.append(i)
                    rows.append({"page": k, "pages": n, **f} | ({"pixels": image.astype(image.dtype.newbyteorder(">")).tobytes()} if pixels else {}))
                    held += image.nbytes
                    if held > batch_bytes:
                        yield batch()
                        rows, where, held = [], [], 0
            yield batch()

    return df.select(*keep, media).mapInArrow(run, schema)


# ---- writing

def _predict(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def write(image: list[np.ndarray], kind: int, predictor: int, tile: tuple[int, int] | None, strip_rows: int) -> bytes:
    """A little-endian file of 8-bit grey pages (rows x columns)."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    rowwise = lambda block: b"".join(packbits_encode(row.tobytes()) for row in block)
    packed = {NONE: lambda x: x.tobytes(), PACKBITS: rowwise, LZW: lambda x: lzw_encode(x.tobytes()), DEFLATE: lambda x: zlib.compress(x.tobytes(), 4)}[kind]
    for page in image:
        height, width = page.shape
        bh, bw = tile or (strip_rows, width)
        offsets, lengths = [], []
        for y in range(0, height, bh):
            for x in range(0, width, bw):
                block = page[y : y + bh, x : x + bw]
                if tile and block.shape != tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1])))
                data = packed(_predict(block) if predictor == 2 else block)
                offsets.append(len(out))
                lengths.append(len(data))
                out += data + b"\0" * (len(data) & 1)
        tags = [(256, [width]), (257, [height]), (258, [8]), (259, [kind]), (262, [1]), (277, [1]), (284, [1]), (317, [predictor])]
        tags += [(322, [bw]), (323, [bh]), (324, offsets), (325, lengths)] if tile else [(273, offsets), (278, [bh]), (279, lengths)]
        entries = []
        for tag, values in sorted(tags):
            data = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                at = len(out)
                out += data
                data = struct.pack("<I", at)
            entries.append(struct.pack("<HHI", tag, 4, len(values)) + data)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def encode(text: bytes) -> bytes:
    """The text's payload as a file; the form follows from a hash of the payload, so that equal texts give equal files and all forms occur at every size.

    Of the 32 forms a quarter is PackBits, a quarter LZW and a half deflate,
    each half in strips and half in tiles; of LZW and deflate (the format
    predicts for these) half is predicted.
    """
    payload = text + b" " * (-len(text) % WIDTH or (0 if text else WIDTH))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    image = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    form = zlib.crc32(payload) % 32
    kind = (PACKBITS, LZW, DEFLATE, DEFLATE)[form % 4]
    return write(image, kind, 2 if form & 8 and kind != PACKBITS else 1, (64, 64) if form & 4 else None, 64)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the stored form of each text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches):
        for b in common.pieces(batches):
            texts = common.utf8(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(t) for t in texts], pa.binary())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def feature(n_pages: int, counts: np.ndarray) -> str:
    """Pages, distinct values, and the share per thousand of samples in eight equal ranges; counts by sample value."""
    shares = counts.reshape(8, 32).sum(axis=1) * 1000 // max(1, int(counts.sum()))
    return f"{n_pages};{int((counts > 0).sum())};" + ",".join(map(str, shares))


def digests(df: DataFrame) -> DataFrame:
    """Columns of df but media, and what the pages of each file, as `read` gives them, hold; one row a file that has pages.

    `read` gives a file's pages one after another and without an exchange, so a
    task folds them as they come and holds one batch of pages.
    """
    fields = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    keep = [c for c in df.columns if c != "media" and c not in dict(fields) and c not in ("page", "pages", "pixels")]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        sha = counts = size = tail = None
        for b in batches:
            rows, where = [], []
            columns = zip(*(b.column(c).to_pylist() for c in ("page", "pages", "pixels", "media_bytes", "media_sha256")))
            for i, (page, n, pixels, media_bytes, media_sha256) in enumerate(columns):
                if page == 0:
                    sha, counts, size, tail = hashlib.sha256(), np.zeros(256, np.int64), 0, b""
                sha.update(pixels)
                counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
                size, tail = size + len(pixels), (tail + pixels[-16:])[-16:]
                if page == n - 1:
                    where.append(i)
                    rows.append((size, sha.hexdigest(), zlib.crc32(tail), media_bytes, media_sha256, feature(n, counts)))
            chosen = b.take(pa.array(where, pa.int64()))
            cols = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([*(chosen.column(c) for c in keep), *(pa.array(list(c), pa.int64() if t == T.LongType() else pa.string()) for c, (_, t) in zip(cols, fields))], names=schema.names)

    form = df.select(*keep, "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    pages_ = read(form).select(*keep, "page", "pages", "pixels", "media_bytes", "media_sha256")
    return pages_.mapInArrow(run, schema)
