"""TIFF as a media column: encode sample blocks, walk image directories, one row per page.

Baseline TIFF 6.0 in both byte orders, strips or tiles, compression none, LZW, deflate or PackBits,
predictors none or horizontal differencing, samples of 8 or 16 bits, chunky or planar, both fill orders.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import batches_of

# Fixed values of the TIFF 6.0 specification: tags, types and compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, END, FIRST = 256, 257, 258

#: Samples in a row of an encoded payload.
ROW = 64
#: Bytes in a strip, about; samples along a tile's side; rows in a page at most.
STRIP = 1 << 16
TILE = 64
PAGE_ROWS = 4096
_turned = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CHUNK = 1 << 22


def packbits_encode(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    runs = np.diff(np.r_[starts, len(a)])
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            piece = data[i : min(i + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for i in np.flatnonzero(runs >= 3).tolist():
        s, n = int(starts[i]), int(runs[i])
        literal(s)
        at = s
        while n > 1:
            k = min(n, 128)
            out += bytes((257 - k, data[s]))
            n, at = n - k, at + k
    literal(len(a))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early as TIFF does."""
    codes, widths, table, following, width = [CLEAR], [9], {}, FIRST, 9
    word = None
    for c in data:
        if word is None:
            word = c
            continue
        longer = word << 8 | c
        if (known := table.get(longer)) is not None:
            word = known
            continue
        codes.append(word)
        widths.append(width)
        table[longer] = following
        following += 1
        if following == 4094:
            codes.append(CLEAR)
            widths.append(width)
            table, following, width = {}, FIRST, 9
        elif following + 1 > 1 << width:
            width += 1
        word = c
    if word is not None:
        codes.append(word)
        widths.append(width)
        if following + 2 > 1 << width and width < 12:
            width += 1
    w = np.array([*widths, width])
    ends = np.cumsum(w)
    bits = np.repeat(np.array([*codes, END]), w) >> (np.repeat(ends, w) - 1 - np.arange(ends[-1])) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


#: Widths of the codes after a CLEAR, and where each begins.
_WIDTHS = np.array([9, *(max(9, min(12, (258 + i).bit_length())) for i in range(1, 4096))])
_STARTS = np.cumsum(_WIDTHS) - _WIDTHS
_SINGLE = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    at, end, out, made = 0, 8 * len(data), [], 0
    while made < size:
        n = int(np.searchsorted(_STARTS + _WIDTHS, end - at, "right"))  # codes that are there, if none of them clears
        begin, width = at + _STARTS[:n], _WIDTHS[:n]
        byte = begin >> 3
        codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (begin & 7) - width) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if len(stops) else n
        table, last = _SINGLE.copy(), b""
        for code in codes[:stop].tolist():
            if not last:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
            made += len(entry)
            if made >= size:
                break
        if stop == n or codes[stop] == END:
            break
        at += int(_STARTS[stop] + _WIDTHS[stop])
    return b"".join(out)[:size]


def compress(data: bytes, scheme: int, level: int = 6) -> bytes:
    if scheme == PACKBITS:
        return packbits_encode(data)
    if scheme == LZW:
        return lzw_encode(data)
    return zlib.compress(data, level) if scheme in (DEFLATE, OLD_DEFLATE) else data


def expand(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == PACKBITS:
        return packbits_decode(data, size)
    if scheme == LZW:
        return lzw_decode(data, size)
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size) if size else b""  # never more than is wanted
    if scheme == NONE:
        return data[:size]
    raise ValueError(f"compression {scheme} is not supported")


def differences(block: np.ndarray) -> np.ndarray:
    """Horizontal predictor over (rows, columns, samples)."""
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def write_tiff(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 1, strip_bytes: int = STRIP, tile: int = 0, order: str = "<", planar: bool = False, fill: int = 1) -> bytes:
    """A TIFF of pages (rows, columns[, samples]) of 8 or 16 bits, in strips or in square tiles of ``tile`` samples (a multiple of 16).

    ``planar`` stores each sample's plane by itself; ``fill`` 2 stores bytes with their bits turned.
    """
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        p = page.reshape(*page.shape[:2], -1)
        high, wide, deep = p.shape
        kind = np.dtype(p.dtype).newbyteorder(order)
        blocks = []
        for q in [p[:, :, i : i + 1] for i in range(deep)] if planar else [p]:
            rows = tile or max(1, strip_bytes // max(1, wide * q.shape[2] * kind.itemsize))
            for y in range(0, high, rows):
                if not tile:
                    blocks.append(q[y : y + rows])
                    continue
                for x in range(0, wide, tile):
                    part = q[y : y + tile, x : x + tile]
                    blocks.append(np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0))))
        offsets, counts = [], []
        for b in blocks:
            data = compress((differences(b) if predictor == 2 else b).astype(kind).tobytes(), scheme)
            offsets.append(len(out))
            counts.append(len(data))
            out += (data.translate(_turned) if fill == 2 else data) + b"\0" * (len(data) % 2)
        tags = {WIDTH: [wide], LENGTH: [high], BITS: [8 * kind.itemsize] * deep, COMPRESSION: [scheme], PHOTOMETRIC: [2 if deep == 3 else 1], FILL_ORDER: [fill], SAMPLES: [deep], PLANAR: [2 if planar else 1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile], TILE_LENGTH: [tile], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [rows], STRIP_COUNTS: counts}
        entries = []
        for tag, values in sorted(tags.items()):
            t = 3 if tag in (BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, SAMPLES, PLANAR, PREDICTOR) else 4
            raw = struct.pack(f"{order}{len(values)}{TYPES[t]}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, t, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    data: np.ndarray


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    """Tags of the image directory at ``at``, and where the next one is."""
    count = struct.unpack_from(order + "H", data, at)[0]
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in TYPES:
            continue
        form = f"{order}{n}{TYPES[kind]}"
        where = at + 10 + 12 * i
        if struct.calcsize(form) > 4:
            where = struct.unpack_from(order + "I", data, where)[0]
        tags[tag] = struct.unpack_from(form, data, where)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _page(data: bytes, order: str, tags: dict[int, tuple], number: int) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    wide, high, deep = tags[WIDTH][0], tags[LENGTH][0], one(SAMPLES, 1)
    bits, scheme, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2
    if bits not in (8, 16) or len(set(tags[BITS])) > 1:
        raise ValueError(f"samples of {tags.get(BITS, (1,))} bits are not supported")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not supported")
    kind = np.dtype(np.uint8 if bits == 8 else np.uint16)
    tiled = TILE_OFFSETS in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]) if tiled else (wide, min(high, one(ROWS_PER_STRIP, high)))
    across, down = (-(-wide // bw) if bw else 0), (-(-high // bh) if bh else 0)
    own = 1 if planar else deep
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    if min(len(offsets), len(counts)) < across * down * (deep if planar else 1):
        raise ValueError("strips or tiles are missing")
    page = np.zeros((high, wide, deep), kind)
    for i in range(across * down * (deep if planar else 1)):
        plane, place = divmod(i, across * down)
        y, x = place // across * bh, place % across * bw
        rows = bh if tiled else min(bh, high - y)
        packed = bytes(data[offsets[i] : offsets[i] + counts[i]])
        raw = expand(packed.translate(_turned) if one(FILL_ORDER, 1) == 2 else packed, scheme, rows * bw * own * kind.itemsize)
        if len(raw) < rows * bw * own * kind.itemsize:
            raise ValueError("a strip or tile is cut off")
        block = np.frombuffer(raw, kind.newbyteorder(order)).astype(kind).reshape(rows, bw, own)
        if predictor == 2:
            block = np.cumsum(block, 1, dtype=kind)
        page[y : y + rows, x : x + bw, plane : plane + own] = block[: high - y, : wide - x]
    return Page(number, wide, high, deep, bits, scheme, predictor, page)


def read_tiff(data: bytes) -> Iterator[Page]:
    """Pages of a TIFF, by its chain of image directories. Files that are cut off, damaged, of an unsupported kind, or whose chain returns to a directory raise a ValueError that names the fault."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen, number = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        try:
            tags, at = _directory(data, order, at)
            page = _page(data, order, tags, number)
        except struct.error as e:
            raise ValueError("an image directory is cut off") from e
        except KeyError as e:
            raise ValueError(f"an image directory lacks tag {e}") from e
        except (zlib.error, IndexError, MemoryError) as e:
            raise ValueError(f"a strip or tile is damaged: {e}") from e
        yield page
        number += 1


def payload(text: str | None, row: int = ROW) -> bytes:
    """UTF-8 of a text (null: none) with bytes 0 up to a positive multiple of ``row``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % row if raw else row)


def layout_for(data: bytes) -> dict:
    """Codec, predictor, strips or tiles, and byte order of a payload, by its hash and whatever its size: each has its share of all bytes."""
    h = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")
    return {"scheme": (PACKBITS, LZW, DEFLATE)[h % 3], "predictor": 1 + (h >> 16) % 2, "tile": TILE * ((h >> 24) % 2), "order": "<>"[(h >> 32) % 2]}


def encode_texts(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_bytes, media)``: a TIFF of each text's padded UTF-8, 64 samples wide, PAGE_ROWS rows a page.

    Null and empty texts are a row of zeros; texts of any length are stored whole. Equal texts give equal
    bytes. Rows keep order and repeats, a null doc_id stays null, an empty table gives an empty result,
    further columns, whatever their names, are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in batches_of(batch, "text", CHUNK):
                sizes, media = [], []
                for text in part.column(1).to_pylist():
                    data = payload(text)
                    sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                    rows = np.frombuffer(data, np.uint8).reshape(-1, ROW)
                    media.append(write_tiff([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], **layout_for(data)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(run, StructType([StructField("doc_id", kind), StructField("n_bytes", LongType()), StructField("media", BinaryType())]))


def feature(samples: np.ndarray) -> str:
    """Eight shares of sample values per mille, then a 64-bit hash of which of 64 equal stretches are brighter than the mean."""
    flat = samples.reshape(-1)
    shares = np.bincount(flat >> (flat.dtype.itemsize * 8 - 3), minlength=8) * 1000 // max(1, len(flat))
    cuts = np.linspace(0, len(flat), 65).astype(np.int64)
    sums = np.add.reduceat(flat.astype(np.int64), np.minimum(cuts[:-1], len(flat) - 1)) if len(flat) else np.zeros(64, np.int64)
    bright = sums * len(flat) > int(flat.sum(dtype=np.int64)) * np.maximum(1, np.diff(cuts))
    return ".".join(map(str, shares)) + ":" + np.packbits(bright).tobytes().hex()


PAGE = [("page", IntegerType()), ("width", LongType()), ("height", LongType()), ("samples", IntegerType()), ("bits", IntegerType()), ("compression", IntegerType()), ("predictor", IntegerType()), ("feature", StringType()), ("data", BinaryType()), ("fault", StringType())]


def tiff_pages(media: DataFrame, column: str = "media", strict: bool = True) -> DataFrame:
    """One row per page of each row's TIFF, in order: the other columns, page, width, height, samples, bits, compression, predictor, feature, data, fault.

    A null has no pages; repeated rows have theirs each. A TIFF that is damaged or of an unsupported kind
    raises an error that names its fault; without ``strict`` it gives the pages before the damage and a row
    that has nothing but the other columns and ``fault``. Columns of ``media`` called like one of these are
    replaced. An empty table gives an empty result.
    """
    names = [n for n, _ in PAGE]
    fields = [f for f in media.schema.fields if f.name != column and f.name not in names]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]

    def rows_of(data: bytes) -> Iterator[tuple]:
        try:
            for p in read_tiff(data):
                yield (p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, feature(p.data), p.data.tobytes(), None)
        except ValueError as e:
            if strict:
                raise
            yield (*[None] * 9, str(e))

    def batch_of(part, own, rows):
        kept = part.select([f.name for f in fields]).take(pa.array(own, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[*(f.name for f in fields), *names])

    def run(batches):
        for batch in batches:
            for part in batches_of(batch, column, CHUNK):
                own, rows, size = [], [], 0
                for i, data in enumerate(part.column(part.schema.get_field_index(column))):
                    for row in rows_of(data.as_py()) if data.is_valid else ():
                        own.append(i)
                        rows.append(row)
                        size += len(row[8] or b"")
                        if size >= CHUNK:
                            yield batch_of(part, own, rows)
                            own, rows, size = [], [], 0
                if rows:
                    yield batch_of(part, own, rows)

    return media.select(*[f.name for f in fields], column).mapInArrow(run, StructType([*fields, *(StructField(n, t) for n, t in PAGE)]))


def payload_digests(pages: DataFrame) -> DataFrame:
    """Rows of ``tiff_pages``, as they come, folded to one row per TIFF: the other columns, pages, payload_bytes, payload_sha256, tail_crc32, feature, compression, predictor.

    The payload is the pages' samples, one page after the other; a page 0 begins a new one. No shuffle. A
    payload is held whole, as its text was.
    """
    names = [n for n, _ in PAGE]
    fields = [f for f in pages.schema.fields if f.name not in names]
    made = [("pages", IntegerType()), ("payload_bytes", LongType()), ("payload_sha256", StringType()), ("tail_crc32", LongType()), ("feature", StringType()), ("compression", IntegerType()), ("predictor", IntegerType())]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()]

    def digest(row: tuple) -> tuple:
        first, parts, scheme, predictor = row
        data = parts[0] if len(parts) == 1 else b"".join(parts)
        return (len(parts), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), feature(np.frombuffer(data, np.uint8)), scheme, predictor)

    def run(batches):
        now = None
        for batch in batches:
            held = batch.select([f.name for f in fields])
            firsts, done = [], []
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            for i, (number, scheme, predictor, data) in enumerate(zip(column("page").to_pylist(), column("compression").to_pylist(), column("predictor").to_pylist(), column("data"))):
                if not number:
                    if now:
                        firsts.append(now[0])
                        done.append(digest(now))
                    now = (held.slice(i, 1), [], scheme, predictor)
                now[1].append(data.as_py())
            if done:
                yield _joined(firsts, done)
        if now:
            yield _joined([now[0]], [digest(now)])

    def _joined(firsts, done):
        own = pa.Table.from_batches(firsts).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, k) for c, k in zip(zip(*done), kinds))], names=[*(f.name for f in fields), *(n for n, _ in made)])

    return pages.mapInArrow(run, StructType([*fields, *(StructField(n, t) for n, t in made)]))
