"""WARC archives: write captures as request, response and metadata records, read them, join them.

An archive is written by Spark's text writer, whose lines are whole records and whose line separator is
the blank lines after a record; any file system, task retries and the commit protocol are Spark's. It is
read as binary files by record lengths. Files are bounded by rows for each class of payload sizes, so by bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, materialize, scratch_path

#: Classes of payloads: the largest one in bytes, and how many pages of the class one archive file holds at most.
FILE_PAGES = ((1 << 16, 4_000), (1 << 22, 64), (None, 1))
#: Smallest payload, in bytes, for which a revisit record pays.
REVISIT_BYTES = 1000
#: A record that many others refer to meets them in so many parts.
SALTS = 8
CRLF = "\r\n"
RECORDS = "record_id string, record_type string, concurrent_to string, refers_to_id string, target_uri string, payload_bytes long, payload_digest string, stated_bytes long, stated_digest string, fields string, payload binary"


def record_id(kind: str, *columns: str):
    """A record id that the given columns decide."""
    h = F.md5(F.concat_ws(":", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _bytes(text):
    return text.cast("binary")


def _length(binary):
    return F.octet_length(binary).cast("string")


def numbered_pages(pages: DataFrame) -> DataFrame:
    """``(row, page_id, url, payload, size, sha1)`` of each row of ``pages(page_id, url, html)``, written down: the numbers stay what they are.

    Rows that are equal in all columns differ in their number, so every row has records of its own.
    """
    page = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), _bytes(F.coalesce("html", F.lit(""))).alias("payload"))
    return materialize(page.select(F.monotonically_increasing_id().alias("row"), "*", F.octet_length("payload").alias("size"), F.sha1("payload").alias("sha1")), "pages", "zstd")


def capture_records(numbered: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Rows ``(size, record binary)``: request, response or revisit, and metadata of each numbered page, each whole without its last blank lines.

    Of pages with equal payloads of ``min_bytes`` at least, those with the largest page_id are responses
    and others revisit them. A repeated largest page_id keeps a response for each of its rows, of which revisits
    name one. A null page_id sorts before all others; a null html is an empty payload; a null url is an empty
    URI. The metadata record carries the page_id, percent-encoded; of a null one it has no field.

    Only digests of payloads that occur under two ids or more are joined to the pages, by a sort-merge
    join whose hot digests Spark splits.
    """
    keys = numbered.where(F.col("size") >= min_bytes).select("sha1", "page_id", "row")
    latest = F.max(F.struct("page_id", "row"))
    last = keys.groupBy("sha1").agg(latest.alias("last"), F.min(F.struct("page_id")).alias("least")).where(~F.col("least.page_id").eqNullSafe(F.col("last.page_id")))
    last = last.select("sha1", F.col("last.page_id").alias("last_id"), F.col("last.row").alias("last_row"))
    page = numbered.join(last, "sha1", "left").withColumn("revisit", F.col("last_row").isNotNull() & (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("last_id")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    block = F.concat(_bytes(http), F.when(F.col("revisit"), _bytes(F.lit(""))).otherwise(F.col("payload")))
    capture = record_id("capture", "row", "sha1")
    head = lambda kind, rid, *more: F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: <"), rid, F.lit(f">{CRLF}WARC-Date: 2024-01-01T00:00:00Z{CRLF}"), *more)
    uri = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " "), F.lit(CRLF))
    sized = lambda kind, b: F.concat(F.lit(f"Content-Type: {kind}{CRLF}Content-Length: "), _length(b), F.lit(CRLF * 2))
    beside = F.concat(F.lit("WARC-Concurrent-To: <"), capture, F.lit(f">{CRLF}"))
    refers = F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <"), record_id("capture", "last_row", "sha1"), F.lit(f">{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"))).otherwise(F.lit(""))
    asked = _bytes(F.lit(f"GET / HTTP/1.1{CRLF}Accept: text/html{CRLF * 2}"))
    known = _bytes(F.coalesce(F.concat(F.lit("pageId: "), F.url_encode(F.col("page_id").cast("string")), F.lit(CRLF)), F.lit(f"via: {CRLF}")))
    records = F.array(
        F.concat(_bytes(head(F.lit("request"), record_id("request", "row", "sha1"), uri, beside, sized("application/http; msgtype=request", asked))), asked),
        F.concat(_bytes(head(F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), capture, uri, F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(CRLF), refers, sized("application/http; msgtype=response", block))), block),
        F.concat(_bytes(head(F.lit("metadata"), record_id("metadata", "row", "sha1"), uri, beside, sized("application/warc-fields", known))), known),
    )
    return page.select("size", F.explode(records).alias("record"))


def write_archives(records: DataFrame, path: str, file_records: int) -> None:
    """Add rows ``(record binary)`` to the folder as gzip-compressed WARC files of ``file_records`` records at most."""
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def write_pages(pages: DataFrame, path: str, min_bytes: int = REVISIT_BYTES, classes: tuple = FILE_PAGES) -> None:
    """Write ``pages`` to archives: pages of each class of sizes go to files of their own, so that a file's bytes are bounded."""
    numbered = numbered_pages(pages)
    records = capture_records(numbered, min_bytes)
    largest = numbered.agg(F.max("size").alias("n")).first()["n"] or 0
    least = -1
    for most, files in classes:
        write_archives(records.where(F.col("size") > least if most is None else F.col("size").between(least + 1, most)), path, 3 * files)
        if most is None or largest <= most:
            break
        least = most
    drop_stored(numbered)


_HEADER = re.compile(rb"\r\n\r\n")


def _inflated(data: bytes | memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of a file's content; gzip members of any number, or plain bytes. Offsets walk the file, nothing of it is copied twice."""
    view, at = memoryview(data).cast("B"), 0
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[i : i + step]) for i in range(0, len(view), step))
        return
    while at < len(view):
        d = zlib.decompressobj(31)
        while not d.eof:
            if at >= len(view):
                raise ValueError("a gzip member of a WARC file is cut off")
            fed = view[at : at + step]
            try:
                piece = d.decompress(fed)
            except zlib.error as e:
                raise ValueError(f"a gzip member of a WARC file is damaged: {e}") from e
            at += len(fed) - len(d.unused_data)
            yield piece


def parse_archive(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a WARC file, one at a time."""
    buffer, pieces, at = bytearray(), _inflated(data), 0

    def fill(n: int) -> bool:
        """Whether ``n`` bytes from ``at`` on are there; what lies before ``at`` goes when more is read."""
        nonlocal at
        while len(buffer) - at < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            del buffer[:at]
            at = 0
            buffer.extend(piece)
        return True

    while True:
        while fill(1) and buffer[at] in b"\r\n":
            at += 1
        if not fill(1):
            return
        while not (end := _HEADER.search(buffer, at)):
            if not fill(len(buffer) - at + 1):
                raise ValueError("a WARC header is cut off")
        head, start = bytes(buffer[at : end.start()]), end.end() - at
        lines = head.decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not (length := fields.get("content-length", "")).isdecimal():
            raise ValueError("a WARC record states no length")
        if not fill(start + int(length)):
            raise ValueError("a WARC block is cut off")
        yield fields, bytes(buffer[at + start : at + start + int(length)])
        at += start + int(length)


def stated_sha1(digest: str | None) -> str | None:
    """Lower-case hex of a ``sha1:`` digest in hex or Base32."""
    value = (digest or "").partition(":")[2]
    if len(value) == 32:
        value = base64.b32decode(value.upper()).hex()
    return value.lower() or None


def _records(fields: dict[str, str], block: bytes, keep: bool) -> tuple:
    kind = fields.get("warc-type")
    clean = lambda k: fields[k].strip("<>") if k in fields else None
    payload, stated = block, None
    if kind in ("response", "revisit", "request") and "http" in fields.get("content-type", ""):
        top, _, payload = block.partition(b"\r\n\r\n")
        if (m := re.search(rb"(?im)^content-length:\s*(\d+)", top)) is not None:
            stated = int(m[1])
    about = block.decode("utf-8", "replace") if kind == "metadata" else None
    return (clean("warc-record-id"), kind, clean("warc-concurrent-to"), clean("warc-refers-to"), fields.get("warc-target-uri"), len(payload), hashlib.sha1(payload).hexdigest(), stated, stated_sha1(fields.get("warc-payload-digest")), about, payload if keep else None)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of WARC files: ids, types, links, lengths and digests of what is stored and what is stated, and payloads if wanted."""
    schema = pa.schema([(n.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[n.split()[1]]) for n in RECORDS.split(", ")])

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parse_archive(memoryview(content.as_buffer())):
                    rows.append(_records(fields, block, payloads))
                    size += len(block) * payloads + 500
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORDS)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its responses or revisits, requests and metadata records.

    Requests and metadata belong to the record that their WARC-Concurrent-To names; a record without
    that link is a capture of its own. A capture has a few records, so grouping by its id is bounded; hot
    payloads do not matter.
    """
    capture = F.coalesce("concurrent_to", "record_id")
    record = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    kept = lambda *kinds: F.collect_list(F.when(F.col("record_type").isin(*kinds), record))
    return records.groupBy(capture.alias("capture_id")).agg(kept("response", "revisit", "resource").alias("responses"), kept("request").alias("requests"), kept("metadata").alias("metadata"))


def archived_pages(pages: DataFrame, path: str | None = None, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives, read them and give the captures, one row per page row.

    The page_id is that of a capture's metadata record, in its own type; ``refers_to`` is that of the record
    which the revisit's WARC-Refers-To names, found by a join on record ids. A revisit states its full payload's length
    (in its HTTP header) and digest; a response's are those of the bytes read. Repeated rows of one page_id
    come back as often as they were written, a null page_id as null. Pages of any length count whole. An
    empty table gives an empty result; further columns, whatever their names, are ignored.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    path = path or scratch_path(spark, "warc")
    write_pages(pages, path, min_bytes)
    captures = assemble_captures(read_archives(spark, path, payloads=False))
    said = F.col("metadata")[0]["fields"]
    own = F.when(said.rlike("(?m)^pageId: "), F.url_decode(F.regexp_extract(said, r"(?m)^pageId: ([^\r\n]*)", 1))).cast(kind)
    each = materialize(captures.select(own.alias("page_id"), F.explode("responses").alias("r")).select("page_id", "r.record_id", "r.record_type", "r.refers_to_id", "r.payload_bytes", "r.payload_digest", "r.stated_bytes", "r.stated_digest"), "captures")
    revisits = each.where("record_type = 'revisit'")
    named = revisits.select(F.col("refers_to_id").alias("record_id")).distinct().join(each.select("record_id", F.col("page_id").alias("refers_to")), "record_id")
    named = named.select(F.col("record_id").alias("refers_to_id"), "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    revisits = revisits.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")).join(named, ["refers_to_id", "salt"], "left")
    full = revisits.select("page_id", F.col("stated_bytes").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to")
    return each.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(kind).alias("refers_to")).unionByName(full)


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT d, max(page_id) AS last_id FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.n >= 1000 AND m.last_id IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 1000 AND m.last_id IS DISTINCT FROM p.page_id THEN m.last_id END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""
