"""WARC archives: write captures, read them back, assemble their transactions.

A capture is three records: the response (or a revisit of an earlier response
with the same payload), the request, and a metadata record; request and
metadata name the response in WARC-Concurrent-To.  Records are single gzip
members, so an archive is a valid ``.warc.gz`` that tools can seek in.

Writing goes through Spark's text sink with a NUL line end: a member ends
with the high byte of its length, which is NUL for records under 16 MiB and
left for the line end to supply; a longer record is followed by a NUL, which
gzip readers skip as padding.  So archives land in whatever store Spark
writes to, under its commit protocol.  Files hold ``max_records`` records at
most.  Reading takes whole files by Spark's binary source and parses them by
their Content-Length, never by searching for marks in payloads.

Which response a page revisits is decided before writing: an aggregate of the
payload digests names the smallest id of each repeated payload, and only slim
(id, digest) rows move for that; a digest that very many pages share is one
row of the aggregate, and its pages are split by the skew-join handling.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, parts_of

MIN_REVISIT = 100      # payloads of fewer bytes are always responses
MAX_RECORDS = 30_000   # records of one archive file
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KINDS = {"response": 1, "revisit": 1, "request": 2, "metadata": 3, "warcinfo": 4}

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("warc_type", T.StringType()),
    T.StructField("concurrent_to", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("headers", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
    T.StructField("intact", T.BooleanType())])


WITHOUT_ID = 4        # added to the kind of record of a page without an id


def record_uri(kind: int, page: int) -> str:
    """A version-8 UUID that holds the kind of record and the 64-bit page id."""
    n = page & (1 << 64) - 1
    value = (0x57415243 << 96) | (kind << 80) | (8 << 76) | ((n >> 62) << 64) | (0b10 << 62) | (n & (1 << 62) - 1)
    h = f"{value:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(uri):
    """Column: the page id in a record id that ``record_uri`` made, null for a page without one."""
    h = F.regexp_replace(F.regexp_extract(uri, r"^<urn:uuid:([0-9a-f-]{36})>$", 1), "-", "")
    low = F.conv(F.substring(h, 17, 16), 16, -10).cast("long").bitwiseAND(F.lit((1 << 62) - 1))
    high = F.conv(F.substring(h, 14, 3), 16, 10).cast("long")
    named = (F.length(h) == 32) & (F.conv(F.substring(h, 9, 4), 16, 10).cast("int") < WITHOUT_ID)
    return F.when(named, low.bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(3)), 62)))


def one_line(value: str) -> str:
    """A header value: line breaks and blanks that a URI cannot hold are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def member(fields: list, block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    raw = b"".join((VERSION.encode(), b"\r\n", head.encode(), b"Content-Length: ", str(len(block)).encode(),
                    b"\r\n\r\n", block, b"\r\n\r\n"))
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def capture(page: int | None, url: str | None, html: bytes, digest: str, refers: int | None, date: str) -> list:
    """The three records of one page; one without an id is numbered by a hash of its url and payload."""
    kind, number = 0, page
    if page is None:
        kind = WITHOUT_ID
        number = int.from_bytes(hashlib.sha256(f"{digest} {'' if url is None else 'u' + url}".encode()).digest()[:8])
    uri, me = (one_line(url) if url else None), record_uri(1 + kind, number)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(html)}\r\n\r\n").encode()
    common = [("WARC-Record-ID", me), ("WARC-Date", date), ("WARC-Target-URI", uri),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is None:
        first = member([("WARC-Type", "response"), *common], http + html)
    else:
        first = member([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE),
                        ("WARC-Refers-To", record_uri(1, refers))], http)
    path = f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode()
    request = member([("WARC-Type", "request"), ("WARC-Record-ID", record_uri(2 + kind, number)), ("WARC-Date", date),
                      ("WARC-Target-URI", uri), ("WARC-Concurrent-To", me),
                      ("Content-Type", "application/http; msgtype=request")], path)
    named = "" if page is None else f"page-id: {page}\r\n"
    note = f"{named}url-present: {int(url is not None)}\r\n".encode()
    meta = member([("WARC-Type", "metadata"), ("WARC-Record-ID", record_uri(3 + kind, number)), ("WARC-Date", date),
                   ("WARC-Target-URI", uri), ("WARC-Concurrent-To", me),
                   ("Content-Type", "application/warc-fields")], note)
    return [first, request, meta]


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, html, digest, refers`` with the page whose response each revisit refers to."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256))
    slim = base.where(F.length("html") >= min_revisit).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1")
    again = slim.join(first, "digest").where("page_id <> refers").select("page_id", "digest", "refers").distinct()
    return base.join(again, ["page_id", "digest"], "left")


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT,
               max_records: int = MAX_RECORDS, without_id: bool = False) -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``.

    The payload is the html in UTF-8, empty where it is null.  Of pages with
    equal payloads of ``min_revisit`` bytes or more, the one with the smallest
    id is the response and the others revisit it.  Page ids are the identity of
    a capture, and of rows that repeat one each is written.  Rows without one
    are refused, or with ``without_id`` written as responses with record ids of
    their own kind (rows of equal url and payload share theirs).
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in parts_of(batches):
            got = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "digest", "refers")}
            out = []
            for page, url, html, digest, refers in zip(*got.values()):
                if page is None and not without_id:
                    raise ValueError("a page without page_id cannot be archived")
                out += [m[:-1] if m[-1] == 0 else m for m in capture(page, url, html, digest, refers, date)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = map_arrow(with_revisits(pages, min_revisit), run, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option(
        "maxRecordsPerFile", max_records).text(path)


def members(data: bytes) -> Iterator[bytes]:
    """The inflated gzip members of an archive; NUL padding between them is skipped."""
    view, at, n = memoryview(data), 0, len(data)
    while True:
        while at < n and data[at] == 0:
            at += 1
        if at >= n:
            return
        z = zlib.decompressobj(31)
        parts, chunk = [], 1 << 16
        while not z.eof:
            if at >= n:
                raise ValueError("an archive ends inside a record")
            part = view[at:at + chunk]
            parts.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(parts)


def records(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    """``(headers in lower case, block)`` of each record in inflated archive bytes."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = {}
        for x in lines[1:]:
            k, _, v = x.partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        yield head, raw[end + 4:end + 4 + size]
        at = end + 4 + size
        while raw[at:at + 2] == b"\r\n":
            at += 2


def parse_record(head: dict, block: bytes, with_payload: bool) -> tuple:
    """One row of ``RECORD``; the digest is that of the payload read, or the stored one of a revisit."""
    kind = head.get("warc-type", "")
    stored = head.get("warc-payload-digest", "").rpartition(":")[2] or None
    inner, payload, size, digest, intact = None, None, None, None, True
    if kind in ("response", "revisit", "request"):
        top, _, payload = block.partition(b"\r\n\r\n")
        inner = top.decode("utf-8", "replace")
        length = next((int(x.split(":", 1)[1]) for x in inner.split("\r\n")[1:]
                       if x.lower().startswith("content-length:")), len(payload))
        if kind == "revisit":
            size, digest, payload = length, stored, None
        else:
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            intact = size == length and stored in (None, digest)
    else:
        inner = block.decode("utf-8", "replace")
    return (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"),
            head.get("warc-target-uri"), head.get("warc-date"), inner, size, digest,
            payload if with_payload and kind == "response" else None, intact)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row of ``RECORD`` per record of the archives under ``path``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(RECORD)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for data in b.column(b.schema.get_field_index("content")):
                rows, held = [], 0
                for raw in members(data.as_buffer().to_pybytes()):
                    for head, block in records(raw):
                        rows.append(parse_record(head, block, with_payload))
                        held += len(block)
                    if len(rows) >= 2000 or held >= 1 << 24:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return map_arrow(files, run, RECORD)


def transactions(recs: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request and metadata records.

    Request and metadata records find their response by WARC-Concurrent-To;
    several of them for one response come as arrays in order of their ids.  A
    response without them has empty arrays; records that name no response
    present are not captures.  A response that is archived several times
    (repeated rows) is returned as often, each with all records.
    """
    side = recs.where(F.col("warc_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    part = F.struct("record_id", "target_uri", "date", "headers")
    linked = side.groupBy(F.col("concurrent_to").alias("record_id")).agg(
        *[F.array_sort(F.collect_set(F.when(F.col("warc_type") == k, part))).alias(f"{k}s") for k in ("request", "metadata")])
    main = recs.where(F.col("warc_type").isin("response", "revisit")).select(
        "record_id", F.struct("warc_type", "target_uri", "date", "headers", "payload_bytes", "payload_digest",
                              "payload", "refers_to", "intact").alias("response"))
    empty = F.array().cast(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in (
        "record_id", "target_uri", "date", "headers")])))
    return main.join(linked, "record_id", "left").select(
        "record_id", "response", F.coalesce("requests", empty).alias("requests"),
        F.coalesce("metadatas", empty).alias("metadata"))


def read_captures(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Read the archives under ``path`` into one nested row per capture."""
    return transactions(read_records(spark, path, with_payload))
