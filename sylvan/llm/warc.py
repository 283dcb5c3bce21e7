"""WARC archives with segmented records: a writer of revisits and a reader that puts segments together again.

A page is an HTTP response with a chunked body. Records whose block is longer
than a segment go out as a first record and continuation records. Archives are
plain WARC files, written through Spark's own writer (a record ends in two
CRLFs, the line separator of the text writer) and read as binary files, so any
file system that Spark reaches will do.
"""

from __future__ import annotations

import re
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, text_of

SEGMENT = 16_384  # bytes of a record's block in one segment
CHUNK = 4096  # bytes of a body in one transfer chunk
RECORDS_PER_FILE = 2000
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        eol = framed.index(b"\r\n", at)
        size = int(framed[at:eol].split(b";")[0], 16)
        at = eol + 2
        if not size:
            return b"".join(out)
        part = framed[at : at + size]
        if len(part) < size or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunked framing is broken")
        out.append(part)
        at += size + 2


def digest(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def record(kind: str, record_id: str, block: bytes, **fields: str | int | None) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE} | {k.replace("_", "-"): v for k, v in fields.items()}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def segments(kind: str, record_id: str, block: bytes, size: int = SEGMENT, **fields: str | int | None) -> Iterator[bytes]:
    """A record, cut where its block is longer than ``size``."""
    if len(block) <= size:
        yield record(kind, record_id, block, **fields)
        return
    parts = [block[i : i + size] for i in range(0, len(block), size)]
    yield record(kind, record_id, parts[0], WARC_Segment_Number=1, **fields)
    for n, part in enumerate(parts[1:], 2):
        last = {"WARC_Segment_Total_Length": len(block)} if n == len(parts) else {}
        yield record("continuation", f"{record_id}:{n}", part, WARC_Segment_Origin_ID=f"<{record_id}>", WARC_Segment_Number=n, **last)


_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*(.*?)\r\n", re.DOTALL)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive; lengths decide where a record ends."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        stop = data.index(b"\r\n\r\n", at)
        fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(data, data.index(b"\r\n", at) + 2, stop + 2)}
        n = int(fields["content-length"])
        block = data[stop + 4 : stop + 4 + n]
        if len(block) < n:
            raise ValueError("a record is cut off")
        yield fields, block
        at = stop + 4 + n
        if data[at : at + 4] == b"\r\n\r\n":
            at += 4


def _url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20]", "%20", url or "urn:x-none")


def _name(page: int | None, mark: str) -> str:
    return f"urn:x-page:{'' if page is None else page}:{mark}"


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, segment: int = SEGMENT, scratch: Scratch | None = None) -> None:
    """Writes a response or revisit record for each row of pages (page_id, url, html) to WARC files under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one
    with the smallest page_id (null only where no other is; of repeated rows
    that with the first url, or one of those) is the response that the others
    revisit. Payloads are equal when their SHA-256 digests are. Null html is an
    empty payload; very long ones are written whole, in segments. Other
    columns are ignored.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), text_of("html").cast("binary").alias("body"))
    rows = rows.withColumn("sha", F.sha2("body", 256))
    named = scratch.table(rows.where(F.octet_length("body") >= least_bytes).groupBy("sha", "page_id").agg(F.count("*").alias("n")), "digests")
    first = named.groupBy("sha").agg(F.sum("n").alias("copies"), F.max("n").alias("most"), F.min("page_id").alias("first_id")).where("copies > 1")
    first = scratch.table(first.withColumnRenamed("sha", "first_sha"), "first")
    rows = rows.join(first, (rows["sha"] == first["first_sha"]) & (F.octet_length("body") >= least_bytes), "left")
    could = F.col("first_sha").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.withColumn("revisit", F.col("first_sha").isNotNull() & ~could)
    # Rows that repeat page and payload: those alike are counted, one is the response, and the others are told out again.
    again = could & F.coalesce(F.col("most") > 1, F.lit(False))
    alike = rows.where(again).groupBy("sha", "url", "page_id", "first_sha", "most", "copies", "first_id").agg(F.first("body").alias("body"), F.count("*").alias("times"))
    alike = scratch.table(alike, "alike")
    least = alike.groupBy(F.col("sha").alias("least_sha")).agg(F.min("url").alias("least_url"))
    told = alike.join(least, F.col("sha") == F.col("least_sha")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    told = told.withColumn("revisit", (F.col("url") != F.col("least_url")) | (F.col("copy") > 1))
    rows = rows.where(~again).unionByName(told.select(rows.columns))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                body, page = r["body"], r["page_id"]
                fields = {"WARC_Target_URI": _url(r["url"]), "X_Page_Id": page, "WARC_Payload_Digest": f"sha1:{digest(body)}", "X_Payload_Length": len(body)}
                if r["revisit"]:
                    fields |= {"WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC_Refers_To": f"<{_name(r['first_id'], r['sha'])}>"}
                    out.append(record("revisit", _name(page, f"r{r['uid']}"), b"", **fields))
                else:
                    name = _name(page, r["sha"] if r["first_sha"] else f"r{r['uid']}")
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body)
                    out += segments("response", name, block, segment, Content_Type="application/http;msgtype=response", **fields)
            for i in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 500], pa.binary())], ["record"])

    archive = rows.select("uid", "page_id", "url", "body", "sha", "revisit", "first_id", "first_sha").mapInArrow(write, "record binary")
    archive.select(F.col("record").cast("string")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


PART = "origin string, segment int, total long, kind string, page_id long, said_digest string, said_bytes long, refers_to long, block binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PART.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def number(x: str | None) -> int | None:
        return int(x) if x else None

    for batch in batches:
        for data in batch.column("content"):
            rows, size = [], 0
            for f, block in records(data.as_py()):
                refers = f.get("warc-refers-to", "").strip("<>").split(":")
                rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), f["warc-type"], number(f.get("x-page-id")), f.get("warc-payload-digest"), number(f.get("x-payload-length")), number(refers[2]) if len(refers) > 2 else None, block))
                if (size := size + len(block)) > 4_000_000:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``: page_id, record_type, payload, payload_bytes, payload_digest, refers_to.

    Continuation records are grouped by the record they continue, put in order
    of segment number and held against the total length that the last one
    states; a gap or a wrong length or digest is an error. Only records that
    have segments are shuffled. A revisit has no payload (null) and takes
    length and digest from its header. Archives without records give no rows.
    """
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(_scan, PART)
    plain = parts.where("segment is null").select(*(F.col(c) for c in ("kind", "page_id", "said_digest", "said_bytes", "refers_to")), F.array(F.struct(F.lit(1).alias("segment"), F.lit(None).cast("long").alias("total"), "block")).alias("blocks"))
    cut = parts.where("segment is not null").groupBy("origin").agg(
        F.min(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"),
        F.max("page_id").alias("page_id"),
        F.max("said_digest").alias("said_digest"),
        F.max("said_bytes").alias("said_bytes"),
        F.max("refers_to").alias("refers_to"),
        F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("blocks"),
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                blocks = r["blocks"]
                if [b["segment"] for b in blocks] != list(range(1, len(blocks) + 1)) or r["kind"] is None:
                    raise ValueError("a segment is missing or repeated")
                block = b"".join(b["block"] for b in blocks)
                if len(blocks) > 1 and blocks[-1]["total"] != len(block):
                    raise ValueError("segments do not add up to the total length")
                said = (r["said_digest"] or "").removeprefix("sha1:")
                if r["kind"] == "revisit":
                    payload, n, found = None, r["said_bytes"], said
                else:
                    head, _, body = block.partition(b"\r\n\r\n")
                    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    n, found = len(payload), digest(payload)
                    if said and said != found:
                        raise ValueError("a payload does not have its digest")
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((r["page_id"], pa.int64()), (r["kind"], pa.string()), (payload, pa.binary()), (n, pa.int64()), (found, pa.string()), (r["refers_to"], pa.int64()))], ["page_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])

    return plain.unionByName(cut.drop("origin")).mapInArrow(decode, "page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back: a row per page."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archives")
    write_archives(pages, path, least_bytes, scratch=scratch)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(body) AS n, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((
         (strpos('0123456789abcdef', substr(hex, CAST((i * 5) // 4 + 1 AS BIGINT), 1)) - 1) * 16
         + CASE WHEN (i * 5) // 4 + 2 > 40 THEN 0 ELSE strpos('0123456789abcdef', substr(hex, CAST((i * 5) // 4 + 2 AS BIGINT), 1)) - 1 END
       ) >> CAST(3 - (i * 5) % 4 AS INTEGER)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
