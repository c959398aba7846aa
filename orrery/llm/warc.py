"""Content-addressed web archive: payload bytes once, exact record headers apart.

``write`` makes two tables under one folder: ``payloads`` holds every distinct payload once
under its SHA-256, ``headers`` holds the exact header block of every record.  ``read`` joins
them into the bytes of the original records, ``parse`` takes those bytes apart as any reader
of the format would, and ``verified`` holds lengths and digests against them and follows
revisits to the record they refer to.

Which record is first is settled on narrow rows, a digest's rows dealt over ``SALTS`` parts; a
payload that many records have meets them in lots of ``LOT_ROWS``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import stored
from .rows import text_chunks

#: Equal payloads of at least this many bytes are stored as revisits of the first.
REVISIT_BYTES = 100
EPOCH = "2024-01-01T00:00:00Z"
SALTS = 64
#: Records that meet one copy of their payload.
LOT_ROWS = 4096
_CRLF = "\r\n"
_NAME = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*)", re.S)
_PAGE = re.compile(rb"<urn:page:(null|-?[0-9]+)>")


def _record_id(column):
    """A stable record URI from the page id."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("null")), F.lit(">"))


def _line(name: str, value):
    return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))


def _one_line(column):
    """A header value: null is empty, line breaks cannot end the header."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[\r\n]", "%0A")


def write(pages: DataFrame, folder: str, date: str = EPOCH) -> None:
    """Archive ``page_id, url, html`` rows under ``folder``.

    The payload is the html in UTF-8; null is empty.  Of the records with equal payloads of
    at least ``REVISIT_BYTES``, that with the smallest page id is a response and the others
    revisit it; smaller payloads are all responses.  Repeated rows of one page id are
    responses together.  Rows with a null page id come last in that order.  An empty table makes
    an empty archive, other columns are left out.  Two hashes of different kinds must agree
    within a digest, else the write fails.
    """
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", data.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    narrow = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.xxhash64("payload").alias("second"), salt.alias("salt"))
    parts = narrow.groupBy("digest", "salt").agg(F.min("page_id").alias("least"), F.min("second").alias("a"), F.max("second").alias("b"), F.count("*").alias("n"))
    own = Window.partitionBy("digest")
    clash = F.when(F.min("a").over(own) != F.max("b").over(own), F.raise_error(F.lit("two payloads share a digest")).cast("long"))
    parts = parts.select("digest", "salt", F.coalesce(clash, F.min("least").over(own)).alias("first_id"), F.ceil(F.sum("n").over(own) / LOT_ROWS).alias("lots"))

    store = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.ceil(F.count("*") / LOT_ROWS).alias("lots"))
    store.write.option("compression", "zstd").parquet(f"{folder}/payloads")

    named = narrow.join(parts, ["digest", "salt"])
    again = (F.col("payload_bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    block = F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        _line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _one_line(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(_line("WARC-Refers-To", _record_id(F.col("first_id"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}"),
        _line("Content-Length", block.cast("string")),
        F.lit(_CRLF),
    )
    lot = F.pmod(F.xxhash64("url", "page_id", F.lit("lot")), F.col("lots")).alias("lot")
    headers = named.withColumn("revisit", F.coalesce(again, F.lit(False))).withColumn("http", http)
    headers = headers.select("page_id", "digest", "revisit", lot, head.cast("binary").alias("warc_header"), F.col("http").cast("binary").alias("http_header"))
    headers.write.option("compression", "zstd").parquet(f"{folder}/headers")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, digest, record``: the original records, byte for byte.

    Responses get their payload back by digest and lot; a revisit has none in its record.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))).drop("lots")
    end = F.lit(b"\r\n\r\n")
    whole = headers.where("not revisit").join(payloads, ["digest", "lot"]).select("page_id", "digest", F.concat("warc_header", "http_header", "payload", end).alias("record"))
    return whole.unionByName(headers.where("revisit").select("page_id", "digest", F.concat("warc_header", "http_header", end).alias("record")))


def record_bytes(records: DataFrame) -> DataFrame:
    """``page_id, record``: each record as it stands in a WARC file."""
    return records.select("page_id", "record")


def export_files(records: DataFrame, folder: str, codec: str = "gzip", rows: int = 50_000) -> None:
    """Write records as WARC files; lines end where a record does, so bytes are exact."""
    body = record_bytes(records).select(F.expr("cast(substr(record, 1, length(record) - 4) as string)").alias("value"))
    body.write.option("lineSep", "\r\n\r\n").option("compression", codec).option("maxRecordsPerFile", rows).text(folder)


def _fields(head: bytes) -> dict[bytes, bytes]:
    """The named fields of a header block, names in lower case."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        if not (m := _NAME.fullmatch(line)):
            raise ValueError(f"not a header line: {line[:80]!r}")
        out[m[1].lower()] = m[2].strip()
    return out


def parse_record(record: bytes) -> dict:
    """One record's type, page, referred page, digest, and the length its payload has or had.

    The version, both Content-Length fields and, for a response, the SHA-256 of the payload are
    held against the bytes; what does not fit is a ValueError.
    """
    head, mark, rest = record.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not a record")
    fields = _fields(head)
    block = rest[:-4]
    if not rest.endswith(b"\r\n\r\n") or int(fields[b"content-length"]) != len(block):
        raise ValueError(f"a block of {len(block)} bytes where {fields[b'content-length']!r} are said")
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    kind, size = fields[b"warc-type"].decode(), int(_fields(http)[b"content-length"])
    algorithm, _, digest = fields[b"warc-payload-digest"].decode().partition(":")
    if algorithm != "sha256":
        raise ValueError(f"digest of an unknown kind: {algorithm}")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("damaged payload " + digest)
    if kind == "revisit" and payload:
        raise ValueError("a revisit with a payload")
    pages = [_PAGE.fullmatch(fields[f])[1] if f in fields else b"null" for f in (b"warc-record-id", b"warc-refers-to")]
    page, refers = (None if p == b"null" else int(p) for p in pages)
    return {"page_id": page, "record_type": kind, "refers_to": refers, "payload_digest": digest, "payload_bytes": size}


def parse(records: DataFrame) -> DataFrame:
    """``page_id, record_type, refers_to, payload_digest, payload_bytes`` from records' bytes."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "record"):
            yield pa.RecordBatch.from_pylist([parse_record(r) for r in batch.column("record").to_pylist()], schema)

    return records.select("record").mapInArrow(run, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long")


def verified(records: DataFrame) -> DataFrame:
    """What the records say, held against the bytes that came back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``.  A revisit's
    payload is that of the response it refers to, which must be there with the same digest and
    length; else the job stops, as it does at a record that does not fit its own header.  An
    archive of no pages gives no rows; repeated pages keep their rows.
    """
    parsed = stored(parse(records), "parsed")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    key = ["refers_to", "payload_digest", "salt"]
    again = parsed.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    first = parsed.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("found"))
    # One row for each first record and salt, so a popular page's revisits are not gathered.
    known = again.select(key).distinct().join(first, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no response for a revisit of "), F.coalesce(F.col("refers_to").cast("string"), F.lit("null")))).cast("long")
    followed = again.join(known, key).withColumn("payload_bytes", F.when(F.col("found") == F.col("payload_bytes"), F.col("found")).otherwise(lost))
    return parsed.where("record_type = 'response'").select(cols).unionByName(followed.select(cols))
