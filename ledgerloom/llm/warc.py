"""WARC archives: written as text files of records, read back and assembled into captures.

A capture is one response (or revisit) record with the request and metadata records
that name it in WARC-Concurrent-To. Records carry UTF-8 payloads only, so Spark's
own text writer and reader move them to and from any file system.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm.common import shared_path

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

# Records in an archive, fewer if so many bytes are fewer records on average.
RECORDS_PER_FILE, FILE_BYTES = 4096, 256 << 20
# Bytes of blocks in a batch that a reader gives out.
BATCH = 4 << 20

RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload binary, payload_length bigint, fields map<string,string>, digest_ok boolean"
)


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 160 bits given in hexadecimal: four parts of 40 bits, eight letters each."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines, an empty line and the block; the text writer adds the end of the record."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit(VERSION), *lines, length), F.lit(END), block)


def _one_line(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")


def capture_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(value): three records for every page, as text.

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the
    greatest key is a response and the others revisit it; a revisit has no payload
    of its own. Pages that share key and payload are all responses or all revisits.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8"))).withColumn("bytes", F.octet_length("payload"))
    rows = rows.withColumn("n", F.monotonically_increasing_id())
    # A payload that occurs once needs no answer, so only repeated ones are joined back.
    newest = rows.groupBy("digest", "bytes").agg(F.max(F.struct("key", "n")).alias("newest"), F.count("*").alias("copies")).filter("copies > 1")
    rows = rows.join(newest, ["digest", "bytes"], "left")
    revisit = F.coalesce((F.col("bytes") >= least_bytes) & (F.col("newest").isNotNull() & ~F.col("key").eqNullSafe(F.col("newest.key"))), F.lit(False))
    rows = rows.withColumn("revisit", revisit).withColumn("digest32", base32(F.col("digest")))
    # Record ids name the page and, for pages that share a key, the row.
    name = lambda key, n: F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), n.cast("string"))
    own = name(F.col("key"), F.col("n"))
    first = F.concat(F.lit("<urn:capture:"), name(F.col("newest.key"), F.col("newest.n")), F.lit(">"))
    part = lambda kind: F.concat(F.lit(f"<urn:{kind}:"), own, F.lit(">"))
    rows = rows.select("*", part("capture").alias("id"), first.alias("first"), _one_line(F.col("url")).alias("uri"))
    uri, digest = ("WARC-Target-URI", F.col("uri")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest32")))
    date = ("WARC-Date", F.lit("1970-01-01T00:00:00Z"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    response = _record(
        [("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("id")), date, uri, digest, ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, "payload"),
    )
    again = _record(
        [("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", F.col("id")), date, uri, digest, ("WARC-Profile", F.lit(PROFILE)),
         ("WARC-Refers-To", F.col("first")), ("Content-Type", F.lit("application/http; msgtype=response"))],
        http,
    )
    host = F.regexp_extract("uri", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace("uri", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", part("request")), date, uri, ("WARC-Concurrent-To", F.col("id")),
         ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)),
    )
    fields = F.concat(
        F.when(F.col("key").isNotNull(), F.concat(F.lit("page-id: "), F.col("key").cast("string"), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("payload-length: "), F.col("bytes").cast("string"), F.lit("\r\n"),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", part("metadata")), date, uri, ("WARC-Concurrent-To", F.col("id")),
         ("Content-Type", F.lit("application/warc-fields"))],
        fields,
    )
    return rows.select(F.explode(F.array(request, F.when(F.col("revisit"), again).otherwise(response), metadata)).alias("value"))


def write(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archive files below ``path``; a file holds at most ``records_per_file`` records, so a reader can hold it packed."""
    options = {"lineSep": END, "compression": "gzip", "maxRecordsPerFile": records_per_file}
    records.write.options(**options).text(path)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse(source: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, read one after the other; stops with an error at anything else."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    n = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"record {n} does not begin with a version")
        head = bytearray()
        while (line := stream.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError(f"the headers of record {n} do not end")
            head += line
        headers = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(head)}
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length or stream.read(4) != END.encode():
            raise ValueError(f"record {n} does not end where its length says")
        yield headers, block
        n += 1


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers.get("warc-type", "")
    payload, fields = None, {}
    if kind in ("response", "request", "revisit"):
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else b""
    elif kind == "metadata":
        fields = {k.decode(): v.decode() for k, v in _HEADER.findall(block)}
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    sound = None
    if kind == "response" and digest:
        sound = base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    return (
        headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
        headers.get("warc-target-uri"), headers.get("warc-date"), digest, payload, len(payload) if payload is not None else None, fields, sound,
    )


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives below ``path``; without ``payloads`` their bytes stay behind."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [part.split(" ")[0] for part in re.split(r", (?=\w+ )", RECORD)]
    types = [
        *[pa.string()] * 7, pa.binary(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.bool_(),
    ]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        arrays = [pa.array([list(v.items()) for v in c] if i == 9 else list(c), types[i]) for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        for batch in batches:
            # A file is held as it lies on disk, and its records one batch at a time.
            for file in range(batch.num_rows):
                stream = io.BytesIO(batch.column(0)[file].as_py())
                packed = stream.getbuffer()[:2] == b"\x1f\x8b"
                rows, size = [], 0
                for headers, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=stream)) if packed else stream):
                    row = _row(headers, block)
                    rows.append(row if payloads else (*row[:7], None, *row[8:]))
                    size += len(block) if payloads else 0
                    if len(rows) >= 512 or size >= BATCH:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, main, request, metadata).

    Requests and metadata meet their response or revisit under the id they are
    concurrent to; a record without one is its own capture. Of several records of a
    kind the one with the greatest id counts; what a capture lacks is null.
    """
    capture = F.coalesce(F.when(F.col("concurrent_to") != "", F.col("concurrent_to")), F.col("record_id"))
    whole = F.struct(*[c for c in records.columns])
    pick = lambda *kinds: F.max_by(whole, F.when(F.col("record_type").isin(*kinds), F.col("record_id")))
    return records.groupBy(capture.alias("capture_id")).agg(
        pick("response", "revisit", "resource").alias("main"), pick("request").alias("request"), pick("metadata").alias("metadata")
    )


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write the pages as WARC files, read them back, and return the assembled captures.

    Null html counts as empty, a null url as the empty address. Repeated rows are
    captures of their own; an empty table gives no captures; other columns are not
    archived.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    # Three records for a page.
    bytes_per_page = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    fit = int(3 * FILE_BYTES // max(bytes_per_page, 1))
    write(capture_records(pages, least_bytes=least_bytes), path, min(RECORDS_PER_FILE, max(fit, 3)))
    return assemble(read(spark, path, payloads=False))


def page_digests(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every capture."""
    field = lambda name: F.col("metadata.fields")[name].cast("bigint")
    refers = F.regexp_extract("main.refers_to", r"^<urn:capture:(-?\d+):\d+>$", 1)
    length = F.when(F.col("main.record_type") == "response", F.col("main.payload_length")).otherwise(field("payload-length"))
    return captures.select(
        field("page-id").alias("page_id"), length.alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.record_type").alias("record_type"), F.when(F.col("main.record_type") == "revisit", refers.try_cast("bigint")).alias("refers_to"),
        F.col("main.digest_ok").alias("digest_ok"),
    )
