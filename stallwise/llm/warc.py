"""WARC archives: written from fetched pages, read back, and assembled into captures.

A capture is three records: the response, or a revisit of an equal payload, and
the request and metadata records that name it in WARC-Concurrent-To. Reading
joins them by that header into one nested row.

Spark's text writer makes the files, with the blank lines that end a record as
line separator, so they go to whatever store the folder is in.
"""

from __future__ import annotations

import gzip
import io
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallwise.session import scratch_dir

END = "\r\n"
RECORD_END = END + END
DATE = "2000-01-01T00:00:00Z"
LEAST_BYTES = 0
#: Payload of one file at most, so that a reader can hold a file, and the upper end of the smallest class of pages.
FILE_BYTES, SMALL_BYTES = 256 << 20, 64 << 10
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = (
    "record_id string, record_type string, concurrent_to string, target_uri string, date string, "
    "payload_bytes long, payload_digest string, page_id string, refers_to string, payload binary"
)


def base32_of_sha1(hexadecimal: Column) -> Column:
    """40 hexadecimal digits as 32 base32 digits."""
    signs = []
    for chunk in range(8):
        value = F.conv(F.substring(hexadecimal, 5 * chunk + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1
            signs.append(F.substr(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*signs)


def _urn(number: Column, kind: str) -> Column:
    digits = F.md5(F.concat(number, F.lit(kind)))
    parts = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _lines(**fields: Column) -> Column:
    """Header lines of the fields that are not null; ``_`` in a name stands for ``-``."""
    lines = [
        F.coalesce(F.concat(F.lit(f"{name.replace('_', '-')}: "), value.cast("string"), F.lit(END)), F.lit(""))
        for name, value in fields.items()
    ]
    return F.concat(*lines)


def _record(kind: Column, number: Column, of: str, block: Column, **fields: Column) -> Column:
    head = _lines(
        WARC_Type=kind, WARC_Record_ID=_urn(number, of), WARC_Date=F.lit(DATE), **fields,
        Content_Length=F.octet_length(block),
    )
    return F.concat(F.lit(f"WARC/1.1{END}"), head, F.lit(END), block)


def marked(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, html, n, sha, first``: ``first`` is the id of the response that a row revisits.

    Of equal payloads of at least ``least_bytes`` bytes the smallest id is the
    response; rows that repeat that id are responses too. A null html is empty;
    a payload that only rows without id have has no revisits.
    """
    found = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    found = found.withColumn("n", F.octet_length("html").cast("long")).withColumn("sha", F.sha1("html"))
    equal = found.filter(F.col("n") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("_rows"))
    found = found.join(equal.filter("_rows > 1 AND first IS NOT NULL").drop("_rows"), "sha", "left")
    return found.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One text per record: three for each row of ``pages``."""
    found = marked(pages, least_bytes).withColumn("number", F.expr("uuid()"))
    found = found.withColumn("uri", F.regexp_replace("url", r"[\r\n]", "%0A"))
    number, uri, revisit = F.col("number"), F.col("uri"), F.col("first").isNotNull()
    digest = F.concat(F.lit("sha1:"), base32_of_sha1(F.col("sha")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(RECORD_END))
    answer = _record(
        F.when(revisit, "revisit").otherwise("response"), number, "response",
        F.concat(http, F.when(revisit, "").otherwise(F.col("html"))),
        WARC_Target_URI=uri, WARC_Payload_Digest=digest,
        WARC_Profile=F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        Content_Type=F.lit("application/http;msgtype=response"),
    )
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), r"://([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(uri, F.lit("")), r"://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(RECORD_END))
    request = _record(
        F.lit("request"), number, "request", asked, WARC_Target_URI=uri,
        WARC_Concurrent_To=_urn(number, "response"), Content_Type=F.lit("application/http;msgtype=request"),
    )
    about = _record(
        F.lit("metadata"), number, "metadata", _lines(page_id=F.col("page_id"), refers_to=F.col("first")),
        WARC_Target_URI=uri, WARC_Concurrent_To=_urn(number, "response"), Content_Type=F.lit("application/warc-fields"),
    )
    return found.select(F.explode(F.array(answer, request, about)).alias("value"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Compressed archive files of the pages in ``path``, none of more than about ``file_bytes`` of payload.

    A file is read as one value. Pages are written by classes of size, each four
    times the one before, with as many pages in a file as its class allows; a
    larger page has a file of its own. Equal payloads are of one class.
    """
    size = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit("")))
    steps = F.ceil(F.log(4.0, size / SMALL_BYTES)).cast("int")
    of = F.when(size > SMALL_BYTES, steps).otherwise(0)
    found = [row["_class"] for row in pages.select(of.alias("_class")).distinct().collect()]
    for number in sorted(found) or [0]:
        some = pages.filter(of == number)
        writer = records(some, least_bytes).write.mode("append").option("lineSep", RECORD_END).option("compression", "gzip")
        writer.option("maxRecordsPerFile", 3 * max(1, file_bytes // (SMALL_BYTES << 2 * number))).text(path)


def _fields(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a continued line belongs to the one before."""
    found, name = {}, ""
    for line in block.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the blank lines between records
        head = []
        while (line := stream.readline()).strip():
            head.append(line)
        fields = _fields(b"".join(head))
        yield fields, stream.read(int(fields.get("content-length", 0)))


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record; payloads are digested where they are read and only kept if asked for."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for files in batches:
            for content in files["content"]:
                stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                rows, size = [], 0
                for fields, block in parse(io.BufferedReader(stream, 1 << 20)):
                    kind, own = fields.get("warc-type"), {}
                    payload, n, digest = None, None, None
                    if kind == "metadata":
                        own = _fields(block)
                    elif kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        n = int(_fields(head).get("content-length", len(payload)))
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "response":
                            n, digest = len(payload), b32encode(sha1(payload).digest()).decode()
                    payload = payload if with_payload and kind == "response" else None
                    rows.append((
                        fields.get("warc-record-id"), kind, fields.get("warc-concurrent-to"), fields.get("warc-target-uri"),
                        fields.get("warc-date"), n, digest, own.get("page-id"), own.get("refers-to"), payload,
                    ))
                    size += len(payload or b"")
                    if len(rows) >= 5000 or size > 1 << 24:
                        yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(read, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, answer, request, metadata``.

    ``request`` and ``metadata`` are the records that name the capture's
    response or revisit as concurrent; null where there is none, the one with
    the smallest record id where there are several.
    """
    def concurrent(kind: str, name: str, *columns: str) -> DataFrame:
        some = found.filter(F.col("record_type") == kind).filter("concurrent_to IS NOT NULL")
        return some.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(F.struct("record_id", "target_uri", "date", *columns)).alias(name))

    answers = found.filter(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"),
        F.struct("record_type", "target_uri", "date", "payload_bytes", "payload_digest", "payload").alias("answer"),
    )
    joined = answers.join(concurrent("request", "request"), "capture_id", "left")
    return joined.join(concurrent("metadata", "metadata", "page_id", "refers_to"), "capture_id", "left")


def report(pages: DataFrame) -> DataFrame:
    """The registered form: pages written to archives in the shared folder, read back and assembled."""
    path = scratch_dir(pages.sparkSession, "llm-warc")
    write_archive(pages, path)
    found = captures(read_archive(pages.sparkSession, path))
    return found.select(
        F.col("metadata.page_id").cast("long").alias("page_id"), "answer.payload_bytes", "answer.payload_digest",
        "answer.record_type", F.col("metadata.refers_to").cast("long").alias("refers_to"),
    )
