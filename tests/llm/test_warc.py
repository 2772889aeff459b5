import gzip
import hashlib
import io
from base64 import b32encode
from collections import Counter

from pyspark.sql import functions as F

from stallwise.llm import warc

PAGES = "page_id long, url string, html string"


def digest(text):
    return b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    firsts = {}
    for i, _, text in rows:
        if i is not None and len((text or "").encode()) >= least:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    found = Counter()
    for i, _, text in rows:
        first = firsts.get(text or "")
        revisit = first is not None and i != first
        found[i, len((text or "").encode()), digest(text), "revisit" if revisit else "response", first if revisit else None] += 1
    return found


ROWS = [
    (1, "http://a/b?c#d", "x"), (2, "http://a/\r\nb", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (3, None, None), (4, "plain", ""),
    (1, "http://a/b?c#d", "x"), (None, "u", "x"), (9, "http://q", "x"), (5, "http://l/", "long \x00text\n" * 200_000), (None, None, "alone"), (None, None, "alone"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, PAGES).withColumns({"sha": F.lit(1), "n": F.lit("x"), "first": F.lit(2), "payload": F.lit(3)})
    assert Counter(map(tuple, warc.report(pages).collect())) == expected(ROWS)
    assert warc.report(pages.limit(0)).count() == 0


def test_least_bytes_and_payload(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES)
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path, least_bytes=2)
    found = warc.captures(warc.read_archive(spark, path, with_payload=True)).collect()
    got = Counter()
    for r in found:
        m, a = r["metadata"], r["answer"]
        page, refers = (int(m[k]) if m[k] else None for k in ("page_id", "refers_to"))
        got[page, a["payload_bytes"], a["payload_digest"], a["record_type"], refers] += 1
        assert r["request"]["target_uri"] == a["target_uri"]
        assert a["record_type"] == "revisit" or digest(bytes(a["payload"]).decode()) == a["payload_digest"]
    assert got == expected(ROWS, 2)


def test_foreign_archives(spark, tmp_path):
    def record(kind, number, block, **fields):
        lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
        return f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <{number}>\r\n{lines}Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n".encode()

    answer = record("response", "r1", "HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody", WARC_Target_URI="http://a/")
    other = record("response", "r2", "HTTP/1.1 200 OK\r\n\r\n", WARC_Target_URI="http://b/\r\n continued")
    asked = [record("request", f"q{i}", "GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<r1>") for i in (2, 1)]
    about = record("metadata", "m1", "page-id: 5\r\n", WARC_Concurrent_To="<none>")
    (tmp_path / "part-1.warc").write_bytes(record("warcinfo", "i", "a: b") + answer + about)
    (tmp_path / "part-2.warc.gz").write_bytes(b"".join(map(gzip.compress, [*asked, other])))
    rows = {r["capture_id"]: r for r in warc.captures(warc.read_archive(spark, str(tmp_path), True)).collect()}
    assert rows.keys() == {"<r1>", "<r2>"}
    assert rows["<r1>"]["answer"]["payload"] == b"body" and rows["<r1>"]["request"]["record_id"] == "<q1>"
    assert rows["<r2>"]["request"] is None and rows["<r2>"]["answer"]["payload_bytes"] == 0


def test_base32(spark):
    rows = spark.range(50).select(F.sha1(F.col("id").cast("string")).alias("h"))
    for r in rows.select("h", warc.base32_of_sha1(F.col("h")).alias("b")).collect():
        assert r["b"] == b32encode(bytes.fromhex(r["h"])).decode()


def test_parse_stops_at_a_broken_end():
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nshort"
    assert list(warc.parse(io.BytesIO(whole)))[0][1] == b"short"


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """Large pages go into files of few, small ones into files of many; a page beyond the bound has its own."""
    sizes = [1 << 20] * 12 + [100] * 300 + [300_000] * 10 + [5 << 20]
    pages = spark.range(len(sizes)).coalesce(1).withColumn("url", F.lit("http://a/")).withColumn(
        "html", F.expr(f"repeat(substr(md5(cast(id AS string)), 1, 10), cast(element_at(array({', '.join(map(str, sizes))}), cast(id + 1 AS int)) / 10 AS int))"))
    pages = pages.withColumnRenamed("id", "page_id")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path, file_bytes=4 << 20)
    whole = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "archive").glob("part-*")]
    assert max(whole) < (5 << 20) + 5000 and sum(n > (4 << 20) + 200_000 for n in whole) == 1
    assert len(whole) >= 12 // 4 + 1 + 1
    found = warc.captures(warc.read_archive(spark, path)).select("answer.payload_bytes").collect()
    assert Counter(r[0] for r in found) == Counter(n // 10 * 10 for n in sizes)
