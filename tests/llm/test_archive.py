"""The content-addressed archive: SQL, exact record bytes, and what is stored of copies."""

import hashlib
import re

import oracle
import pytest
from pyspark.sql import functions as F

from armspan.llm import queries
from armspan.llm.page_archive import describe_records, read_records, write_archive

PAGES = "page_id bigint, url string, html string, DIGEST string, payload string, n string"
LONG = "<p>copy</p>" * 100
ODD = [
    (1, "http://a/1", LONG), (7, "http://a/7", LONG), (3, "http://a/3", LONG), (None, "http://a/none", LONG),
    (7, "http://a/7", LONG), (2, "http://b/ü x\r\ny", "short"), (4, None, "short"), (5, "", None), (6, "http://c", ""),
    (None, None, None), (8, "http://d", "é" * 499 + "xx"), (9, "http://d", "é" * 499 + "xx"),
    (10, "http://d", "y" * 999), (11, "http://d", "y" * 999), (12, "http://e", "z\r\n\r\n" * 100_000), (13, "http://f", "\x00" * 1000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*row, None, "x", "y") for row in rows], PAGES).repartition(3, "url")


def parsed(record):
    """Header fields and block of a record, read as its bytes stand."""
    head, rest = record.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1"
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    assert end == b"\r\n\r\n"
    return fields, block


def expected(rows):
    held = {}
    for page_id, _, html in rows:
        held.setdefault((html or "").encode(), []).append(page_id if page_id is not None else -1)
    out = []
    for body, ids in held.items():
        last = max(ids)
        first = True
        for page_id in sorted(ids, reverse=True):
            revisit = len(body) >= 1000 and not first
            first = False
            refers_to = (last if last >= 0 else None) if revisit else None
            out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", refers_to))
    return sorted(out, key=str)


def test_odd_pages(spark):
    path = write_archive(frame(spark, ODD))
    records = read_records(spark, path)
    found = describe_records(records).drop("url").collect()
    assert sorted([(-1 if r[0] is None else r[0], *r[1:]) for r in found], key=str) == expected(ODD)
    rebuilt = [(bytes(r.record), bytes(r.payload)) for r in records.collect()]
    wanted = sorted((html or "").encode() for _, _, html in ODD)
    assert sorted(payload for _, payload in rebuilt) == wanted
    ids = set()
    for record, payload in rebuilt:
        fields, block = parsed(record)
        http, body = block.split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(payload)}".encode() in http
        assert body == (payload if fields["WARC-Type"] == "response" else b"")
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
        ids.add(fields["WARC-Record-ID"])
    refers = {parsed(r)[0].get("WARC-Refers-To") for r, _ in rebuilt} - {None}
    assert len(ids) == len(ODD) and refers <= ids
    assert all(re.fullmatch(r"<urn:page:\d*:\d+>", i) for i in ids)


def test_payloads_are_stored_once(spark):
    path = write_archive(frame(spark, ODD))
    payloads = spark.read.parquet(f"{path}/payloads")
    assert payloads.count() == len({html or "" for _, _, html in ODD})
    assert spark.read.parquet(f"{path}/headers").columns == ["record_no", "digest", "header"]


def test_changed_payloads_are_noticed(spark, tmp_path):
    path = write_archive(frame(spark, ODD), str(tmp_path / "archive"))
    payloads = spark.read.parquet(f"{path}/payloads")
    wrong = F.when(F.col("payload") == F.lit(b"short"), F.lit(b"shorT")).otherwise(F.col("payload"))
    spark.read.parquet(f"{path}/headers").write.parquet(str(tmp_path / "wrong" / "headers"))
    payloads.withColumn("payload", wrong).write.parquet(str(tmp_path / "wrong" / "payloads"))
    with pytest.raises(Exception, match="no payload of digest"):
        read_records(spark, str(tmp_path / "wrong")).collect()
    payloads.where("payload != cast('short' as binary)").write.parquet(str(tmp_path / "less" / "payloads"))
    spark.read.parquet(f"{path}/headers").write.parquet(str(tmp_path / "less" / "headers"))
    with pytest.raises(Exception, match="no payload of digest"):
        read_records(spark, str(tmp_path / "less")).collect()


def test_no_pages(spark):
    assert describe_records(read_records(spark, write_archive(frame(spark, ODD).limit(0)))).count() == 0


def test_archive_matches_sql(spark, sf_dir):
    found = queries.op11_content_archive(spark, sf_dir)
    assert oracle.compare(found, oracle.connect(sf_dir), queries.ORACLES["op11_content_archive"]) == []
