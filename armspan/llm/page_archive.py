"""A WARC archive addressed by content: every payload once, exact record headers apart from it.

The archive is a folder of two Parquet tables. ``payloads`` has digest (SHA-256) and payload, a row for
each different payload. ``headers`` has record_no, digest and header: the exact bytes of a record up to
its payload, that is the WARC header and, in front of a web page, the HTTP header. Records are rebuilt by
joining the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armspan.llm.common import pick, stored
from armspan.session import fresh_path

# Fixed values of the WARC 1.1 format.
_END = "\r\n\r\n"
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def write_archive(
    pages: DataFrame, path: str | None = None, least_revisit: int = 1000, date: str = "1970-01-01T00:00:00Z"
) -> str:
    """Writes a WARC record for every row of ``pages`` (page_id, url, html) and returns the archive's folder.

    The payload is the html in UTF-8; null counts as empty. Of records with equal payloads of at least
    ``least_revisit`` bytes that with the largest page_id is a response and the others revisit it; all
    smaller ones are responses. ``path`` is a new folder that executors share, by default in the scratch
    folder. ``date`` is the date of all records.

    A payload goes by its SHA-256 and is stored once, whoever holds it: tasks keep one of each before the
    shuffle, so a payload that a third of the pages have is sent once a task. What meets under one digest
    has to agree in its SHA-1 and length too, or the write fails. Which record is the response is
    decided on digests alone.

    Null ids count as smallest. Repeated rows are records of their own; of equal ids the later row is the
    response. A null url leaves its header line out. Extra columns are ignored. An empty table gives an
    empty archive.
    """
    spark = pages.sparkSession
    root = (path or fresh_path(spark, "archive")).rstrip("/")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pick(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    digests = rows.select("digest", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"))
    once = digests.groupBy("digest").agg(
        F.first("payload").alias("payload"),
        ((F.min("sha1") == F.max("sha1")) & (F.min("n") == F.max("n"))).alias("same"),
    )
    problem = F.raise_error(F.concat(F.lit("different payloads under digest "), F.hex("digest"))).cast("binary")
    once = once.select("digest", F.when(F.col("same"), F.col("payload")).otherwise(problem).alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{root}/payloads")

    entries = stored(
        rows.select(
            F.monotonically_increasing_id().alias("record_no"), "page_id", "url", "digest",
            F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("n"),
        ),
        "archive-entries",
    )
    last = F.max(F.struct("page_id", "record_no")).alias("response")
    groups = entries.where(F.col("n") >= least_revisit).groupBy("digest").agg(last, F.count("*").alias("records"))
    # Only payloads that several records hold, stored: the join sees their size, and splits what many records share.
    groups = stored(groups.where("records > 1").select("digest", "response"), "archive-groups")
    headed = entries.join(groups, "digest", "left").select("record_no", "digest", _header(date).alias("header"))
    headed.write.option("compression", "zstd").parquet(f"{root}/headers")
    return root


def _record_id(page_id: Column, record_no: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), record_no, F.lit(">"))


def _header(date: str) -> Column:
    """The bytes of a record before its payload; a revisit's are all it has."""
    response = F.col("response")
    revisit = response.isNotNull() & (response["record_no"] != F.col("record_no"))
    http = F.format_string(_HTTP, "n")
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    # White space ends a header line, so what a url has of it is written as in other addresses.
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    lines = [
        F.lit(f"{_VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("record_no"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", _record_id(response["page_id"], response["record_no"])),
                line("WARC-Profile", F.lit(_PROFILE)),
            ),
        ).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    ]
    return F.concat(*lines).cast("binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, rebuilt: record_no, record (the bytes of a WARC file), header and payload.

    ``payload`` is the whole payload, of revisits too, whose ``record`` ends before it. Its digest is
    verified for every record; a payload that is missing or not what its digest says fails.
    The join is on digests: records of one payload are split over tasks where they are many.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    joined = headers.join(payloads, "digest", "left")
    whole = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    problem = F.raise_error(F.concat(F.lit("no payload of digest "), F.hex("digest"))).cast("binary")
    verified = joined.withColumn("payload", F.when(whole, F.col("payload")).otherwise(problem))
    is_response = _field(F.col("header"), "WARC-Type") == "response"
    body = F.when(is_response, F.col("payload")).otherwise(F.lit(b""))
    record = F.concat("header", body, F.lit(_END.encode()))
    return verified.select("record_no", record.alias("record"), "header", "payload")


def _field(header: Column, name: str) -> Column:
    """The value of a header line, null if there is none."""
    found = F.regexp_extract(header.cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.nullif(found, F.lit(""))


def describe_records(records: DataFrame) -> DataFrame:
    """One row per record of ``read_records``, as its header says: page_id, payload_bytes, payload_digest, record_type, refers_to.

    payload_bytes and payload_digest (SHA-1, hexadecimal) are those of the rebuilt payload; a header that states
    another digest, or a length that the record does not have, fails.
    """
    header = F.col("header")
    digest = F.sha1("payload")
    start = F.locate(_END, header.cast("string"))
    length = F.octet_length("record") - len(_END) - (F.octet_length(F.substring(header.cast("string"), 1, start - 1)) + len(_END))
    agrees = (_field(header, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)) & (
        _field(header, "Content-Length").cast("bigint") == length
    )
    page = lambda name: F.nullif(F.split_part(_field(header, name), F.lit(":"), F.lit(3)), F.lit("")).cast("bigint")
    problem = F.raise_error(F.concat(F.lit("record differs from its header: "), header.cast("string"))).cast("string")
    return records.select(
        page("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(agrees, digest).otherwise(problem).alias("payload_digest"),
        _field(header, "WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        _field(header, "WARC-Target-URI").alias("url"),
    )
