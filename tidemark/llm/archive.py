"""A content-addressed WARC archive.

``write`` keeps two tables in a folder: ``payloads`` holds every distinct payload once
under its SHA-256 address, ``heads`` holds each record's exact header bytes, in the order
of the pages, with the address. ``records`` joins them and gives back the original record
bytes; a payload whose digest is not its address stops the job. ``export`` writes records
as WARC text files, ``parse`` reads fields from record bytes.

Rows: a null html is an empty payload; a null url gets the target ``urn:page:<id>``.
Of equal payloads the row with the smallest page_id (then url; a null id last) is the
response and the others revisit it, repeated rows included. Other columns are not read.
An empty table makes an empty archive. Payloads are moved and stored whole.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the base32 alphabet, and the digits of Spark's conv() in the same order
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
# fixed values: field names and texts of the record format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: each five hex digits are four letters."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _record_id(page: Column, url: Column, copy: Column) -> Column:
    """A name of its own for every record, equal rows included."""
    parts = F.struct(page.cast("string").alias("p"), url.alias("u"), F.hex("address").alias("a"), copy.alias("c"))
    digest = F.md5(F.to_json(parts, {"ignoreNullFields": "false"}))
    parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _head(date: str) -> Column:
    """Header bytes of a record, the empty line and the HTTP head included."""
    uri = F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    for char, code in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        uri = F.replace(uri, F.lit(char), F.lit(code))
    response = F.col("record_type") == "response"
    size = F.when(response, F.col("payload_bytes")).otherwise(0) + len(HTTP)
    fields = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("url"), F.col("copy"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), _record_id(*[F.col(f"first.{c}") for c in ("page_id", "url", "copy")]))),
        F.when(~response, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
        F.when(~response, F.concat(F.lit("X-Refers-To-Page: "), F.col("refers_to").cast("string"))),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws("\r\n", *fields), F.lit("\r\n\r\n" + HTTP)), "UTF-8")


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2026-01-01T00:00:00Z") -> None:
    """Archive ``pages`` (page_id, url, html) in ``folder``. Payloads under ``min_bytes``
    are never revisited, though their bytes are stored once all the same."""
    raw = pages.select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("address", F.unhex(F.sha2("payload", 256)))
    # exactly repeated rows are counted, then numbered
    facts = (
        raw.groupBy(
            "page_id",
            "url",
            "address",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            base32_sha1(F.col("payload")).alias("payload_digest"),
        )
        .agg(F.count("*").alias("n"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    )
    order = F.struct(
        F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url", "copy"
    )
    # one row per payload leaves each task; the join with it can be split where a payload is common
    first = facts.groupBy("address").agg(F.min(order).alias("first"))
    response = (F.col("payload_bytes") < min_bytes) | (order == F.col("first"))
    heads = (
        facts.join(first, "address")
        .withColumn("record_type", F.when(response, "response").otherwise("revisit"))
        .withColumn("refers_to", F.when(~response, F.col("first.page_id")))
        .select("address", "record_type", _head(date).alias("head"))
    )
    heads.write.parquet(os.path.join(folder, "heads"), compression="zstd")
    payloads = raw.select("address", "payload").dropDuplicates(["address"])
    payloads.write.parquet(os.path.join(folder, "payloads"), compression="zstd")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``record`` bytes (header, payload of a response, closing line ends) of every page,
    with ``head`` length. A response without its payload, or with other bytes than its
    address says, stops the job."""
    heads = spark.read.parquet(os.path.join(folder, "heads"))
    payloads = spark.read.parquet(os.path.join(folder, "payloads"))
    end = F.lit(b"\r\n\r\n")
    good = F.unhex(F.sha2("payload", 256)) == F.col("address")
    whole = F.when(good, F.concat("head", "payload", end)).otherwise(
        F.raise_error(F.concat(F.lit("no verified payload at "), F.hex("address"))).cast("binary")
    )
    answers = heads.where("record_type = 'response'").join(payloads, "address", "left")
    return answers.select(whole.alias("record")).unionByName(
        heads.where("record_type = 'revisit'").select(F.concat("head", end).alias("record"))
    )


def parse(archive: DataFrame) -> DataFrame:
    """Fields of ``record`` bytes: page_id, url, payload, payload_bytes, payload_digest,
    record_type and refers_to. For a response, length and digest are worked out from the
    bytes read, for a revisit they are those of its header. A response whose payload is shorter
    than its header says stops the job."""
    # one character per byte, so that the place found is one of bytes
    end = F.instr(F.decode("record", "ISO-8859-1"), "\r\n\r\n")
    text = F.decode(F.substring("record", 1, end), "UTF-8")
    split = archive.select("record", end.alias("end"), F.concat(text, F.lit("\n")).alias("fields"))
    field = lambda name: F.nullif(
        F.regexp_extract("fields", rf"(?m)^{name}: (.*?)\r?$", 1), F.lit("")
    )
    size = field("Content-Length").cast("int") - len(HTTP)
    body = F.substring("record", F.col("end") + 4 + len(HTTP), size)
    whole = (F.octet_length(body) == size) & (size.cast("long") == field("X-Payload-Length").cast("long"))
    body = F.when(whole, body).otherwise(F.raise_error(F.concat(F.lit("no whole payload in "), "fields")).cast("binary"))
    payload = F.when(field("WARC-Type") == "response", body)
    return split.select(
        field("X-Page-Id").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        payload.alias("payload"),
        F.coalesce(F.octet_length(payload).cast("long"), field("X-Payload-Length").cast("long")).alias("payload_bytes"),
        F.coalesce(base32_sha1(payload), F.substring(field("WARC-Payload-Digest"), 6, 32)).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page").cast("long").alias("refers_to"),
    )


def export(archive: DataFrame, folder: str) -> None:
    """Write record bytes as WARC files, one per partition."""
    body = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string")
    archive.select(body).write.option("lineSep", "\r\n\r\n").text(folder)
