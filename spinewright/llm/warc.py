"""Content-addressed WARC archive, in DataFrame functions.

Two Parquet tables in a folder that all executors share: ``payloads`` holds each distinct payload's bytes once
under its SHA-256, ``headers`` each record's exact WARC header and HTTP header blocks with the digest they point to.
A record is the WARC header, the HTTP header, the payload for a response, and two line ends; joining the tables on the
digest rebuilds it, byte for byte. Reading back recomputes the digests from the stored bytes and fails on a mismatch.

Records follow WARC/1.1: each has its own ``WARC-Record-ID``, a date, a length that is its block's, and the SHA-1 of
its payload; a revisit names the profile of identical payloads and the response it refers to. Ids are UUIDs made of a
row's place in the archive, so rows that repeat an id, or have none, differ.

A null html is an empty payload; a null url is an empty target. Line ends in a url, which no header can hold, are
percent-encoded in the target and the exact url goes into ``X-Target-URI-Base64``. Rows with a null page_id get a
record, but never serve others as their response unless all of the copies lack one. Of rows that tie for a payload's
response (one page_id twice), the one that comes first in the archive is it. Very long payloads are stored whole.
Repeated rows get a record each; an empty table gives an archive without records. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads under so many bytes are always stored as responses.
REVISIT_BYTES = 1000
#: The date of records whose table has none.
CAPTURED = "2000-01-01T00:00:00Z"
# Fixed value: the profile of revisits whose payload equals that of the record they refer to.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(name: Column) -> Column:
    """A UUID of version 3 that follows from a name."""
    h = F.md5(name.cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def _record_id(seq: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), _uuid(F.concat(F.lit("record "), seq.cast("string"))), F.lit(">"))


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, captured: str = CAPTURED) -> None:
    """Write one WARC record for each row of ``page_id, url, html`` into ``path``."""
    spark = pages.sparkSession
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body")).select("page_id", "url", "body", F.sha2("body", 256).alias("sha256"))
    # ``seq`` is a row's place in the archive, fixed once it is written
    described = rows.select("page_id", "url", "sha256", F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("seq"))
    described.write.parquet(f"{path}/described")
    described = spark.read.parquet(f"{path}/described")
    first = described.groupBy("sha256").agg(F.max(F.struct("page_id", (-F.col("seq")).alias("back"))).alias("x"), F.max("bytes").alias("bytes"))
    first = first.select("sha256", F.col("x.page_id").alias("first_id"), (-F.col("x.back")).alias("first_seq"), "bytes")
    # each payload's bytes once: only the first record's row is kept. Rows are dealt by id, so copies spread out,
    # and rows that repeat an id and a payload meet in the same task
    keyed = lambda df, c: df.withColumn("key", F.coalesce(F.col(c), F.lit(-(1 << 63))))
    stored = keyed(rows, "page_id").join(keyed(first.select("sha256", "first_id"), "first_id"), ["key", "sha256"], "left_semi")
    stored.select("key", "sha256", "body").dropDuplicates(["key", "sha256"]).select("sha256", "body").write.parquet(f"{path}/payloads")
    first_of = first.where(F.col("bytes") >= revisit_bytes).select("sha256", "first_id", "first_seq")
    # a group of copies is one key of the join; adaptive execution splits it
    headed = described.join(first_of, "sha256", "left")
    # of rows with one page_id and payload only the first in the archive is the response
    revisit = F.col("first_seq").isNotNull() & (F.col("seq") != F.col("first_seq"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    url = F.coalesce("url", F.lit(""))
    lines = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("seq"))), F.lit(f"WARC-Date: {captured}"),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.when(F.contains(url, F.lit("\r")) | F.contains(url, F.lit("\n")), F.concat(F.lit("X-Target-URI-Base64: "), F.replace(F.replace(F.base64(F.encode(url, "UTF-8")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")), F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_seq")))), F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("first_id").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string")), F.lit("\r\n"),
    )
    headed.select("sha256", lines.alias("header"), http.alias("http")).write.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``sha256, body, sha1, bytes`` with the digests recomputed; raises if stored bytes don't match their key."""
    p = spark.read.parquet(f"{path}/payloads")
    ok = F.sha2("body", 256) == F.col("sha256")
    digest = F.when(ok, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("sha256"))))
    return p.select(digest.alias("sha256"), "body", F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("bytes"))


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records read back: ``page_id, url, record_type, refers_to, payload_digest, payload_bytes, html, record``.

    ``record`` is the record's bytes as in a WARC file; ``html`` the full payload also for revisits. Columns that
    are not selected are not read, so the bytes move only where they are asked for.
    """
    headers, payloads = spark.read.parquet(f"{path}/headers"), read_payloads(spark, path)
    number = lambda name: F.when(_field(name) != "", _field(name)).cast("long")
    exact = _field("X-Target-URI-Base64")
    kind = _field("WARC-Type")
    joined = headers.join(payloads, "sha256")
    # the header's own digest and length must be the stored payload's
    same = (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1"))) & (_field("X-Payload-Length") == F.col("bytes").cast("string"))
    return joined.select(
        number("X-Page-ID").alias("page_id"), F.when(exact != "", F.decode(F.unbase64(exact), "UTF-8")).otherwise(_field("WARC-Target-URI")).alias("url"),
        kind.alias("record_type"), number("X-Refers-To-Page-ID").alias("refers_to"),
        F.when(same, F.col("sha1")).otherwise(F.raise_error(F.lit("a header names another payload"))).alias("payload_digest"), F.col("bytes").alias("payload_bytes"),
        F.decode("body", "UTF-8").alias("html"),
        F.concat(F.encode("header", "UTF-8"), F.encode("http", "UTF-8"), F.when(kind == "response", F.col("body")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n")).alias("record"),
    )
