"""Content-addressed archive of WARC records (10).

The archive is two Parquet tables. `payloads` has each distinct payload once, under its SHA-256; `records` has one row a
record with the record's exact header bytes and no payload. Reading joins records with payloads by digest, verifies the
digest and the length of every payload, and parses the headers again, so that results come from what was stored.

round_trip() goes all the way: each response is put together as the bytes of a WARC record, and type, length and digest are
taken from these bytes; a revisit has its payload from the record that it refers to. Payloads are stored in buckets of
their digest, so they are shuffled once, when equal ones are found, and not again when records are put together.

Defined results: a null payload is empty; of equal payloads of at least `least_bytes` bytes the records with the smallest
id are responses and the others revisit it, shorter ones are all responses; rows with null ids revisit where their
payload has a record with an id, and are responses otherwise; repeated rows give a record each; an empty table gives an
empty archive; other columns are not archived.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.session import new_folder

CRLF = "\r\n"


def _header(field: str) -> Column:
    """The value of a header field within the stored header text."""
    return F.nullif(F.regexp_extract("header", rf"(?m)^{field}: ([^\r\n]*)", 1), F.lit(""))


def records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least_bytes: int = 100) -> tuple[DataFrame, DataFrame]:
    """The two tables of the archive: (records, payloads)."""
    url = F.coalesce(F.regexp_replace(F.col(url_col), r"[\r\n]", "%20"), F.lit("")) if url_col else F.lit("")
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.encode(body, "UTF-8").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("length"))
    slim = rows.drop("payload")
    first = slim.where(F.col("length") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("response_id"))
    # The many records of one payload meet a single row: Spark splits such a partition of the join.
    placed = slim.join(first, "digest", "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("response_id")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("X-Payload-Length: "), F.col("length").cast("string")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("length").cast("string"))),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))
    payloads = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    return placed.select("page_id", "digest", F.encode(header, "UTF-8").alias("header")), payloads


def write(pages: DataFrame, folder: str, compression: str = "zstd", **names: object) -> str:
    """Writes the archive below folder; returns folder."""
    rows, payloads = records(pages, **names)
    rows.write.option("compression", compression).parquet(f"{folder}/records")
    payloads.write.option("compression", compression).parquet(f"{folder}/payloads")
    return folder


def write_bucketed(pages: DataFrame, folder: str, compression: str = "zstd", **names: object) -> tuple[DataFrame, DataFrame]:
    """As write(), payloads in buckets by digest, which read() takes as plain files. Returns (records, payloads); the
    payloads keep their buckets as long as this session plans with them."""
    spark = pages.sparkSession
    rows, payloads = records(pages, **names)
    rows.write.option("compression", compression).parquet(f"{folder}/records")
    name, buckets = f"payloads_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = payloads.write.format("parquet").option("compression", compression).option("path", f"{folder}/payloads")
    out.bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)
    return spark.read.parquet(f"{folder}/records"), spark.table(name)


def _parsed(rows: DataFrame) -> DataFrame:
    """Stored records with the fields of their headers."""
    return rows.select(F.decode("header", "UTF-8").alias("header")).select(
        "header",
        F.regexp_extract(_header("WARC-Record-ID"), r"<urn:page:(-?[0-9]*)>", 1).try_cast("long").alias("page_id"),
        _header("WARC-Type").alias("record_type"),
        F.regexp_extract(_header("WARC-Refers-To"), r"<urn:page:(-?[0-9]+)>", 1).try_cast("long").alias("refers_to"),
        F.regexp_extract(_header("WARC-Payload-Digest"), "sha256:([0-9a-f]+)", 1).alias("payload_digest"),
        _header("X-Payload-Length").try_cast("long").alias("payload_bytes"),
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record again: page_id, record_type, refers_to, payload_digest, payload_bytes, header, payload; `verified`
    is false where the stored payload does not fit the header's digest or length.

    Payloads are hashed where they lie, once each; with the records only their digests and lengths are joined, unless
    the caller selects `payload` itself.
    """
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        F.col("digest").alias("stored_digest"),
        F.sha2("payload", 256).alias("found_digest"),
        F.octet_length("payload").cast("long").alias("found_bytes"),
        "payload",
    )
    rows = _parsed(spark.read.parquet(f"{folder}/records"))
    joined = rows.join(payloads, rows.payload_digest == payloads.stored_digest, "left")
    good = (F.col("found_digest") == F.col("payload_digest")) & (F.col("found_bytes") == F.col("payload_bytes"))
    return joined.withColumn("verified", F.coalesce(good, F.lit(False))).drop("stored_digest", "found_digest", "found_bytes")


def record_bytes() -> Column:
    """The whole WARC record of a row of read(): header, the payload of a response, and the closing blank lines."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n"))


def _taken_apart(record: Column, header_bytes: Column) -> tuple[Column, Column]:
    """Digest and length of the payload within the bytes of a response record."""
    text = F.substring(record, F.lit(1), header_bytes).cast("string")
    length = F.regexp_extract(text, r"(?m)^Content-Length: ([0-9]+)", 1).cast("int")
    # The record ends with the payload and two line ends.
    payload = F.substring(record, F.octet_length(record) - length - 3, length)
    return F.sha2(payload, 256), F.octet_length(payload).cast("long")


def rebuilt(rows: DataFrame, payloads: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, record_type, refers_to and, out of the bytes of the record that holds the payload, payload_digest and
    payload_bytes. Payloads of `least_bytes` and more are in one response each and meet it in their bucket; shorter ones may
    be in very many, so they are few bytes that Spark may shuffle and split."""
    parsed = _parsed(rows)
    responses = parsed.where("record_type = 'response'")
    stored = payloads.select(F.col("digest").alias("payload_digest"), "payload")
    long_, length = F.octet_length("payload") >= least_bytes, F.col("payload_bytes") >= least_bytes
    whole = responses.where(length).join(stored.where(long_), "payload_digest")
    whole = whole.unionByName(responses.where(~length).join(stored.where(~long_), "payload_digest"))
    digest, size = _taken_apart(F.col("record"), F.octet_length("header"))
    names = F.col("payload_digest").alias("stored_digest"), F.col("payload_bytes").alias("stored_bytes")
    found = whole.withColumn("record", record_bytes()).select("page_id", *names, digest.alias("payload_digest"), size.alias("payload_bytes"))
    same = (F.col("payload_digest") == F.col("stored_digest")) & (F.col("payload_bytes") == F.col("stored_bytes"))
    checked = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload does not fit its digest")))
    found = found.withColumn("payload_digest", checked)
    # A payload with revisits is long, and its one response is found again by the digest.
    targets = found.where(F.col("stored_bytes") >= least_bytes).groupBy("stored_digest").agg(F.first("payload_digest").alias("d"), F.first("payload_bytes").alias("b"))
    again = parsed.where("record_type = 'revisit'").join(targets, F.col("payload_digest") == F.col("stored_digest"), "left")
    again = again.select("page_id", F.coalesce("d", F.raise_error(F.lit("a revisit refers to no record")).cast("string")).alias("payload_digest"), F.col("b").alias("payload_bytes"), "record_type", "refers_to")
    none = F.lit(None).cast("long")
    return found.select("page_id", "payload_digest", "payload_bytes", F.lit("response").alias("record_type"), none.alias("refers_to")).unionByName(again)


def round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Archives the pages in the shared folder and returns the records as rebuilt from what is stored."""
    spark = pages.sparkSession
    stored = write_bucketed(pages, new_folder(spark, "archive"), least_bytes=least_bytes)
    return rebuilt(*stored, least_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
