"""A content-addressed WARC archive.

Three parts: `payloads` holds each payload's bytes once under its SHA-256; `headers` holds every
record's exact header bytes; reading joins them and gives the original records byte for byte.

Of records with equal payloads of at least 100 bytes the one with the smallest page_id is a
`response`, the others are `revisit` records without a block of their own; smaller payloads are
always `response`. The payload's one shuffle combines copies on the map side, so a payload that a
third of all records hold crosses the network once per task. Records of such a payload are spread over all tasks: its facts are broadcast when
writing, and copies of it, one for each hot_limit of its records, meet them when reading.

Defined cases: null html is an empty payload; null url is an empty target URI; rows that repeat a page_id
and its html are records of their own, all `response` if they hold the smallest page_id; a null
page_id is a record whose Record-ID ends in `null`, and a payload that only such records hold has
them all as `response`; pages carry no time of capture, so all records of an archive have the one WARC-Date that is
given; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_limit, join_hot, shared_dir, table

MIN_REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(is_revisit: Column, date: str) -> Column:
    uri = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", " ")
    rid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", rid(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", rid(F.col("first_id"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(is_revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, date: str = DATE) -> None:
    """Write `pages` (page_id, url, html) below `path` as payloads/ and headers/; `date` as WARC has it (UTC, ISO 8601)."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    records = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    once = records.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first_id"), F.count("*").alias("records"))
    once.withColumn("payload_bytes", F.octet_length("payload").cast("long")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    index = spark.read.parquet(f"{path}/payloads").select("digest", "first_id", "payload_bytes", "records")
    light = join_hot(pages.select("page_id", "url", F.sha2(payload, 256).alias("digest")), index, "digest", "records", hot_limit(_records(index)))
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    light.select("page_id", "digest", F.encode(_header(revisit, date), "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _records(payloads: DataFrame) -> int:
    return payloads.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, record_type, refers_to, payload_digest and payload_bytes (both recomputed
    from the stored payload), verified, payload (the full one, for revisits too) and record, the original
    bytes. Each stored payload is hashed once, before the join; columns that are not asked
    for are pruned there."""
    payloads = spark.read.parquet(f"{path}/payloads")
    limit = hot_limit(_records(payloads))
    copies = F.ceil(F.col("records") / limit)
    stored = payloads.select(F.col("digest").alias("stored_digest"), "records", "payload", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    stored = stored.withColumn("stored_salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    # At most MAX_HOT payloads have more than `limit` records.
    hot = F.broadcast(payloads.where(F.col("records") > limit).select("digest", copies.alias("copies")))
    head = F.decode("header", "UTF-8")
    salt = F.coalesce(F.pmod(F.xxhash64("page_id", "header"), F.col("copies")), F.lit(0))
    headers = spark.read.parquet(f"{path}/headers").join(hot, "digest", "left").select(
        "page_id", "digest", "header", salt.alias("salt"),
        F.regexp_extract(head, "\r\nWARC-Type: ([a-z]+)\r\n", 1).alias("record_type"),
        F.expr("try_cast(nullif(regexp_extract(decode(header, 'UTF-8'), '\\r\\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\\r\\n', 1), '') as bigint)").alias("refers_to"),
    )
    both = headers.join(stored, (headers.digest == stored.stored_digest) & (headers.salt == stored.stored_salt), "left")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return both.select("page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", F.coalesce(F.col("payload_digest") == F.col("digest"), F.lit(False)).alias("verified"), "payload", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def op4_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With record_sha256, the digest of each original record as rebuilt from header and payload."""
    path = shared_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified", F.sha2("record", 256).alias("record_sha256"))


OP4_SQL = rf"""
WITH r AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g') AS uri, encode(coalesce(html, '')) AS p FROM pages),
d AS (SELECT *, octet_length(p)::BIGINT AS payload_bytes, sha256(p) AS payload_digest,
             min(page_id) OVER (PARTITION BY sha256(p)) AS first_id, chr(13) || chr(10) AS nl FROM r),
k AS (SELECT *, payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> first_id AS again FROM d),
h AS (SELECT *, 'WARC/1.1' || nl || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl
        || 'WARC-Date: {DATE}' || nl || 'WARC-Target-URI: ' || uri || nl || 'WARC-Payload-Digest: sha256:' || payload_digest || nl
        || CASE WHEN again THEN 'WARC-Profile: {_PROFILE}' || nl || 'WARC-Refers-To: <urn:page:' || first_id || '>' || nl ELSE '' END
        || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE payload_bytes END || nl || nl AS header FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to,
       true AS verified, sha256(encode(header) || CASE WHEN again THEN ''::BLOB ELSE p END || encode(nl || nl)) AS record_sha256
FROM h
"""
