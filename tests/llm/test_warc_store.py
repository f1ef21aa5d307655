from __future__ import annotations

import hashlib

from meshwork.llm.common import shared_dir
from meshwork.llm.warc_store import read_archive, write_archive

ROWS = [(1, "http://a\r\nX: y", "p" * 200), (2, "http://b", "p" * 200), (3, None, "short"), (4, "http://d", "short"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 50), (9, "u", "é" * 50), (8, "u", "é" * 50), (7, "u", "é" * 50), (None, "n", "p" * 200), (None, "n", "q" * 300), (20, "long", "\x00é\r\n\r\n" * 300_000), (21, "long", "\x00é\r\n\r\n" * 300_000)]


def test_records_come_back_whole(spark):
    pages = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "page_id bigint, url string, html string, digest string, payload string")
    path = shared_dir(spark, "t")
    write_archive(pages, path)
    got = read_archive(spark, path).collect()
    assert len(got) == len(ROWS)
    firsts = {}
    for i, _, h in ROWS:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    for r in got:
        payload = bytes(r.payload)
        assert r.verified and hashlib.sha256(payload).hexdigest() == r.payload_digest and len(payload) == r.payload_bytes
        first = firsts.get(payload.decode())
        revisit = len(payload) >= 100 and first is not None and r.page_id != first
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == (first if revisit else None)
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in head
        block = b"" if revisit else payload
        assert rest == block + b"\r\n\r\n" and f"Content-Length: {len(block)}".encode() in head
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({h or "" for _, _, h in ROWS})


def test_hot_payloads_are_spread(spark, monkeypatch):
    """With every payload of two records a hot one, records come back all the same."""
    from meshwork.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 1)
    test_records_come_back_whole(spark)


def test_damage_is_found(spark):
    from pyspark.sql import functions as F

    path = shared_dir(spark, "t")
    write_archive(spark.createDataFrame([(1, "u", "p" * 200)], "page_id bigint, url string, html string"), path)
    bad = shared_dir(spark, "t")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"zzz")).write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    assert not read_archive(spark, bad).first().verified


def test_empty(spark):
    path = shared_dir(spark, "t")
    write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert read_archive(spark, path).count() == 0
