from __future__ import annotations

import hashlib
import zlib
from collections import Counter

from meshwork.llm import sharding
from meshwork.llm.sharding import feistel, keys, shard_rows, widths
from pyspark.sql import functions as F


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 3, 7, 100, 1025):
        got = [r[0] for r in spark.range(n).select(feistel(F.col("id"), n, 1)).collect()]
        assert sorted(got) == list(range(n))


def test_shards_and_slots(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(odd_docs).unionByName(odd_docs)
    a, b = (sorted(map(tuple, shard_rows(docs.repartition(k), 4).collect()), key=str) for k in (1, 5))
    assert a == b  # partitions do not matter
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter(r[:3] for r in a) == want
    sizes = Counter(r[5] for r in a)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r[6] for r in a if r[5] == s) == list(range(n))
    assert {r[7] for r in a} == {None} and {r[3] for r in a} == {"rows"}
    assert shard_rows(no_docs).count() == 0


def test_a_hot_row_is_spread(spark):
    docs = spark.range(25_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = shard_rows(docs, 16).groupBy("shard").count().collect()
    assert {r[1] for r in got} == {1562, 1563}


def slow_place(x, n, seed):
    """The network and its walk, one number at a time."""
    high, low = widths(n)
    while True:
        left, right, sizes = x >> low, x % (1 << low), [high, low]
        for add, by, again in keys(seed):
            h = (right + add) * by % (2**31 - 1) * again % (2**31 - 19)
            left, right = right, left ^ h % (1 << sizes[0])
            sizes.reverse()
        x = left << low | right
        if x < n:
            return x


def test_against_a_plain_network(spark, odd_docs, monkeypatch):
    """Numbers, shards and slots of every row, for two numbers of buckets."""
    more = spark.createDataFrame([(i, f"text {i % 70}") for i in range(500)], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    rows = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in docs.collect()]
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{'null' if r[0] is None else r[0]} {r[1]} {r[2]}".encode()).hexdigest()[:8], r[0] is None, r[0] or 0, *r[1:]))
    want = [(*r, "rows", i, slow_place(i, len(rows), 7) % 16, slow_place(i, len(rows), 7) // 16, None) for i, r in enumerate(order)]
    assert sorted(map(tuple, shard_rows(docs.repartition(3)).collect()), key=lambda r: r[4]) == want
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)
    assert sorted(map(tuple, shard_rows(docs).collect()), key=lambda r: r[4]) == want


def test_neighbours_are_scattered(spark):
    """Over a fifth of neighbouring numbers would land in one shard of four if the network hardly mixed."""
    got = [r[0] for r in spark.range(5000).select(feistel(F.col("id"), 5000, 7)).collect()]
    assert abs(sum(a % 4 == b % 4 for a, b in zip(got, got[1:])) / 5000 - 0.25) < 0.03
    assert abs(sum(a < b for a, b in zip(got, got[1:])) / 5000 - 0.5) < 0.03


def test_no_python_in_the_plan(spark, odd_docs):
    import re

    assert not re.search("Python|Pandas|Arrow", shard_rows(odd_docs)._jdf.queryExecution().executedPlan().toString())
