from __future__ import annotations

import hashlib

from meshwork.llm.fingerprints import edited, fingerprint, fingerprint_documents, likeness, op9_piecewise_fingerprints
from pyspark.sql import functions as F

from .conftest import prose


def slow_fingerprint(text):
    """Byte by byte."""
    import zlib

    raw = text.encode()
    level = 0
    while (3 << level) * 64 < len(raw):
        level += 1
    while True:
        sigs = []
        for block, most in ((3 << level, 64), (6 << level, 32)):
            window, ends = [0] * 7, []
            for i, b in enumerate(raw):
                window = [b, *window[:6]]
                s = 0
                for k in range(7):
                    s ^= window[k] << 5 * k & 0xFFFFFFFF if 5 * k < 32 else 0
                h = sum(window) + sum(w * (7 - k) for k, w in enumerate(window)) + s & 0xFFFFFFFF
                if (h + 1 & 0xFFFFFFFF) % block == 0:
                    ends.append(i)
            sig, at = "", 0
            for e in ends[: most - 1]:
                sig += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[zlib.crc32(raw[at : e + 1]) & 63]
                at = e + 1
            if at < len(raw):
                sig += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[zlib.crc32(raw[at:]) & 63]
            sigs.append((sig, len(ends)))
        if level == 0 or sigs[0][1] >= 32:
            return f"{3 << level}:{sigs[0][0]}:{sigs[1][0]}"
        level -= 1


def test_equals_the_byte_by_byte_form():
    for t in ("", "a", "aaaa" * 200, prose(1, 30), prose(2, 400), "é🎉" * 300):
        assert fingerprint(t) == slow_fingerprint(t)


def test_likeness(spark):
    a, b = prose(5, 400), prose(6, 400)
    rows = [(fingerprint(a), fingerprint(x)) for x in (a, a[:-200] + b[:200], b)] + [("3::", "3::"), ("3:abc:d", "6:d:x"), ("3:abc:d", "12:abc:d")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(likeness(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1 and got[1] > 0.7 and got[2] < 0.35 and got[3:] == [1, 1, 0]


def test_successors_against_a_sorted_list(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(i * 37 % 1000 + 50, prose(i, 5 + i % 40)) for i in range(200)], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more).repartition(5)
    rows = sorted(((d, t or "") for d, t in map(tuple, docs.collect())), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        e = edited(t, rows[(i + 1) % len(rows)][1])
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t), fingerprint(e), fingerprint(rows[(i + 1) % len(rows)][1])))
    got = sorted(map(tuple, fingerprint_documents(docs).collect()), key=str)
    assert got == sorted(want, key=str)
    assert fingerprint_documents(no_docs).count() == 0
    alone = fingerprint_documents(docs.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0].next_fingerprint == alone[0].fingerprint


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def slow_likeness(a, b):
    (ka, *sa), (kb, *sb) = a.split(":"), b.split(":")
    score = lambda x, y: 1 - distance(x, y) / max(len(x), len(y)) if x or y else 1.0
    if a == b:
        return 1.0
    if ka == kb:
        return max(score(sa[0], sb[0]), score(sa[1], sb[1]))
    return score(sa[0], sb[1]) if int(ka) == 2 * int(kb) else score(sa[1], sb[0]) if 2 * int(ka) == int(kb) else 0.0


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in op9_piecewise_fingerprints(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        e, r = edited(t, following), got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t), fingerprint(e))
        assert abs(r.near_edited - slow_likeness(fingerprint(t), fingerprint(e))) < 1e-12
        assert abs(r.near_next - slow_likeness(fingerprint(t), fingerprint(following))) < 1e-12
    for d, t in rows[::25]:
        assert fingerprint(t) == slow_fingerprint(t)


def test_clashing_columns_and_long_texts(spark):
    """Extra columns with the names that the operator uses itself, and a text of a million characters."""
    rows = [(3, prose(1, 50)), (2, "é" * 500_000 + prose(2, 90_000)), (1, None)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string")
    wide = plain.select("*", *[F.lit(7).alias(n) for n in ("id", "part", "echo", "p", "n_chars", "fingerprint")])
    got = [sorted(map(tuple, fingerprint_documents(df).collect())) for df in (plain, wide)]
    assert got[0] == got[1] and [r[3] for r in got[0]] == [fingerprint(t or "") for _, t in sorted(rows)]
