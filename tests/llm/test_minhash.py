from __future__ import annotations

import random
import re

import numpy as np
import pytest
from meshwork.llm.minhash import BINS, near_duplicates, one_permutation, op6_minhash_near_dedup, shingle_sets

from pyspark.sql import functions as F

from .conftest import prose


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    """Components over all pairs; rows of one id are one node."""
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            c = len(s & t)
            if c and 100 * c >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(((d, len(shingles(t)), None if d is None else root(d), d is None or d == root(d)) for d, t in rows), key=str)


def run(df):
    return sorted(map(tuple, near_duplicates(df).collect()), key=str)


def test_shingles_equal_a_plain_count():
    data = "A b\tc d e f a b c d e\n".encode() + "x y".encode() + b"" + " ß é ü ö ä ß é ü ö ä".encode()
    off = np.cumsum([0, 22, 3, 0, len(data) - 25])
    texts = [data[a:b].decode() for a, b in zip(off, off[1:])]
    assert [len(s) for s in shingle_sets(np.frombuffer(data, np.uint8), off)] == [len(shingles(t)) for t in texts]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    a, b = np.sort(base[:360]), np.sort(base[40:])
    sig = one_permutation([a, b])
    assert abs((sig[0] == sig[1]).mean() - 320 / 400) < 0.12
    short = one_permutation([a[:1], a[::150]])  # far apart, so in three bins
    assert (short[0] == a[0]).all() and len(set(short[1])) == 3
    assert sig.shape == (2, BINS)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, odd_docs, no_docs, seed):
    """Chains of edits, so hubs differ from the ends: a star alone would lose links."""
    r, rows = random.Random(seed), [tuple(x) for x in odd_docs.select("doc_id", "text").collect()]
    n = 1000
    for c in range(12):
        words = prose(seed * 100 + c, r.choice([8, 40, 120])).split()
        for _ in range(15):
            rows.append((n, " ".join(words)))
            n += 1
            for _ in range(max(1, len(words) // 60)):
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    r.shuffle(rows)
    ids = list(range(1000, n))
    r.shuffle(ids)
    rows = [(d if d is None or d < 1000 else ids[d - 1000], t) for d, t in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert run(df) == brute(rows)
    if seed == 1:
        assert near_duplicates(no_docs).count() == 0


def test_the_exact_join_finds_what_a_star_loses(spark):
    words = prose(7, 200).split()
    rows = []
    for i in range(8):  # each differs from its neighbour by 3 words: J about 0.86; two apart J is below
        w = list(words)
        rows.append((i, " ".join(w)))
        for k in range(3):
            words[(i * 3 + k) * 8] = f"q{i}x{k}"
    ids = [3, 0, 5, 1, 7, 2, 6, 4]
    rows = [(ids[i], t) for i, t in rows]
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_the_query_and_clashing_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, op6_minhash_near_dedup(spark, sf).collect()), key=str) == want
    wide = docs.select("doc_id", "text", *[F.lit(3).alias(n) for n in ("digest", "bands", "rep", "band", "hub", "component", "shingles", "u", "v", "salt", "_hot")])
    assert run(wide) == want


def test_hubs_are_spread(spark, monkeypatch):
    """With every key of two rows a hot one, nothing changes."""
    from meshwork.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 1)
    words = prose(3, 150).split()
    rows = [(i, " ".join([*words[:140], f"own{i}", *words[141:]])) for i in range(40)] + [(100 + i, prose(50 + i, 30)) for i in range(5)]
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)
