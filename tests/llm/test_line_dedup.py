from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from meshwork.llm import line_dedup
from meshwork.llm.line_dedup import PerfectHash, dedup_lines

LAST = (1 << 63) - 1


def brute(rows):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(LAST if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        me = LAST if d is None else d
        stay = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == me]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_perfect_hash_is_minimal_and_perfect():
    r = np.random.default_rng(1)
    for n in (1, 2, 1000, 20_000):
        h1, h2 = r.integers(0, 1 << 63, n, dtype=np.uint64), r.integers(0, 1 << 63, n, dtype=np.uint64)
        at = PerfectHash.build(h1, h2).index(h1, h2)
        assert sorted(at.tolist()) == list(range(n))
    assert len(PerfectHash.build(h1[:0], h2[:0]).index(h1[:5], h2[:5])) == 5


def test_against_brute_force(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 7)
    monkeypatch.setattr(line_dedup, "PART_BYTES", 2000)
    extra = [(100 + i, "\n".join(["The shared line of all", f"own line number {i}", " \tTHE SHARED line of all\r", "short"]), "en", "a", 1) for i in range(300)]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(docs).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    wide = dedup_lines(odd_docs)
    assert wide.columns[: len(odd_docs.columns)] == odd_docs.columns and wide.count() == odd_docs.count()
    assert dedup_lines(no_docs).count() == 0


def test_rows_that_repeat_are_spread(spark, monkeypatch):
    """One id and text many times over: several parts hold its rows, and each knows which lines go."""
    monkeypatch.setattr(line_dedup, "PART_BYTES", 500)
    rows = [(5, "the line that stays here\nanother of my own lines")] * 60 + [(1, "The line that stays here")] + [(9, "another of my own lines\nlast")] * 3 + [(None, "last of the long lines")] * 40 + [(2, "last of the long lines")]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id bigint, text string, own string, spread string, base int")
    got = dedup_lines(docs.repartition(3))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=str) == brute(rows)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
