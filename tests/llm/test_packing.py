from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from meshwork.llm.packing import HarmonicBins, _encoder, op2_harmonic_packing, pack
from tokenizers import Tokenizer


def raw(n, first=0):
    return np.arange(first, first + n, dtype="<u4").tobytes()


def test_a_class_takes_its_count_of_whole_documents():
    """Three documents of class 3 (over 4 of 16 ids, at most 5), then the head of the next fills what is left."""
    b = HarmonicBins(16, 3)
    assert b.add("a", raw(5)) == b.add("b", raw(5)) == b.add("c", raw(4)) == []
    assert b.add("e", raw(5)) == []
    got = b.add("f", raw(7))
    assert [(r[0], r[1], r[2], r[6]) for r in got] == [("a", 0, 5, 0), ("b", 0, 5, 5), ("e", 0, 5, 10), ("f", 0, 1, 15)]
    assert {r[5] >> 40 for r in got} == {3} and got[0][3] == zlib.crc32(raw(5))


@pytest.mark.parametrize("seed", range(5))
def test_all_bins_are_full_and_hold_each_id_once(seed):
    r = random.Random(seed)
    docs = {i: raw(r.choice([1, 2, 3, r.randrange(1, 40), r.randrange(1, 400)]), 1000 * i) for i in range(r.randrange(1, 300))}
    b, rows = HarmonicBins(64, 0, True), []
    for i, ids in docs.items():
        rows += b.add(i, ids)
    whole = len(rows)
    rows += b.rest()
    seqs, back = defaultdict(list), defaultdict(bytes)
    for doc, start, length, crc, n, seq, at, ids in sorted(rows, key=lambda x: (x[0], x[1])):
        assert start == len(back[doc]) // 4 and n == len(docs[doc]) // 4 and crc == zlib.crc32(ids) and length == len(ids) // 4
        back[doc] += ids
        seqs[seq].append((at, length))
    assert back == docs and sorted(seqs) == list(range(len(seqs)))
    sizes = {k: sum(n for _, n in v) for k, v in seqs.items()}
    assert all(at == sum(n for o, n in v if o < at) for v in seqs.values() for at, _ in v)
    assert all(sizes[row[5]] == 64 for row in rows[:whole]) and all(n & (n - 1) == 0 for n in sizes.values())
    assert sum(n < 64 for n in sizes.values()) <= 6


def test_random_texts_and_long_runs_equal_the_library():
    t, encode, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), _encoder("byte_bpe_50k.json"), random.Random(8)
    texts = ["".join(r.choice("abC 12\n\r\t.,'!éж日🎉\u00a0\u3000<|>\x00_") for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += [c * n + e for c in " \n\t\u3000" for n in (999, 30_000, 1_000_000) for e in ("", "x")] + ["a " * 50_000, "<|endoftext|> x"]
    for text in texts:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids, repr(text[:50])


def test_pieces_against_the_library(spark, odd_docs, no_docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack(odd_docs.repartition(3), with_ids=True).collect()
    texts = defaultdict(list)
    for r in odd_docs.select("doc_id", "text").collect():
        texts[r[0]].append([*t.encode(r[1] or "", add_special_tokens=False).ids, 1])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert any(x[r.start : r.start + r.length] == ids and len(x) == r.doc_tokens for x in texts[r.doc_id])
        assert zlib.crc32(r.ids) == r.ids_crc32
    assert sum(r.length for r in got) == sum(len(x) for v in texts.values() for x in v)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0  # no padding at all
    assert pack(no_docs).count() == 0


def test_the_query(spark):
    """Every id of every document once, by the library; padding only below a power of two."""
    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got, upto, seqs = op2_harmonic_packing(spark, sf).orderBy("doc_id", "start").collect(), defaultdict(int), defaultdict(list)
    for r in got:
        assert r.start == upto[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        upto[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : upto[r.doc_id]].tobytes())
        seqs[r.sequence_id].append((r.offset, r.length))
    assert upto == {d: len(x) for d, x in ids.items()}
    for v in seqs.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))]
        assert (size := sum(n for _, n in v)) <= 2048 and size & (size - 1) == 0
    assert len(got) < 2 * len(ids) + sum(map(len, ids.values())) / 2048 + 100
