from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import sentencepiece
from meshwork.llm.pieces import CharMap, codec, encode_documents, op5_offset_preserving_pieces
from pyspark.sql import functions as F

LIB = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _check(texts):
    c = codec()
    for text, ids in c.encode(texts):
        want = [1, *LIB.encode(text), 2]
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert c.decode(ids) == LIB.decode(want), repr(text)


def test_random_texts_equal_the_library():
    r = random.Random(1)
    _check(["".join(r.choice("ab \n▁éж日🎉<>0x.s \t'") for _ in range(r.randrange(50))) for _ in range(3000)])
    _check(["", " ", "  ", " a", "a ", "<s>", "</s> <unk> <0x41>", "a\0b", "x" * 5000, "\n\n", "▁▁ ▁"])


def test_decode_of_any_ids_equals_the_library():
    r, c = random.Random(2), codec()
    for _ in range(5000):
        ids = [r.choice([r.randrange(32000), r.randrange(262)]) for _ in range(r.randrange(8))]
        assert c.decode(np.array(ids, "<u4").tobytes()) == LIB.decode(ids), ids


def test_spans_cover_the_source():
    c = codec()
    for text in ("hello wörld  日本🎉\n x", "a", " lead", ""):
        [(_, ids)] = list(c.encode([text]))
        spans, raw = c.spans(text, ids), text.encode()
        assert spans[0] == (0, 0) and spans[-1][1] == len(raw)
        inner = [s for s in spans if s[0] < s[1]]
        assert b"".join(raw[a:b] for a, b in inner) == raw


def _compiled(table: dict[bytes, bytes]) -> bytes:
    """A small double-array trie by brute-force placement, in the format of compiled character maps."""
    pool, at = b"", {}
    for k, v in table.items():
        at[k] = len(pool)
        pool += v + b"\0"
    units, used = [0] * 4096, {0}

    def place(prefix: bytes, pos: int):
        nxt = sorted({k[len(prefix)] for k in table if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in table
        labels = [*([0] if leaf else []), *nxt]
        for off in range(1, 1 << 11):
            spots = [pos ^ off ^ x for x in labels]
            if all(s < len(units) and s not in used for s in spots) and len(set(spots)) == len(spots):
                break
        used.update(spots)
        units[pos] |= off << 10 | (leaf << 8)
        if leaf:
            units[pos ^ off] = 0x80000000 | at[prefix]
        for x in nxt:
            units[pos ^ off ^ x] |= x
            place(prefix + bytes([x]), pos ^ off ^ x)

    place(b"", 0)
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + pool


def test_longest_prefix_normalisation_keeps_the_alignment():
    table = {b"A": b"a", b"AB": b"xyz", "ß".encode(): b"ss", b"\t": b" "}
    m = CharMap(_compiled(table))
    assert m.longest(b"ABC", 0) == (b"xyz", 2)
    assert m.longest(b"AC", 0) == (b"a", 1)
    assert m.longest(b"C", 0) is None
    import copy

    c = copy.copy(codec())
    c.map, c.squeeze = m, True
    text, at = c.normalise("  ABß\t\tAq ")
    assert text == "▁xyzss▁aq"
    assert at.tolist() == [2, 2, 2, 2, 2, 2, 4, 4, 6, 6, 6, 8, 9, 10]


def test_documents(spark, odd_docs, no_docs):
    got = encode_documents(odd_docs).collect()
    texts = {}
    for r in odd_docs.select("doc_id", "text").collect():
        texts.setdefault(r[0], []).append([1, *LIB.encode(r[1] or ""), 2])
    assert len(got) == odd_docs.count()
    assert all(r.ids in texts[r.doc_id] for r in got)
    assert encode_documents(no_docs).count() == 0
    short = encode_documents(odd_docs, digest=True).where("doc_id = 4").first()
    assert short.n_tokens == 2


def test_spans_equal_the_library():
    r, c = random.Random(3), codec()
    assert c.is_byte[np.frombuffer(next(iter(c.encode(["ꙮ"])))[1], "<u4")].sum() == 3
    for text, ids in c.encode(["".join(r.choice("ab \n▁éж日🎉ꙮ𝄞<>0x.s \t'") for _ in range(r.randrange(50))) for _ in range(2000)]):
        want = [(p.begin, p.end) for p in LIB.encode(text, return_type="proto").pieces]
        assert c.spans(text, ids)[1:-1] == want, repr(text)


def test_the_query_takes_its_digests_from_the_full_output(spark, odd_docs):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(r.doc_id), len(r.ids), sha(np.array(r.ids, "<i4").tobytes()), sha(np.array([*zip(r.starts, r.ends)], "<i8").tobytes()), sha(r.decoded.encode())) for r in encode_documents(odd_docs).collect())
    got = encode_documents(odd_docs, digest=True)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.spans_sha256, r.decoded_sha256) for r in got.collect()) == want
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in encode_documents(odd_docs.where("doc_id IS NOT NULL")).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends)) == raw


def test_the_query(spark):
    """Ids, text and spans of every document by the library."""
    sf = "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: r for r in op5_offset_preserving_pieces(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        text, r = d.text or "", got[d.doc_id]
        ids = [1, *LIB.encode(text), 2]
        spans = [(0, 0), *((p.begin, p.end) for p in LIB.encode(text, return_type="proto").pieces), (len(text.encode()),) * 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes())), d.doc_id
        assert r.decoded_sha256 == sha(LIB.decode(ids).encode()) and r.spans_sha256 == sha(np.array(spans, "<i8").tobytes()), d.doc_id


def test_clashing_columns(spark, odd_docs):
    """Extra columns with the names that the operator uses itself."""
    wide = odd_docs.select("doc_id", "text", *[F.lit(1).alias(n) for n in ("ids", "starts", "ends", "decoded", "n_tokens")])
    plain = odd_docs.select("doc_id", "text")
    assert sorted(map(str, encode_documents(wide).collect())) == sorted(map(str, encode_documents(plain).collect()))
