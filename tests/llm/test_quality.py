from __future__ import annotations

import math
import re
import zlib

import numpy as np
from meshwork.llm import quality
from meshwork.llm.quality import WIDTH, AttentionModel, fit_quality, held_out, op3_attention_quality, passages, score_documents

from .conftest import prose


def test_every_passage_is_encoded():
    texts = [b"", prose(1, 200).encode(), b"  ", prose(2, 64).encode(), prose(3, 65).encode()]
    off = np.cumsum([0, *map(len, texts)])
    x, count = passages(np.frombuffer(b"".join(texts), np.uint8), off)
    assert count.tolist() == [1, 4, 1, 1, 2] and x.shape == (9, WIDTH)
    alone, _ = passages(np.frombuffer(texts[4], np.uint8), np.array([0, len(texts[4])]))
    assert np.allclose(x[7:], alone, atol=1e-6)


def test_gradients_equal_differences():
    r = np.random.default_rng(1)
    m, x, count, y = AttentionModel(5), r.normal(size=(7, 5)), np.array([3, 1, 3]), np.array([1.0, 0, 1])
    loss = lambda: -np.mean(y * np.log(s := m.forward(x, count)[-1]) + (1 - y) * np.log(1 - s))
    for k, g in m.gradients(x, count, y).items():
        flat, at = m.p[k].reshape(-1), 0
        old = flat[at]
        flat[at] = old + 1e-6
        up = loss()
        flat[at] = old - 1e-6
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-6 - g.reshape(-1)[at]) < 1e-6, k


def test_fits_and_scores(spark, odd_docs, no_docs):
    rows = [(i, prose(i, 80) if i % 3 else "!!! BUY $$$ " * 60) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    model = fit_quality(docs, labels)
    got = score_documents(docs, model).withColumn("out", held_out()).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    tested = [r for r in got if r.out]
    assert sum((r.score >= 0.3) == (r.doc_id % 3 > 0) for r in tested) >= 0.97 * len(tested)
    odd = score_documents(odd_docs, model)
    assert odd.columns == [*odd_docs.columns, "_score"] and all(0 <= r["_score"] <= 1 for r in odd.collect())
    assert score_documents(no_docs, model).count() == 0
    one = fit_quality(docs, labels.where("quality = 1"))
    assert one.constant is not None and {r.score for r in score_documents(docs, one).collect()} == {one.constant}
    assert fit_quality(docs, labels.limit(0)).constant == 0.5


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, prose(i, 40) if i % 2 else "# " * 90) for i in range(100)], "doc_id bigint, text string")
    right = [(i, i % 2) for i in range(100)]
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in right]
    a, b = (fit_quality(docs, spark.createDataFrame(x, "doc_id bigint, quality int")) for x in (right, wrong))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def slow_features(text):
    """One list of features for each passage, byte by byte and word by word."""
    m64 = (1 << 64) - 1

    def word_hash(w):
        h = 0
        for i, b in enumerate(w.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))):
            h += (b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64)
        h = h + len(w) & m64
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m64
        h = (h ^ h >> 27) * 0x94D049BB133111EB & m64
        return h ^ h >> 31

    kinds = [range(97, 123), range(65, 91), range(48, 58), b" ", b"\t\n\x0b\x0c\r", b".", b",", b"!?", b"'\"()-:;", b"|", b"#$%&*+/<=>@[\\]^_`{}~"]
    kind = lambda b: 13 if b >= 0xC0 else 12 if b >= 0x80 else next((i for i, k in enumerate(kinds) if b in k), 11)
    raw = text.encode()
    found = [(w.start(), w.group()) for w in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    if not found:
        return [[0.0] * WIDTH]
    out = []
    for at in range(0, len(found), 64):
        ws = [w for _, w in found[at : at + 64]]
        span = raw[found[at][0] : found[at + 64][0] if at + 64 < len(found) else len(raw)]
        n, lens, buckets = len(ws), [len(w) for w in ws], [word_hash(w) >> 57 for w in ws]
        mean = lambda v: sum(v) / n  # noqa: B023, E731
        size = mean(lens)
        low = [w.lower() for w in ws]
        shape = [size / 10, math.sqrt(max(mean([x * x for x in lens]) - size**2, 0)) / 10, sum(a == b for a, b in zip(low, low[1:])) / n, len(set(buckets)) / n, mean([x == 1 for x in lens]), mean([65 <= w[0] <= 90 for w in ws]), mean([kind(w[-1]) >= 5 for w in ws]), n / 64]
        out.append([sum(kind(b) == k for b in span) / len(span) for k in range(14)] + shape + [buckets.count(k) / n for k in range(128)])
    return out


def slow_score(model, text):
    p = {k: v.tolist() for k, v in model.p.items()}
    dot = lambda v, m, j: sum(x * row[j] for x, row in zip(v, m))
    hs, es = [], []
    for f in slow_features(text):
        z = [(x - a) / s for x, a, s in zip(f, model.mean, model.std)]
        h = [math.tanh(dot(z, p["W"], j) + p["b"][j]) for j in range(len(p["b"]))]
        gate = [math.tanh(dot(h, p["V"], j)) / (1 + math.exp(-dot(h, p["U"], j))) for j in range(len(p["a"]))]
        hs.append(h)
        es.append(math.exp(sum(g * a for g, a in zip(gate, p["a"]))))
    rep = [sum(e * h[j] for e, h in zip(es, hs)) / sum(es) for j in range(len(p["c"]))]
    return 1 / (1 + math.exp(-(sum(r * c for r, c in zip(rep, p["c"])) + p["d"][0])))


def test_the_query_against_a_plain_forward_pass(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in op3_attention_quality(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
    for d in sorted(texts, key=lambda d: len(texts[d]))[:: max(1, len(texts) // 60)][:-1]:
        assert abs(got[d].score - slow_score(model, texts[d])) < 1e-4, d


def test_features_do_not_depend_on_neighbours():
    texts = ["one two  ", "  \n three, Four", "", " \t", "five!" + " x" * 200 + "\n"]
    data = "".join(texts).encode()
    x, count = passages(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    assert np.allclose(x, [f for t in texts for f in slow_features(t)], atol=1e-6)


def test_the_fit_is_bounded_by_documents_and_takes_all_their_passages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(AttentionModel, "fit", lambda self, xs, y: seen.append([len(x) for x in xs]) or self)
    docs = spark.createDataFrame([(i, prose(i, 64 * 50)) for i in range(20)] + [(3, "other")] * 50 + [(99, prose(1, 64 * 3000))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id bigint, quality int")
    fit_quality(docs, labels, most_bytes=500_000)
    within = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20))
    assert len(seen[0]) == within and sorted(seen[0])[1:] == [50] * (within - 1) and sorted(seen[0])[0] in (1, 50)
    fit_quality(docs, labels, most=4)
    assert len(seen[1]) == 4
    assert quality.FIT_DOCS == 6000
