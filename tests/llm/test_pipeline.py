from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from meshwork.llm import packing, quality  # noqa: E402
from meshwork.llm.common import table  # noqa: E402

from . import test_line_dedup, test_minhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_against_stages_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = quality.fit_quality(docs, table(spark, SF, "labels"))
    rows = [(r.doc_id, r.text) for r in quality.score_documents(docs, model).collect() if r.score >= 0.3]
    rows = [(d, t) for d, _, _, t in test_line_dedup.brute(rows)]
    kept = {d for d, _, _, k in test_minhash.brute(rows) if k}
    encode = packing._encoder("byte_bpe_50k.json")
    want = {d: len(encode(t)) + 1 for d, t in rows if d in kept}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        assert got.setdefault(r.doc_id, r.doc_tokens) == r.doc_tokens
    assert got == want


def test_stages_keep_the_columns(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_docs, SF).columns == odd_docs.columns, name
        assert stage(spark, no_docs, SF).count() == 0
    assert corpus_pipeline.dedup_near(spark, odd_docs, SF).where("doc_id IS NULL").count() == 2
    assert corpus_pipeline.dedup_near(spark, odd_docs, SF).where("doc_id = 9").count() == 1


def test_near_dedup_links_from_0_80(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles; a changed word at the end of n makes n differ on either side
    rows = [(1, " ".join(words))]
    rows += [(10 + n, " ".join(words[: 104 - n] + [f"x{n}y{k}" for k in range(n)])) for n in (9, 11, 12)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    s = {d: test_minhash.shingles(t) for d, t in rows}
    like = {d: len(s[1] & s[d]) / len(s[1] | s[d]) for d in s}
    assert like[19] > 0.83 and 0.8 <= like[21] < 0.85 and like[22] < 0.8
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, SF).collect()}
    assert kept == {d for d, _, _, k in test_minhash.brute(rows, 80) if k} != {d for d, _, _, k in test_minhash.brute(rows) if k}


def test_packing_takes_odd_documents(spark, odd_docs, no_docs):
    encode = packing._encoder("byte_bpe_50k.json")
    got = corpus_pipeline.pack(spark, odd_docs, SF).collect()
    assert sum(r.length for r in got) == sum(len(encode(r.text or "")) + 1 for r in odd_docs.collect())
    assert corpus_pipeline.pack(spark, no_docs, SF).count() == 0


def test_of_rows_that_repeat_an_id_the_least_stays(spark):
    rows = [(1, t, "en", s, 9) for t, s in (("b c d", "x"), ("a q r", "y"), ("a q r", "b"))] + [(None, "n", None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for k in (1, 3):
        got = corpus_pipeline.dedup_near(spark, docs.repartition(k), SF).collect()
        assert sorted(map(tuple, got), key=str) == [(1, "a q r", "en", "b", 9), (None, "n", None, None, None), (None, "n", None, None, None)]
