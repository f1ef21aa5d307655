from __future__ import annotations

import math
import re

from meshwork.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, block_sizes, label_documents, op7_license_scan, scan

from pyspark.sql import functions as F

from .conftest import prose


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base, added, score = {x for _, x in hits}, set(), 1.0 if hits else 0.0
    for label, t in TEMPLATES.items():
        t, size = set(t.split()), block_sizes(TEMPLATES)[label]
        for s in range(0, max(len(w) - size // 2, 1), size // 2):
            b = set(w[s : s + size])
            if len(b & t) >= math.ceil(THRESHOLD * len(t) - 1e-9):
                added.add(label)
                score = max(score, len(b & t) / len(t))
    at = [i for i, _ in hits]
    return (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | added)), score)


def test_against_brute_force(spark, odd_docs, no_docs):
    texts = [
        "MIT License mit LICENSE, mit-license permitlicense mit licenses",
        "cc by cc by\ncc\tby",
        "Kernel GNU\nGeneral  Public_License İ apache license",
        prose(1, 100) + " " + TEMPLATES["notice-mit"].upper() + " " + prose(2, 500),
        prose(1, 31) + " " + " ".join(TEMPLATES["notice-gpl"].split()[4:]) + " " + prose(3, 20),
        " ".join(TEMPLATES["notice-bsd"].split()[:12]),
        *TEMPLATES.values(),
        "éapache license apache licenseé 日apache license",
        prose(4, 90) + " " + TEMPLATES["text-mit"].title() + ". " + prose(5, 300),
        prose(6, 40) + " " + " ".join(w for i, w in enumerate(TEMPLATES["text-isc"].split()) if i % 9),
        "gnu general public gnu general public license; gnu. general, public license cc",
        "\u212aernel mit \u0130license mit license\u0130 \u00a0mit license",
    ]
    more = spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    want = sorted(((d, *brute(t)) for d, t in map(tuple, docs.collect())), key=str)
    assert sorted(map(tuple, label_documents(docs).collect()), key=str) == want
    assert label_documents(no_docs).count() == 0


def test_no_python_in_the_plan(spark, odd_docs):
    plan = label_documents(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_long_templates_are_met(spark):
    long, half = " ".join(f"clause{i}" for i in range(200)), " ".join(f"term{i}" for i in range(40))
    texts = [prose(1, 100) + " " + long + " " + prose(2, 100), *(prose(3, n) + " " + half + " " + prose(4, 90) for n in (0, 28, 40)), prose(5, 400) + " " + TEMPLATES["notice-mit"], " ".join(long.split()[:150])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    _, matches = scan(docs, templates=TEMPLATES | {"long": long, "half": half})
    assert {(r.doc_id, r.label) for r in matches.collect()} == {(0, "long"), (1, "half"), (2, "half"), (3, "half"), (4, "notice-mit")}


def test_clashing_columns_and_the_query(spark, odd_docs):
    """Extra columns with the names that the operator uses itself."""
    names = ["row", "n_words", "chunks", "words", "label", "start", "b", "x", "rank", "labels", "added", "containment"]
    wide = odd_docs.select("doc_id", "text", *[F.lit("z").alias(n) for n in names])
    plain = sorted(map(tuple, label_documents(odd_docs.select("doc_id", "text")).collect()), key=str)
    assert sorted(map(tuple, label_documents(wide).collect()), key=str) == plain
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, op7_license_scan(spark, sf).collect()), key=str)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=str)
