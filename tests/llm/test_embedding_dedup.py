from __future__ import annotations

import math

import numpy as np
from meshwork.llm import embedding_dedup
from meshwork.llm.embedding_dedup import learn, near_vectors, op1_itq_embedding_dedup, partners, tables_for, unit


def brute(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    s = x @ x.T >= 0.95
    np.fill_diagonal(s, False)
    ids = np.array([i for i, _ in ok])
    label = ids.copy()
    for _ in range(len(ids)):
        label = np.minimum(label, np.where(s, label[None, :], 1 << 60).min(axis=1))
    return {int(i): (int(n), int(c)) for i, n, c in zip(ids, s.sum(axis=1), label)}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    monkeypatch.setattr(embedding_dedup, "TILE", 8)
    monkeypatch.setattr(embedding_dedup, "SMALL", 6)
    monkeypatch.setattr(embedding_dedup, "GROUP_ROWS", 200)
    r, rows = np.random.default_rng(2), []
    for c in range(40):
        centre = r.normal(size=8)
        for _ in range(1 if c else 70):
            rows.append((len(rows), (centre + r.normal(size=8) * 0.12).tolist()))
    for c in range(60):
        a = r.normal(size=8)
        rows += [(len(rows), a.tolist()), (len(rows) + 1, (a + r.normal(size=8) * 0.2 * np.linalg.norm(a) / 3).tolist())]
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, (np.array(rows[1][1]) * 7).tolist())]
    want = brute(rows)
    odd = [(9001, None), (9002, [0.0] * 8), (9003, [math.nan] * 8), (9004, [None] * 8), (9005, [math.inf] + [1.0] * 7), (9006, [1.0]), (9007, []), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id bigint, embedding array<double>, label int, node int")
    got = {x.vec_id: x for x in near_vectors(df).collect()}
    found = sum(got[i].n_links for i in want)
    assert all(got[i].n_links <= n for i, (n, _) in want.items())  # none below the threshold
    assert found >= 0.99 * sum(n for n, _ in want.values())
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.99 * len(want)
    for i, _ in odd[:-1]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)


def test_repeated_rows_and_empty_table(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = near_vectors(spark.createDataFrame([(4, [1.0, 2.0]), (4, [1.0, 2.0]), (2, [2.0, 4.0])], schema)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(4, 2, 2, False), (2, 2, 2, True)}


def test_tables_follow_the_recall():
    for n in (10, 10**5, 10**9):
        bits, tables = tables_for(n)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= 0.001


def test_recall_with_a_large_common_mean(spark):
    """Pairs at the threshold whose vectors share most of their direction."""
    r, d, n, c = np.random.default_rng(3), 64, 1000, 0.9502
    noise = r.normal(size=(n, d)) / math.sqrt(d)
    x = 0.9 * np.eye(d)[0] + math.sqrt(1 - 0.9**2) * noise
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = r.normal(size=(n, d))
    away -= (away * x).sum(axis=1, keepdims=True) * x
    y = c * x + math.sqrt(1 - c * c) * away / np.linalg.norm(away, axis=1, keepdims=True)
    v = np.concatenate([x, y])
    assert np.linalg.norm(v.mean(axis=0)) > 0.85
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = {q.vec_id: q.n_links for q in near_vectors(df).collect()}
    assert all(got[i] <= near[i].sum() for i in got)
    assert sum(got.values()) >= 0.99 * near.sum() >= 0.99 * 2 * n


def test_learnt_codes_reach_the_recall_on_other_vectors():
    """Tables and radius are measured on one sample and hold on another, with and without a common direction."""
    r = np.random.default_rng(6)
    for shift in (0.0, 2.0):
        x = unit(r.normal(size=(6000, 32)) * np.linspace(0.2, 2, 32) + shift)
        codes = learn({32: x[:3000]}, 50_000)
        a, b = codes.signs(x[3000:]), codes.signs(partners(x[3000:], 0.95, r))
        met = (codes.substrings(a) == codes.substrings(b)).any(axis=1)
        assert met.mean() >= 0.995 and codes.tables >= tables_for(50_000)[1]
        assert ((a != b).sum(axis=1) <= codes.radius).all()
        assert (codes.unpack(codes.pack(a)) == a).all()
        unrelated = (a[:1000] != a[1000:2000]).sum(axis=1)
        assert shift or (unrelated > codes.radius).mean() > 0.99


def test_other_lengths_and_extreme_sizes_link_too(spark):
    r = np.random.default_rng(7)
    rows = [(i, r.normal(size=16).tolist()) for i in range(300)]
    for k, base in enumerate((r.normal(size=5), r.normal(size=3), r.normal(size=9000))):
        rows += [(1000 + 10 * k + j, (base * (1 + j)).tolist()) for j in range(3)]
    rows += [(2000, [1e200, 1e200]), (2001, [1e200, 1.1e200]), (2002, [1e-320, 1e-320]), (2003, [-1.0, 1.0])]
    got = {q.vec_id: (q.n_links, q.component_id) for q in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    for k in range(3):
        assert [got[1000 + 10 * k + j] for j in range(3)] == [(2, 1000 + 10 * k)] * 3
    assert [got[i] for i in range(2000, 2004)] == [(2, 2000)] * 3 + [(0, 2003)]


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(q.vec_id, q.embedding) for q in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = unit(np.array([v for _, v in rows], float))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = np.array([i for i, _ in rows])
    label = ids.copy()
    for _ in rows:
        label = np.minimum(label, np.where(near, label[None, :], 1 << 60).min(axis=1))
    got = {q.vec_id: (q.n_links, q.component_id, q.kept) for q in op1_itq_embedding_dedup(spark, sf).collect()}
    assert got == {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(axis=1), label)}
