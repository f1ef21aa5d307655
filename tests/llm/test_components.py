from __future__ import annotations

import random

from meshwork.llm.common import hot_limit, join_hot
from meshwork.llm.components import connected_components


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), "t").collect()}
    assert got == {x: root(x) for x in list(parent) if root(x) != x}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint"), "t").count() == 0


def test_hot_keys_join_like_others(spark):
    """Keys with more rows than the limit, none and null among them: as a plain inner join."""
    r = random.Random(5)
    rows = spark.createDataFrame([(r.choice([1, 1, 1, 2, 3, 9, None]), i) for i in range(300)], "k int, x int")
    values = spark.createDataFrame([(1, "a", 1.5, 200), (2, "b", None, 40), (3, None, 2.5, 1)], "k int, s string, d double, n int")
    want = sorted(map(str, rows.join(values.drop("n"), "k").select("k", "x", "s", "d").collect()))
    for limit in (0, 50, 10**6):
        got = join_hot(rows, values, "k", "n", limit)
        assert got.columns == ["k", "x", "s", "d"] and sorted(map(str, got.collect())) == want
    assert [hot_limit(n) for n in (0, 10**6, 10**9)] == [256, 256, 10**4]
