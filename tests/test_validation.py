"""All detections in slices: the same errors, and no more disk than what is still read."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meshwork.operators import errors, materialise, rotation, validation
from meshwork.operators.edges import edges, flat_edges, owned_uses, reported
from meshwork.operators.rings import BY_EDGE, dealt, edge_uses, packed, unpacked
from meshwork.plans import catalog
from meshwork.sources import coverages

SF = "/root/testdata/sf0.001"


def tables(spark) -> set[str]:
    folder = Path(materialise.shared_dir(spark).removeprefix("file://"))
    return set(os.listdir(folder)) if folder.exists() else set()


def shuffle_files(spark) -> list[str]:
    top = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    return sorted(p.name for p in top.rglob("shuffle_*.data"))


@pytest.mark.parametrize("slices", (1, 5))
def test_slices_find_what_sql_finds(spark, slices):
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = errors.number_errors(validation.detect(coverages.vertices(spark, SF), coverages.lines(spark, SF), slices))
    want = c.sql(catalog.ORACLE_SQL["error_relation"])
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


#: Queries on the errors; in each, nothing but the numbered errors is on disk when the result is written.
ON_ERRORS = [
    "erroneous_features",
    "error_stats",
    "errors_filtered",
    "error_repeats",
    "geojson_points",
    "error_xml",
]


@pytest.mark.parametrize("name", ON_ERRORS)
def test_query_leaves_the_numbered_errors_only(spark, name):
    before = tables(spark)
    catalog.QUERIES[name](spark, SF)
    assert len(tables(spark) - before) == 1


#: Queries on the errors; in each, windows by edge and by node are fed by one shuffle of rows without structs and what follows from other columns.
SHUFFLED_LEAN = [
    "error_repeats",
    "errors_filtered",
    "geojson_points",
    "error_xml",
    "error_stats",
    "erroneous_features",
]


@pytest.mark.parametrize("name", SHUFFLED_LEAN)
def test_query_shuffles_each_point_once(spark, monkeypatch, name):
    plans, real = [], validation.keep_lean

    def keep_lean(*parts):
        parts = [p() if callable(p) else p for p in parts]
        plans.extend(p._jdf.queryExecution().executedPlan().toString() for p in parts)
        return real(*parts)

    monkeypatch.setattr(validation, "keep_lean", keep_lean)
    catalog.QUERIES[name](spark, SF)
    shuffles = [line for p in plans if "Window" in p for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert ["xxhash64(" in x for x in shuffles] == [False, True, True]  # by ring, edge and node
    assert not [x for x in shuffles if "edge_key" in x or "normalized" in x]


@pytest.mark.parametrize("n", (1, 3))
def test_dealt_halves_are_half_edges(spark, n):
    packed_uses = materialise.keep(packed(edge_uses(coverages.vertices(spark, SF))))
    owned = materialise.keep(packed(reported(owned_uses(dealt(packed_uses), BY_EDGE))))
    turned = [rotation.turns(rotation.dealt_halves(flat_edges(owned), k, n)) for k in range(n)]
    want = rotation.turns(rotation.half_edges(edges(owned_uses(unpacked(packed_uses)))))
    got = [row for t in turned for row in t.select(want.columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.collect())) and len(got) > 0


def test_tables_go_when_they_are_read(spark):
    """Only the numbered errors are left; all uses, edges, half-edges and rounds were before."""
    before = tables(spark)
    found = catalog.all_errors(spark, SF)
    assert len(tables(spark) - before) == 1
    assert found.count() > 0


def test_shuffles_go_when_their_table_is_written(spark):
    before = set(shuffle_files(spark))
    kept = materialise.keep_lean(*materialise.sliced(3, lambda t: t.groupBy("k").count(), (spark.range(1000).select((F.col("id") % 70).alias("k")), ("k",))))
    assert set(shuffle_files(spark)) <= before
    assert kept.count() == 70 and kept.agg(F.sum("count")).first()[0] == 1000
    materialise.discard(kept)
    assert kept._kept_at.rsplit("/", 1)[-1] not in tables(spark)


def test_signed_zero_is_in_one_slice(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert df.select(F.xxhash64("x")).distinct().count() == 1


def test_packed_uses_are_the_same_again(spark):
    uses = edge_uses(coverages.vertices(spark, SF))
    again = unpacked(packed(uses)).select(uses.columns)
    assert uses.exceptAll(again).isEmpty() and again.exceptAll(uses).isEmpty()


@pytest.mark.parametrize("star", (1, 3, 64))
def test_turns_keep_every_error(spark, star):
    halves = rotation.half_edges(materialise.keep(edges(owned_uses(edge_uses(coverages.vertices(spark, SF))))))
    att, bad = rotation.attachments(halves), rotation.bad_attachments(materialise.keep(rotation.turns(halves, star)), star)
    for found in (rotation.ring_intersections, rotation.invalid_angles):
        assert sorted(map(str, found(att).collect())) == sorted(map(str, found(bad).collect()))


#: Queries on the errors; in each, lines are kept when uses, half-edges and all of edges but their ends are gone.
LINES_LAST = [
    "error_stats",
    "error_xml",
    "geojson_points",
    "erroneous_features",
    "errors_filtered",
]


@pytest.mark.parametrize("name", LINES_LAST)
def test_query_keeps_lines_when_edges_are_gone(spark, monkeypatch, name):
    before, at, real = tables(spark), [], validation.boundaries.kept_vertices

    def kept_vertices(*args):
        at.append(len(tables(spark) - before))
        return real(*args)

    monkeypatch.setattr(validation.boundaries, "kept_vertices", kept_vertices)
    catalog.QUERIES[name](spark, SF)
    assert at == [4]  # errors of surfaces, holes and free-standing surfaces, ends of edges, nodes


@pytest.mark.parametrize("located", (False, True))
def test_packed_tables_hold_each_object_once(spark, located):
    v = coverages.vertices(spark, SF)
    uses = materialise.keep(edge_uses(coverages.located(v) if located else v, in_blocks=True))
    owned = materialise.keep(owned_uses(uses).orderBy("use_key"))
    lean = materialise.keep(packed(owned))
    assert sorted(map(str, unpacked(lean).select(owned.columns).collect())) == sorted(map(str, owned.collect()))
    assert lean.where("n = 1 AND left_loc <> 0").isEmpty() and (located or lean.where("location <> 0 OR right_loc <> 0").isEmpty())
    turned = materialise.keep(rotation.turns(rotation.dealt_halves(flat_edges(lean)), 3))
    again = rotation.unpacked_turns(materialise.keep(rotation.packed_turns(turned))).select(turned.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, turned.collect()))
    want = materialise.keep(edge_uses(coverages.located(v) if located else v))
    assert want.exceptAll(uses).isEmpty() and uses.exceptAll(want).isEmpty()


def test_features_of_large_coverages_are_sliced(spark, monkeypatch):
    vertices = coverages.located(coverages.vertices(spark, SF))
    found = materialise.keep(catalog.all_errors(spark, SF, vertices))
    monkeypatch.setattr(catalog, "all_errors", lambda *_: found)
    want = catalog.QUERIES["erroneous_features"](spark, SF).collect()
    monkeypatch.setattr(validation, "SLICED_FROM", 1)
    before = tables(spark)
    got = catalog.QUERIES["erroneous_features"](spark, SF)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and len(tables(spark) - before) == 1
    assert sorted(got.collect()) == sorted(want) and len(want) > 0


#: Queries on the errors; in each, tables between steps hold points apart from one that they are near.
HELD_APART = ["error_xml", "error_stats", "geojson_points"]


@pytest.mark.parametrize("name", HELD_APART)
def test_query_holds_points_apart(spark, monkeypatch, name):
    seen, real = [], materialise.keep_lean

    def keep_lean(*parts):
        kept = real(*parts)
        seen.append(set(kept.columns))
        return kept

    for module in (validation, validation.boundaries):
        monkeypatch.setattr(module, "keep_lean", keep_lean)
    catalog.QUERIES[name](spark, SF)
    assert sum({"as_is"} <= c for c in seen) == 7  # uses, edges, half-edges, their ends, lines, lines without an edge, those held against nodes
    assert not [c for c in seen if {"px", "py"} & c]


def test_points_held_apart_are_the_same_again(spark):
    import struct

    from meshwork.functions.geometry import apart, together

    some = [0.0, -0.0, 0.1, 0.3, -7.125, 1e16, 1.0, 1e-300, 1.7e308, -1.7e308, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(a, b, some[(i + j) % len(some)]) for i, a in enumerate(some) for j, b in enumerate(some)], "o double, c double, e double")
    near = {"c": "o", "e": "o"}
    held = materialise.keep(apart(df, near))
    bits = lambda row: tuple(None if v is None else struct.pack(">d", v) for v in row)
    again = together(held, near).select(df.columns)
    assert sorted(map(str, map(bits, again.collect()))) == sorted(map(str, map(bits, df.collect())))
    assert set(held.columns) == {"o", "d_c", "d_e", "as_is"}
    near_ones = spark.createDataFrame([(1010.125, 1020.125, 1000.125)], "o double, c double, e double")
    assert apart(near_ones, near).where("as_is IS NULL").count() == 1
