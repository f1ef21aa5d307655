from __future__ import annotations

import json

import pytest
from meshwork.functions import location as loc
from meshwork.functions.poslist import bad_pos_lists, tokenize_pos_lists
from meshwork.plans.theme import TopologyTheme
from meshwork.sources import features as gml
from meshwork.sources import sinks
from pyspark.sql import functions as F


def ring(kind, *lists):
    curves = "".join(f'<gml:curveMember><gml:Curve gml:id="c{i}"><gml:segments><gml:{k}><gml:posList>{t}</gml:posList></gml:{k}></gml:segments></gml:Curve></gml:curveMember>' for i, (k, t) in enumerate(lists))
    return f"<gml:{kind}><gml:Ring>{curves}</gml:Ring></gml:{kind}>"


def member(fid, *rings, extra="", kind="AX_Wald"):
    return f"""<gml:featureMember><adv:{kind} gml:id="{fid}"><adv:modellart><adv:AA_Modellart><adv:advStandardModell>DLKM</adv:advStandardModell></adv:AA_Modellart></adv:modellart>{extra}
      <adv:position><gml:Surface gml:id="s"><gml:patches><gml:PolygonPatch>{"".join(rings)}</gml:PolygonPatch></gml:patches></gml:Surface></adv:position></adv:{kind}></gml:featureMember>"""


@pytest.fixture(scope="module")
def document(tmp_path_factory):
    p = tmp_path_factory.mktemp("gml") / "doc.xml"
    a = ring("exterior", ("LineStringSegment", "0 0 3 0"), ("Arc", "3 0 3.0 1.5 3 3"), ("LineStringSegment", "3 3 0 3 0 0"))
    hole = ring("interior", ("LineStringSegment", "1 1 1 2 2 2 2 1 1 1"))
    p.write_text(f'<x:Coll xmlns:gml="urn:g" xmlns:adv="urn:a" xmlns:x="urn:x">{member("f1", a, hole)}{member("f2", a, extra="<adv:hatDirektUnten/>")}{member("f3", ring("exterior", ("LineStringSegment", "9 9 10 9 10 10 9 9")), kind="AX_See")}</x:Coll>')
    return str(p)


def test_tokenizer(spark):
    cases = ["4711.125 -80.5", "7 9", "0.25 1.0625", " \t 12.5   -3.75 \n", "1 9 2 8\t3 7  4 6", "5 5 5.0 5.00 6 5 6 5 7 1 5 5", "+1,-2 , .5 4.", "1 2 3", "1e5 2", "", "   ", None, "1 x", "1,,2", "1 2,"]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, pos_list string")
    got = {}
    for r in tokenize_pos_lists(df).orderBy("k", "v_ord").collect():
        got.setdefault(r.k, []).append((r.x, r.y))
    assert got == {0: [(4711.125, -80.5)], 1: [(7, 9)], 2: [(0.25, 1.0625)], 3: [(12.5, -3.75)], 4: [(1, 9), (2, 8), (3, 7), (4, 6)], 5: [(5, 5), (6, 5), (7, 1), (5, 5)], 6: [(1, -2), (0.5, 4)], 7: [(1, 2)]}
    assert sorted(r.k for r in bad_pos_lists(df).collect()) == [8, 9, 10, 11, 12, 13, 14]
    three = tokenize_pos_lists(spark.createDataFrame([(1, "1 2 3 1 2 4 1 2 4 9")], "k int, pos_list string"), dim=3)
    assert [(r.x, r.y, r.z) for r in three.collect()] == [(1, 2, 3), (1, 2, 4)]


def test_long_lists(spark):
    """100,000 points, where a pattern over the whole list would overflow the stack."""
    text = " ".join(f"{i}.125 {-i}" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, text + " x"), (3, text.replace(" ", " , "))], "k int, pos_list string")
    got = {r.k: (r.n, r.last) for r in tokenize_pos_lists(df).groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("last")).collect()}
    assert got == {1: (100_000, 99_999.125), 3: (100_000, 99_999.125)}
    assert [r.k for r in bad_pos_lists(df).collect()] == [2]


def test_locations(spark):
    v = (3 << 56) | (19 << 32) | 70_019
    r = spark.range(1).select(F.lit(v).alias("v")).select(loc.location_db("v").alias("db"), loc.location_delta("v").alias("d"), loc.location_geometry("v").alias("g"), loc.location_feature("v").alias("f"), loc.location_db_name("v", "X-").alias("n"), loc.pack_location(F.lit(3), F.lit(70_019), F.lit(70_000)).alias("p"), loc.feature_as_location("v").alias("o"), loc.left_int(loc.pack_ints(F.lit(-5), F.lit(-7))).alias("l"), loc.right_int(loc.pack_ints(F.lit(-5), F.lit(-7))).alias("r")).first()
    assert tuple(r) == (3, 19, 70_019, 70_000, "X-003", v, (3 << 56) | 70_000, -5, -7)


def test_features(spark, document):
    f = gml.read_features(spark, document)
    assert [(r.feature_id, r.feature_type, r.db_idx) for r in f.orderBy("feature_ord").collect()] == [("f1", "AX_Wald", 0), ("f2", "AX_Wald", 0), ("f3", "AX_See", 0)]
    chosen = gml.select_surfaces(f, ["AX_Wald"], "DLKM")
    assert [r.feature_id for r in chosen.collect()] == ["f1"]
    lists = gml.surface_pos_lists(chosen).orderBy("ring_no", "seg_ord").collect()
    assert [(r.ring_no, r.seg_ord, r.is_exterior, r.geo_type) for r in lists] == [(0, 0, True, 2), (0, 1, True, 1), (0, 2, True, 2), (1, 0, False, 2)]
    assert gml.boundary_pos_lists(f).count() == 8
    for bad in ("abc", "x", "COVER-12"):
        with pytest.raises(ValueError, match="three digits"):
            gml.database_index(bad)


def test_theme_end_to_end(spark, document, tmp_path):
    theme = TopologyTheme(spark, "forest")
    with pytest.raises(ValueError, match="exists"):
        TopologyTheme(spark, "forest")
    f = gml.read_features(spark, document)
    theme.parse_surface(gml.select_surfaces(f))
    assert (theme.detect_holes(), theme.detect_free_standing_surfaces()) == (1, 1)
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 3.0), (1, 2, 7.0, 7.0)], "line_id bigint, v_ord int, x double, y double")
    theme.check_boundary(lines)
    got = theme.topological_errors().orderBy("i").collect()
    assert [r.t for r in got] == ["HOLE_EMPTY_INTERIOR", "FREE_STANDING_SURFACE", "BOUNDARY_EDGE_INVALID", "BOUNDARY_POINT_DETACHED"]
    assert theme.feature_of(theme.topological_errors(["HOLE_EMPTY_INTERIOR"])).first().feature_id == "f1"
    assert theme.diag()["objects"] == 2
    assert theme.geometry_of(theme.topological_errors(["HOLE_EMPTY_INTERIOR"])).count() == 4
    assert theme.detailed_version().startswith(theme.version())
    theme.write_document(str(tmp_path / "e.xml"))
    assert (tmp_path / "e.xml").read_text().count("<e i=") == 4
    again = sinks.read_error_document(spark, str(tmp_path / "e.xml"))
    assert sorted(map(str, again.collect())) == sorted(map(str, theme.all_errors().collect()))
    page = theme.export_geojson(str(tmp_path / "map"))
    data = json.loads((tmp_path / "map" / "forest.geojson").read_text())
    kinds = [x["geometry"]["type"] for x in data["features"]]
    assert page.exists() and kinds.count("Point") == 4 and kinds.count("Polygon") == 2
    assert sorted(len(x["geometry"]["coordinates"]) for x in data["features"] if x["geometry"]["type"] == "Polygon") == [1, 2]
    assert sorted(x["properties"]["id"] for x in data["features"] if x["geometry"]["type"] == "Polygon") == ["f1", "f3"]
    said = {r.t: r.message for r in theme.messages().collect()}
    assert "of feature f1 is not filled" in said["HOLE_EMPTY_INTERIOR"] and "of feature f3 does not" in said["FREE_STANDING_SURFACE"]
    assert theme.export_geojson(str(tmp_path / "map2"), attachment="a.json").exists() and '"a.json"' in (tmp_path / "map2" / "forest_Map.html").read_text()
    theme.close()


def square(x, y, s=1):
    return ring("exterior", ("LineStringSegment", f"{x} {y} {x + s} {y} {x + s} {y + s} {x} {y + s} {x} {y}"))


def several(fid, *patches):
    """A feature of several patches."""
    inner = "".join(f"<gml:PolygonPatch>{p}</gml:PolygonPatch>" for p in patches)
    return f'<gml:featureMember><adv:AX_Wald gml:id="{fid}"><adv:position><gml:Surface><gml:patches>{inner}</gml:patches></gml:Surface></adv:position></adv:AX_Wald></gml:featureMember>'


def write_document(path, *members):
    path.write_text(f'<x:Coll xmlns:gml="urn:g" xmlns:adv="urn:a" xmlns:x="urn:x">{"".join(members)}</x:Coll>')
    return str(path)


def test_sources_are_numbered_on(spark, tmp_path):
    """Two documents, two databases and two calls: no objects, lines or locations are shared."""
    a = write_document(tmp_path / "a.xml", several("a1", square(0, 0), square(20, 0)), several("a2", square(1, 0)))
    b = write_document(tmp_path / "b.xml", several("b1", square(40, 0)), several("b2"), several("b3", square(41, 0), square(60, 0), square(1, 0)))
    c = write_document(tmp_path / "c.xml", several("c1", square(0, 0)))
    both = gml.read_features(spark, {"COVER-004": b, "COVER-001": a})
    rows = both.orderBy("feature_ord").collect()
    assert [(r.db_idx, r.feature_ord, r.feature_id, r.patches, r.first_object, r.first_geometry, r.first_line) for r in rows] == [(1, 0, "a1", 2, 0, 0, 0), (1, 1, "a2", 1, 2, 2, 1), (4, 2, "b1", 1, 3, 0, 2), (4, 3, "b2", 0, 4, 1, 3), (4, 4, "b3", 3, 4, 1, 4)]
    lists = gml.surface_pos_lists(both).orderBy("object_id").collect()
    assert [(r.object_id, r.feature_id, r.patch_ord) for r in lists] == [(1, "a1", 0), (2, "a1", 1), (3, "a2", 0), (4, "b1", 0), (5, "b3", 0), (6, "b3", 1), (7, "b3", 2)]
    assert [r.location for r in lists] == [(1 << 56) | 1, (1 << 56) | (1 << 32) | 2, (1 << 56) | 3, (4 << 56) | 1, (4 << 56) | 2, (4 << 56) | (1 << 32) | 3, (4 << 56) | (2 << 32) | 4]
    theme = TopologyTheme(spark, "numbered")
    theme.parse_surface(both).parse_surface(gml.read_features(spark, c, "COVER-001"))
    assert theme.diag()["objects"] == 8
    overlaps = theme.topological_errors(["RING_OVERLAPPING_EDGES"])
    for role, want in (("is_loc", {"a1", "a2"}), ("o_loc", {"b3", "c1"})):
        assert {r.feature_id for r in theme.feature_of(overlaps, role).collect()} == want
    assert {(r.feature_id, r.patch_ord) for r in theme.geometry_of(overlaps, "o_loc").collect()} == {("b3", 2), ("c1", 0)}
    assert len(set(theme.pos_lists.select("location").collect())) == 8
    areas = sinks.erroneous_features(overlaps, theme._vertices, theme.features).collect()
    kinds = {r.feature_id: json.loads(r.feature)["geometry"] for r in areas}
    assert {k: (g["type"], len(g["coordinates"])) for k, g in kinds.items()} == {"a1": ("MultiPolygon", 2), "a2": ("Polygon", 1), "b3": ("MultiPolygon", 3), "c1": ("Polygon", 1)}
    theme.close()


def test_numbers_do_not_depend_on_blocks(spark, tmp_path):
    """One document read whole and in many blocks."""
    doc = write_document(tmp_path / "d.xml", *(several(f"f{i}", *(square(10 * i, 10 * k) for k in range(i % 4))) for i in range(300)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = []
    for size in (old, "20000b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        f = gml.read_features(spark, doc)
        got.append(sorted((r.object_id, r.feature_id, r.patch_ord, r.location, r.pos_list) for r in gml.surface_pos_lists(f).collect()))
        lines = {r.line_id for r in gml.boundary_pos_lists(f).collect()}
        assert len(lines) == 225  # features without a patch have a line without lists
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got[0] == got[1] and [r[0] for r in got[0]] == list(range(1, 451))
    assert [r[1] for r in got[0]] == [f"f{i}" for i in range(300) for _ in range(i % 4)]


POSITIONS = {
    "patches of surfaces": "<Surface><patches><PolygonPatch/><PolygonPatch/></patches></Surface><PolyhedralSurface><patches><PolygonPatch/></patches></PolyhedralSurface>",
    "members of a multi-surface": "<MultiSurface><surfaceMember><Polygon/></surfaceMember><surfaceMembers><Polygon/></surfaceMembers></MultiSurface>",
    "a composite in a multi-surface": "<MultiSurface><surfaceMember><CompositeSurface><surfaceMember><Polygon/></surfaceMember><surfaceMember><Surface><patches><PolygonPatch/></patches></Surface></surfaceMember></CompositeSurface></surfaceMember></MultiSurface>",
    "surfaces in a multi-surface": "<MultiSurface><surfaceMember><Surface><patches><PolygonPatch/></patches></Surface></surfaceMember><surfaceMember><PolyhedralSurface><patches><PolygonPatch/></patches></PolyhedralSurface></surfaceMember></MultiSurface>",
    "polygons of a composite": "<CompositeSurface><surfaceMember><Polygon/></surfaceMember></CompositeSurface>",
    "nested composites": "<CompositeSurface><surfaceMember><CompositeSurface><surfaceMember><Polygon/></surfaceMember></CompositeSurface></surfaceMember></CompositeSurface>",
    "surfaces of a composite": "<CompositeSurface><surfaceMember><Surface><patches><PolygonPatch/></patches></Surface></surfaceMember><surfaceMember><PolyhedralSurface><patches><PolygonPatch/></patches></PolyhedralSurface></surfaceMember></CompositeSurface>",
    "nothing that is supported": "<Polygon/><MultiCurve/><Surface><patches><Triangle/></patches></Surface>",
}


@pytest.mark.parametrize(("name", "patches"), list(zip(POSITIONS, (3, 2, 2, 2, 1, 1, 2, 0))))
def test_supported_surfaces(name, patches):
    import xml.etree.ElementTree as ET

    assert len(list(gml._patches(ET.fromstring(f"<position>{POSITIONS[name]}</position>")))) == patches


def test_an_interior_without_exterior_on_shared_edges(spark, tmp_path):
    """A polygon of 24 two-point curves, and a feature that is an interior ring only and shares three of its edges in the same direction:
    nothing is reported while parsing, and the interior is one hole from its first own edge on."""
    top = [(x, 0) for x in range(9)] + [(8, y) for y in range(1, 5)] + [(x, 4) for x in range(7, -1, -1)] + [(0, y) for y in range(3, 0, -1)]
    assert len(top) == 24
    curves = lambda ps: [("LineStringSegment", f"{a} {b} {c} {d}") for (a, b), (c, d) in zip(ps, [*ps[1:], ps[0]])]
    inner = [(2, 0), (3, 0), (4, 0), (5, 0), (5, -2), (2, -2)]
    doc = write_document(tmp_path / "e.xml", member("one", ring("exterior", *curves(top))), member("two", ring("interior", *curves(inner))))
    theme = TopologyTheme(spark, "interior")
    theme.parse_surface(gml.select_surfaces(gml.read_features(spark, doc), ["AX_Wald"], "DLKM"))
    assert theme.all_errors().count() == 0 and theme.diag()["edges"] == 27
    assert theme.detect_holes() == 1
    [hole] = theme.feature_of(theme.topological_errors()).collect()
    assert (hole.t, hole.x, hole.y, hole.feature_id) == ("HOLE_EMPTY_INTERIOR", 5, 0, "two")
    theme.close()


def test_errors_come_in_the_order_that_was_asked_for(spark, tmp_path):
    doc = write_document(tmp_path / "o.xml", member("f", square(0, 0, 9), ring("interior", ("LineStringSegment", "1 1 1 2 2 2 2 1 1 1"))), member("g", square(50, 0)))
    got = []
    for name in ("ab", "ba"):
        theme = TopologyTheme(spark, f"order-{name}")
        theme.parse_surface(gml.read_features(spark, doc))
        for k in name:
            (theme.detect_holes if k == "a" else theme.detect_free_standing_surfaces)()
        got.append([r.t for r in theme.all_errors().orderBy("i").collect()])
        theme.close()
    assert got == [["HOLE_EMPTY_INTERIOR", "FREE_STANDING_SURFACE"], ["FREE_STANDING_SURFACE", "HOLE_EMPTY_INTERIOR"]]


def test_a_coverage_as_gml_gives_the_errors_of_its_vertices(spark, tmp_path):
    from meshwork.plans import catalog
    from meshwork.sources import coverages

    sf = "/root/testdata/sf0.001"
    members = [r.value for r in coverages.gml_members(spark, sf).orderBy("k").collect()]
    theme = TopologyTheme(spark, "coverage").parse_surface(gml.read_features(spark, write_document(tmp_path / "c.xml", *members)))
    theme.detect_holes(), theme.detect_free_standing_surfaces()
    got = [(r.t, r.x, r.y) for r in theme.all_errors().orderBy("i").collect()]
    theme.close()
    assert got == [(r.t, r.x, r.y) for r in catalog.all_errors(spark, sf).where("t NOT LIKE 'BOUNDARY%'").orderBy("i").collect()]


def test_themes_are_known_by_name_until_they_close(spark, capsys):
    v = spark.createDataFrame([(o, 0, 0, i, True, float(x), float(y)) for o in (1, 2) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 0)])], "object_id bigint, ring_no int, seg_ord int, v_ord int, is_exterior boolean, x double, y double")
    with TopologyTheme(spark, "named").parse_vertices(v) as theme:
        assert TopologyTheme.of("named") is theme
        theme.show_errors(1)
        assert "RING_OVERLAPPING_EDGES" in capsys.readouterr().out
        assert theme.messages().where("message LIKE 'Edge of geometry 2 overlaps geometry 1 at (%'").count() == 3
    with pytest.raises(KeyError):
        TopologyTheme.of("named")


def test_polygons_drop_repeats_and_close(spark):
    v = spark.createDataFrame([(1, 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 0), (1, 1)])], "object_id bigint, ring_no int, seg_ord int, v_ord int, x double, y double")
    [r] = sinks.polygons(v).collect()
    assert json.loads(r.feature)["geometry"]["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 0]]]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_stream_equals_batch(spark, tmp_path, order):
    """Objects that come late take ownership from those that came before them."""
    from meshwork.operators import edges, rings
    from meshwork.sources import coverages
    from meshwork.streaming import incremental

    v = coverages.vertices(spark, "/root/testdata/sf0.001").withColumn("location", F.col("object_id")).where("object_id < 1600 OR object_id > 8000000000")
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    src = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    s = spark.readStream.schema(v.schema).parquet(src)
    for k in order:
        v.where(f"object_id % 8 % 3 = {k}").coalesce(1).write.mode("append").parquet(src)
        incremental.validate_stream(s, state, out, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(state).select("use_key").distinct().count() == rings.edge_uses(v).count()
    want = edges.overlapping_edges(edges.owned_uses(rings.edge_uses(v)))
    got = incremental.current_overlaps(spark, out)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) != []


def test_kept_tables_are_deleted(spark):
    from pathlib import Path

    from meshwork.operators import materialise

    before = materialise.shared_dir(spark)
    materialise.keep(spark.range(3))
    assert any(Path(before.removeprefix("file:")).iterdir())
    with materialise.kept_tables(spark):
        materialise.keep(spark.range(3))
    assert not Path(before.removeprefix("file:")).exists()
