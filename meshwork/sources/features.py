"""GML features: from XML documents to coordinate lists.

Documents are read as records that end at a member's closing tag, so a large file is split among tasks and no
task holds a whole document. Records are parsed in Arrow batches because Spark's XML
reader loses the order between sibling element kinds, which the order of segments needs.

Features, polygon patches and lines are numbered in the order of database, file, place in the file. Numbers run inside a block
of a file; one offset for each block, from a running sum over blocks, makes them dense over all documents. So they have no
limit, need no sort of the features, and do not depend on how blocks are dealt to tasks.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import ARC, LINE
from ..functions.location import pack_location
from ..operators.materialise import keep
from ..workers import python_workers

#: first_object and first_line count the patches and lines before the feature in all documents, first_geometry the patches before it in its database.
FEATURES = "db_idx int, feature_ord bigint, feature_id string, feature_type string, patches bigint, lines bigint, first_object bigint, first_geometry bigint, first_line bigint, xml string"
POS_LISTS = "db_idx int, feature_ord bigint, feature_id string, object_id bigint, patch_ord int, ring_no int, seg_ord int, is_exterior boolean, geo_type int, curve_id string, location bigint, pos_list string"
_PARSED = "db_idx int, file string, block bigint, n bigint, feature_id string, feature_type string, patches bigint, lines bigint, patches_before bigint, lines_before bigint, xml string"
_PREFIX = re.compile(r"(</?)[A-Za-z_][\w.-]*:")
_ATTRIBUTE = re.compile(r"(\s)[A-Za-z_][\w.-]*:([\w.-]+\s*=)")


def database_index(name: str) -> int:
    """The number in the last three digits of a database's name; names are four characters long at least."""
    if len(name) < 4 or not re.fullmatch(r"\d{3}", name[-3:]):
        raise ValueError(f"a database name ends in three digits: {name!r}")
    return int(name[-3:])


def _plain(xml: str) -> str:
    """The text without namespace prefixes."""
    return _ATTRIBUTE.sub(r"\1\2", _PREFIX.sub(r"\1", xml))


def _tree(plain: str) -> ET.Element | None:
    try:
        return ET.fromstring(plain)
    except ET.ParseError:
        return None


def _inner(tree: ET.Element, plain: str) -> str:
    """The first feature's own text: what its member holds, where it holds one and no other text to be told apart."""
    inner = plain[plain.index(">") + 1 : plain.rindex("</")].strip()
    return inner if len(tree) == 1 and inner.startswith(f"<{tree[0].tag}") else ET.tostring(tree[0], encoding="unicode")


def _positions(tree: ET.Element | None) -> list[ET.Element]:
    return tree.findall("position") if tree is not None else []


def _lines(tree: ET.Element | None) -> list[ET.Element]:
    return [g for p in _positions(tree) for g in p]


def read_features(spark: SparkSession, path: str | list[str] | dict[str, str], database: str = "COVERAGE-000", member: str = "gml:featureMember") -> DataFrame:
    """One row per feature of the documents at `path`: one or several paths of `database`, or paths by database name. Records that are not
    well-formed keep their text with a null id."""
    python_workers(spark)
    by_name = path if isinstance(path, dict) else {database: path}
    end = f"</{member}>"

    def records(name: str, where) -> DataFrame:
        raw = spark.read.option("lineSep", end).text(where).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        found = raw.where(F.locate(f"<{member}", F.col("value")) > 0)
        return found.select(F.lit(database_index(name)).alias("db_idx"), "file", "block", F.concat(F.expr(f"substring(value, locate('<{member}', value))"), F.lit(end)).alias("value"))

    def parse(batches):
        at, n, patches, lines = None, 0, 0, 0
        for b in batches:
            rows = []
            for db, file, block, value in zip(b["db_idx"], b["file"], b["block"], b["value"], strict=True):
                if at != (db, file, block):
                    at, n, patches, lines = (db, file, block), 0, 0, 0
                text = _plain(value)
                tree = _tree(text)
                feature = tree[0] if tree is not None and len(tree) else None
                own, of_lines = sum(1 for p in _positions(feature) for _ in _patches(p)), len(_lines(feature))
                named = (feature.get("id"), feature.tag, _inner(tree, text)) if feature is not None else (None, None, value)
                rows.append((db, file, block, n, named[0], named[1], own, of_lines, patches, lines, named[2]))
                n, patches, lines = n + 1, patches + own, lines + of_lines
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARSED.split(", ")])

    parsed = keep(reduce(DataFrame.unionByName, [records(*x) for x in by_name.items()]).mapInPandas(parse, _PARSED))
    key = ("db_idx", "file", "block")
    blocks = parsed.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("patches").alias("_p"), F.sum("lines").alias("_l"))
    before = lambda c, *by: F.coalesce(F.sum(c).over(W.partitionBy(*by).orderBy(*key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row for each block of a file: small enough for the one task of the running sum.
    starts = blocks.select(*key, before("_n").alias("_n0"), before("_p").alias("_p0"), before("_p", "db_idx").alias("_g0"), before("_l").alias("_l0"))
    return parsed.join(starts, [*key]).select(
        "db_idx", (F.col("_n0") + F.col("n")).alias("feature_ord"), "feature_id", "feature_type", "patches", "lines",
        (F.col("_p0") + F.col("patches_before")).alias("first_object"), (F.col("_g0") + F.col("patches_before")).alias("first_geometry"), (F.col("_l0") + F.col("lines_before")).alias("first_line"), "xml",
    )


def renumbered(features: DataFrame, objects: int, geometries: dict[int, int], lines: int = 0) -> DataFrame:
    """The same features after others: `objects` patches and `lines` lines in all, `geometries` patches by database."""
    if not objects and not lines:
        return features
    by_db = F.create_map(*[F.lit(x) for kv in geometries.items() for x in kv]) if geometries else None
    more = F.coalesce(F.try_element_at(by_db, F.col("db_idx")).cast("long"), F.lit(0)) if geometries else F.lit(0)
    return features.withColumns({"first_object": F.col("first_object") + objects, "first_geometry": F.col("first_geometry") + more, "first_line": F.col("first_line") + lines})


def location(db: str = "db_idx", geometry: Column | str = "geometry", first: Column | str = "first_geometry") -> Column:
    """The packed location of a database's `geometry`-th patch, of the feature whose patches begin at `first` (both from 1). What the format cannot hold
    raises instead of being cut."""
    g, f = (F.col(c) if isinstance(c, str) else c for c in (geometry, first))
    fits = (F.col(db) < 256) & (g < 1 << 32) & (g - f < 1 << 24)
    return F.when(fits, pack_location(F.col(db), g, f)).otherwise(F.raise_error(F.lit("a packed location holds 256 databases, 2**32 patches of each and 2**24 of a feature")).cast("long"))


def select_surfaces(features: DataFrame, types: list[str] | None = None, model: str | None = None) -> DataFrame:
    """Features of the given types and model that have a surface and lie under nothing."""
    f = features.where(F.col("feature_type").isin(types)) if types else features
    f = f.where("xpath_boolean(xml, '/*/position/Surface') AND NOT xpath_boolean(xml, '/*/hatDirektUnten')")
    return f.where(F.expr("xpath_string(xml, '//advStandardModell')") == model) if model else f


def _patches(position: ET.Element):
    """Polygon patches in the order of the supported paths, then of the document."""

    def direct(parent: ET.Element):
        for patches in parent.findall("patches"):
            yield from patches.findall("PolygonPatch")

    def members(parent: ET.Element):
        for m in [*parent.findall("surfaceMember"), *parent.findall("surfaceMembers")]:
            yield from m

    for g in position:
        if g.tag in ("Surface", "PolyhedralSurface"):
            yield from direct(g)
    for g in position.findall("MultiSurface"):
        inner = list(members(g))
        yield from (m for m in inner if m.tag == "Polygon")
        for m in inner:
            if m.tag == "CompositeSurface":
                yield from (p for s in m.findall("surfaceMember") for p in s.iter() if p.tag in ("PolygonPatch", "Polygon"))
        for kind in ("Surface", "PolyhedralSurface"):
            for m in inner:
                if m.tag == kind:
                    yield from direct(m)
    for g in position.findall("CompositeSurface"):
        inner = [x for s in g.findall("surfaceMember") for x in s]
        yield from (m for m in inner if m.tag == "Polygon")
        for m in inner:
            if m.tag == "CompositeSurface":
                yield from (p for p in m.iter() if p.tag in ("PolygonPatch", "Polygon"))
        for kind in ("Surface", "PolyhedralSurface"):
            for m in inner:
                if m.tag == kind:
                    yield from direct(m)


def _segments(ring: ET.Element):
    for r in ring.findall("Ring"):
        for curve in (c for m in r.findall("curveMember") for c in m.findall("Curve")):
            for s in (x for segments in curve.findall("segments") for x in segments):
                if s.tag in ("Arc", "LineStringSegment"):
                    for p in s.findall("posList"):
                        yield ARC if s.tag == "Arc" else LINE, curve.get("id"), p.text or ""


def surface_pos_lists(features: DataFrame) -> DataFrame:
    """One row per segment of every patch's rings. object_id numbers patches over all documents; location is the patch's packed location."""
    python_workers(features.sparkSession)
    names = [c.split()[0] for c in POS_LISTS.split(", ")]
    schema = POS_LISTS.replace("location bigint", "geometry bigint, first_geometry bigint")

    def parse(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                for k, patch in enumerate(p for position in _positions(_tree(r.xml)) for p in _patches(position)):
                    rings = [*((x, True) for x in patch.findall("exterior")), *((x, False) for x in patch.findall("interior"))]
                    shift = 0 if rings and rings[0][1] else 1
                    for n, (ring, exterior) in enumerate(rings):
                        for seg, (kind, curve, text) in enumerate(_segments(ring)):
                            rows.append((r.db_idx, r.feature_ord, r.feature_id, r.first_object + k + 1, k, n + shift, seg, exterior, kind, curve, r.first_geometry + k + 1, r.first_geometry + 1, text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    found = features.where("patches > 0").mapInPandas(parse, schema)
    return found.withColumn("location", location()).select(*names)


def boundary_pos_lists(features: DataFrame) -> DataFrame:
    """(line_id, part, pos_list): every coordinate list below a feature's positions, in order; one line for each geometry."""
    python_workers(features.sparkSession)

    def parse(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                for k, g in enumerate(_lines(_tree(r.xml))):
                    rows += [(r.first_line + k + 1, n, p.text or "") for n, p in enumerate(g.iter("posList"))]
            yield pd.DataFrame(rows, columns=["line_id", "part", "pos_list"])

    return features.mapInPandas(parse, "line_id bigint, part int, pos_list string")
