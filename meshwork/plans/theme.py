"""A topology theme: the operators behind one object, in the order of a validation run."""

from __future__ import annotations

from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.poslist import tokenize_pos_lists
from ..operators import boundaries, edges, errors, faces, lookup, rings, rotation
from ..operators.materialise import keep
from ..sources import features as gml
from ..sources import sinks

_THEMES: dict[str, TopologyTheme] = {}


class TopologyTheme:
    """One coverage and the errors found in it. Detections are pure and may be repeated; errors come in the order in which
    detections were asked for first. Sources that are parsed one after the other are numbered on, so that none shares objects or locations
    with another."""

    def __init__(self, spark: SparkSession, name: str):
        if name in _THEMES:
            raise ValueError(f"theme {name!r} exists")
        self.spark, self.name = spark, name
        self.features: DataFrame | None = None
        self.pos_lists: DataFrame | None = None
        self._vertices: DataFrame | None = None
        self._objects, self._geometries = 0, {}
        self._errors: dict[str, DataFrame] = {}
        self._all: DataFrame | None = None
        _THEMES[name] = self

    def close(self) -> None:
        _THEMES.pop(self.name, None)

    def __enter__(self) -> TopologyTheme:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @staticmethod
    def of(name: str) -> TopologyTheme:
        """The theme of that name."""
        return _THEMES[name]

    def parse_surface(self, features: DataFrame) -> TopologyTheme:
        """features (xml) -> topology; overlaps, intersections and invalid angles are reported."""
        features = keep(gml.renumbered(features, self._objects, self._geometries))
        last = lambda c: F.coalesce(F.max(F.col(c) + F.col("patches")), F.lit(0)).alias(c)
        for r in features.groupBy("db_idx").agg(last("first_object"), last("first_geometry")).collect():  # one row for each database
            self._objects, self._geometries[r["db_idx"]] = max(self._objects, r["first_object"]), r["first_geometry"]
        lists = keep(gml.surface_pos_lists(features))
        self.features = features if self.features is None else self.features.unionByName(features)
        self.pos_lists = lists if self.pos_lists is None else self.pos_lists.unionByName(lists)
        return self.parse_pos_lists(lists)

    def parse_pos_lists(self, pos_lists: DataFrame) -> TopologyTheme:
        return self.parse_vertices(tokenize_pos_lists(pos_lists))

    def parse_vertices(self, vertices: DataFrame) -> TopologyTheme:
        """Vertices whose object ids are those of no other source of the theme."""
        cols = ("object_id", "ring_no", "seg_ord", "v_ord", "is_exterior", "location", "x", "y")
        if "location" not in vertices.columns:
            vertices = vertices.withColumn("location", F.col("object_id").cast("long"))
        vertices = vertices.select(*cols)
        self._vertices = vertices if self._vertices is None else self._vertices.unionByName(vertices)
        for k in ("owned", "edges", "attachments", "walks", "nodes"):
            self.__dict__.pop(k, None)
        self._errors.setdefault("surface", None)
        self._all = None
        return self

    @cached_property
    def owned(self) -> DataFrame:
        return keep(edges.owned_uses(rings.edge_uses(self._vertices)))

    @cached_property
    def edges(self) -> DataFrame:
        return keep(edges.edges(self.owned))

    @cached_property
    def attachments(self) -> DataFrame:
        return rotation.attachments(rotation.half_edges(self.edges))

    @cached_property
    def walks(self) -> DataFrame:
        return keep(faces.walks(self.edges))

    @cached_property
    def nodes(self) -> DataFrame:
        return keep(edges.nodes(self.edges))

    def _phase(self, name: str) -> int:
        """Its number by the order in which phases were asked for."""
        self._all = None
        self._errors.setdefault(name, None)
        return list(self._errors).index(name) + 1

    def detect_holes(self) -> int:
        self._errors["holes"] = keep(errors.as_errors(faces.holes(self.edges, self.walks), "HOLE_EMPTY_INTERIOR", self._phase("holes")))
        return self._errors["holes"].count()

    def detect_free_standing_surfaces(self) -> int:
        self._errors["free"] = keep(errors.as_errors(faces.free_standing(self.edges, self.walks), "FREE_STANDING_SURFACE", self._phase("free")))
        return self._errors["free"].count()

    def check_boundary(self, lines: DataFrame, **options) -> TopologyTheme:
        """lines (line_id, v_ord, x, y[, part]) against this topology."""
        phase = self._phase("boundary")
        found = errors.as_errors(boundaries.points_detached(lines, self.edges, self.nodes, **options), "BOUNDARY_POINT_DETACHED", phase).unionByName(errors.as_errors(boundaries.edges_invalid(lines, self.edges, self.nodes, **options), "BOUNDARY_EDGE_INVALID", phase))
        old = self._errors.get("boundary")
        self._errors["boundary"] = found if old is None else old.unionByName(found)
        return self

    def parse_boundary(self, features: DataFrame, **options) -> TopologyTheme:
        return self.check_boundary(tokenize_pos_lists(gml.boundary_pos_lists(features)), **options)

    def all_errors(self) -> DataFrame:
        """All errors that were found, numbered; written once until something more is parsed or detected."""
        if self._all is not None:
            return self._all
        phase = self._phase("surface")
        parts = [
            errors.as_errors(edges.overlapping_edges(self.owned), "RING_OVERLAPPING_EDGES", phase),
            errors.as_errors(rotation.ring_intersections(self.attachments), "RING_INTERSECTION", phase),
            errors.as_errors(rotation.invalid_angles(self.attachments), "INVALID_ANGLE", phase),
        ]
        self._all = keep(errors.number_errors(parts + [e for e in self._errors.values() if e is not None]))
        return self._all

    def topological_errors(self, codes: list[str] | None = None) -> DataFrame:
        return errors.filter_errors(self.all_errors(), codes)

    def feature_of(self, errors_df: DataFrame, role: str = "is_loc") -> DataFrame:
        """Errors with the feature and patch that they name in a role."""
        return lookup.features_at(errors_df, self.features, role)

    def geometry_of(self, errors_df: DataFrame, role: str = "is_loc") -> DataFrame:
        """Errors with the segments of the geometry that they name in a role."""
        return lookup.geometries_at(errors_df, self.pos_lists, role)

    def messages(self, codes: list[str] | None = None) -> DataFrame:
        """Errors that repeat no place with `message`, which names features and geometries."""
        named = self._named(self.topological_errors(codes))
        return named.withColumn("message", errors.error_message(named.columns))

    def _named(self, errors_df: DataFrame) -> DataFrame:
        return errors_df if self.features is None else errors.with_features(errors_df, self.features)

    def show_errors(self, n: int = 20) -> None:
        """For development: the first errors on standard output."""
        self.all_errors().orderBy("i").show(n, truncate=False)

    def export_geojson(self, folder: str, codes: list[str] | None = None, attachment: str | None = None) -> Path:
        """Error points and the features that errors name, with an issue map."""
        shown = keep(sinks.exported(self.topological_errors(codes), codes))
        if self.features is None:
            areas = sinks.polygons(self._vertices.join(sinks.named_locations(shown), "location", "left_semi"))
        else:
            areas = sinks.erroneous_features(shown, self._vertices, self.features)
        return sinks.write_issue_map(sinks.error_points(self._named(shown)).select("feature").unionByName(areas.select("feature")), folder, self.name, attachment)

    def write_document(self, path: str) -> None:
        sinks.write_error_document(self.all_errors(), path, self.name)

    def diag(self) -> dict[str, int]:
        return lookup.diagnostics(self.owned, self.edges).first().asDict()

    @staticmethod
    def version() -> str:
        return __version__

    @staticmethod
    def detailed_version() -> str:
        import pyspark

        return f"{__version__}-spark{pyspark.__version__}"
