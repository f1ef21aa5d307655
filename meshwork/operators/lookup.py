"""Point queries over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import edge_key
from ..functions.location import location_db, location_delta, location_feature
from .edges import nodes
from .rotation import ccw_next, half_edges


def find_nodes(edges: DataFrame, points: DataFrame) -> DataFrame:
    """points (x, y) with their degree, null where there is no node."""
    return points.join(nodes(edges), ["x", "y"], "left")


def find_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (x1, y1, x2, y2) in any direction with left_obj and right_obj of their edge, null where there is none."""
    return pairs.withColumn("edge_key", edge_key("x1", "y1", "x2", "y2")).join(edges.select("edge_key", "left_obj", "right_obj", F.lit(True).alias("found")), "edge_key", "left").drop("edge_key")


def features_at(rows: DataFrame, features: DataFrame, role: str) -> DataFrame:
    """`rows` with feature_id, feature_type and patch_ord of the packed location in column `role`, null where it names none. features: db_idx, first_geometry, patches, feature_id,
    feature_type."""
    f = features.where("patches > 0").select(F.col("db_idx").alias("_db"), (F.col("first_geometry") + 1).alias("_pos"), "feature_id", "feature_type")
    keyed = rows.withColumns({"_db": location_db(role), "_pos": location_feature(role), "patch_ord": location_delta(role)})
    found = keyed.join(f, ["_db", "_pos"], "left").withColumn("patch_ord", F.when(F.col("feature_id").isNotNull(), F.col("patch_ord")))
    return found.select(*rows.columns, "feature_id", "feature_type", "patch_ord")


def geometries_at(rows: DataFrame, pos_lists: DataFrame, role: str) -> DataFrame:
    """`rows`, once for each segment of the geometry at the packed location in column `role`."""
    p = pos_lists.select(F.col("location").alias("_at"), "feature_id", "patch_ord", "ring_no", "seg_ord", "geo_type", "pos_list")
    return rows.join(p, rows[role] == p["_at"], "left").drop("_at")


def edges_at(edges: DataFrame, x: float, y: float) -> DataFrame:
    """The half-edges at a point, counter-clockwise, with their text."""
    h = ccw_next(half_edges(edges.where(((F.col("src_x") == x) & (F.col("src_y") == y)) | ((F.col("tgt_x") == x) & (F.col("tgt_y") == y)))))
    h = h.where((F.col("x") == x) & (F.col("y") == y))
    return h.withColumn("details", edge_details()).orderBy("angle", "created_key")


def edge_details():
    deg = F.round(F.degrees("angle"), 3).cast("string")
    return F.concat_ws(" ", F.concat(F.lit("to ("), F.col("to_x").cast("string"), F.lit(", "), F.col("to_y").cast("string"), F.lit(")")), F.concat(deg, F.lit("°")), F.concat(F.lit("left "), F.col("left_obj").cast("string")), F.concat(F.lit("right "), F.coalesce(F.col("right_obj").cast("string"), F.lit("none"))))


def diagnostics(uses: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counters. Keys are exact, so there are no collisions and no failed look-ups."""
    u = uses.agg(F.count("*").alias("edge_uses"), F.countDistinct("object_id").alias("objects"))
    e = edges.agg(F.count("*").alias("edges"), F.count("right_obj").alias("edges_with_right"))
    n = nodes(edges).agg(F.count("*").alias("nodes"))
    return u.join(F.broadcast(e)).join(F.broadcast(n)).select("objects", "edge_uses", "edges", "edges_with_right", "nodes", F.lit(0).cast("long").alias("collisions"), F.lit(0).cast("long").alias("lookup_errors"))
