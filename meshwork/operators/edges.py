"""Edge uses -> edges with owners, nodes, overlap errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import angle, together
from .rings import NEAR, USE_KEY


def signed_object(object_id: str = "object_id", is_exterior: str = "is_exterior"):
    return F.when(F.col(is_exterior), F.col(object_id)).otherwise(-F.col(object_id))


def owned_uses(uses: DataFrame, by: tuple[str, ...] = ("edge_key",)) -> DataFrame:
    """Each use with its part in the ownership of its edge: n (1 is the creator), same, right_no, and what the whole edge has: left_loc, right_use, uses.

    Windows on edge_key decide all, after one shuffle: uses of the creator's role and direction collide on the left, the
    first other use takes the right, later ones collide there."""
    w = W.partitionBy(*by).orderBy("use_key")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    u = uses.withColumns({"n": F.row_number().over(w), "same": (F.col("is_exterior") == F.first("is_exterior").over(upto)) & (F.col("forward") == F.first("forward").over(upto)), "left_loc": F.first("location").over(upto), "uses": F.count("*").over(whole)})
    other = (F.col("n") > 1) & ~F.col("same")
    u = u.withColumn("right_no", F.sum(F.when(other, 1).otherwise(0)).over(upto))
    taken = F.struct("use_key", signed_object().alias("obj"), "location")
    return u.withColumn("right_use", F.first(F.when(other & (F.col("right_no") == 1), taken), ignorenulls=True).over(whole))


def reported(owned: DataFrame) -> DataFrame:
    """The owned uses that `edges` and `overlapping_edges` read: creators and those that collide."""
    return owned.where("n = 1 OR same OR right_no > 1")


def edges(owned: DataFrame) -> DataFrame:
    """One row per undirected edge in the direction of its creation: the creators' rows, which know the right owner by the window. No further shuffle."""
    r = F.col("right_use")
    e = owned.where("n = 1").select(
        "edge_key", F.col("use_key").alias("created_key"), F.col("x1").alias("src_x"), F.col("y1").alias("src_y"), F.col("x2").alias("tgt_x"), F.col("y2").alias("tgt_y"),
        "is_exterior", "prev_edge", signed_object().alias("left_obj"), F.col("location").alias("left_loc"),
        r["obj"].alias("right_obj"), r["location"].alias("right_loc"), r["use_key"].alias("right_key"), "uses",
    )
    return e.withColumns({"src_angle": angle("src_x", "src_y", "tgt_x", "tgt_y"), "tgt_angle": angle("tgt_x", "tgt_y", "src_x", "src_y")})


def flat_edges(packed: DataFrame) -> DataFrame:
    """`edges` of owned uses that are packed, without structs and what follows from other columns; locations stay held against objects. px, py: the other end of the ring's previous edge."""
    return together(packed.where("n = 1"), NEAR).select(
        F.col("x1").alias("src_x"), F.col("y1").alias("src_y"), F.col("x2").alias("tgt_x"), F.col("y2").alias("tgt_y"), "px", "py", "is_exterior", F.col("location").alias("left_loc"),
        "right_inner", "right_loc", *[F.col(f"use_key.{k}").alias(f"created_{k}") for k in USE_KEY], *[f"right_{k}" for k in USE_KEY],
    )


def overlapping_edges(owned: DataFrame, with_edge: bool = False) -> DataFrame:
    """RING_OVERLAPPING_EDGES: use_key, x, y (target of the colliding use), is_loc, o_loc, side, and edge_key if asked for."""
    left, right = (F.col("n") > 1) & F.col("same"), (F.col("n") > 1) & ~F.col("same") & (F.col("right_no") > 1)
    return owned.where(left | right).select("use_key", F.col("x2").alias("x"), F.col("y2").alias("y"), F.when(left, F.col("left_loc")).otherwise(F.col("right_use.location")).alias("is_loc"), F.col("location").alias("o_loc"), F.when(left, "left").otherwise("right").alias("side"), *(["edge_key"] if with_edge else []))


def overlap_pairs(overlaps: DataFrame) -> DataFrame:
    return overlaps.groupBy("is_loc", "o_loc").agg(F.count("*").alias("edges"))


def nodes(edge_table: DataFrame) -> DataFrame:
    """Distinct nodes with their degree."""
    at = lambda end: F.struct(F.col(f"{end}_x").alias("x"), F.col(f"{end}_y").alias("y"))
    ends = edge_table.select(F.inline(F.array(at("src"), at("tgt"))))
    return ends.groupBy("x", "y").agg(F.count("*").alias("degree"))


def bounding_box(vertices: DataFrame) -> DataFrame:
    return vertices.agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
