"""Vertices of rings -> directed edge uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import apart, edge_key, held_apart, together

USE_KEY = ("object_id", "ring_no", "seg_ord", "v_ord")
#: The edge of uses from `dealt`. The hash comes last: rows sorted by place take a third less disk.
BY_EDGE = ("edge_key", "edge_hash")
#: Ordinates that packed uses hold apart from those of the first point.
NEAR = {"x2": "x1", "y2": "y1", "px": "x1", "py": "y1"}


def block(number: str = "object_id") -> Column:
    """Neighbouring objects or lines share a block. Rows dealt by it lie beside rows like them, and take a fraction of the disk of rows dealt one by one."""
    return F.shiftright(number, 12)


def edge_uses(vertices: DataFrame, in_blocks: bool = False) -> DataFrame:
    """vertices (object_id, ring_no, seg_ord, v_ord, is_exterior, x, y[, location]) -> one row per use:
    use_key, object_id, ring_no, is_exterior, location, x1, y1, x2, y2, edge_key, forward, prev_edge.

    A ring is one chain over all its segments: gaps between segments are bridged, the end is not joined to the
    start. A vertex equal to the one before is passed over. One shuffle, on the ring, or on blocks of objects."""
    if "location" not in vertices.columns:
        vertices = vertices.withColumn("location", F.col("object_id").cast("long"))
    by = ("object_id", "ring_no")
    if in_blocks:
        vertices, by = vertices.withColumn("block", block()).repartition("block"), ("block", *by)
    ring = W.partitionBy(*by).orderBy("seg_ord", "v_ord")
    v = vertices.select(*by[:-2], *USE_KEY, "is_exterior", "location", "x", "y", F.lag("x").over(ring).alias("x1"), F.lag("y").over(ring).alias("y1"))
    v = v.where("x1 IS NOT NULL AND (x1 <> x OR y1 <> y)").withColumnsRenamed({"x": "x2", "y": "y2"})
    v = v.withColumn("edge_key", edge_key("x1", "y1", "x2", "y2"))
    return v.select(
        F.struct(*USE_KEY).alias("use_key"), "object_id", "ring_no", "is_exterior", "location", "x1", "y1", "x2", "y2", "edge_key",
        ((F.col("x1") == F.col("edge_key.ax")) & (F.col("y1") == F.col("edge_key.ay"))).alias("forward"),
        F.lag("edge_key").over(ring).alias("prev_edge"),
    )


def packed(uses: DataFrame) -> DataFrame:
    """Uses with each point and each object once: what follows from others is left out, the previous edge is its other end px, py; points are held apart from the first,
    locations against the object (nothing is left of them where they are the same), and a right use goes in columns of its own. `unpacked` adds it again."""
    p = F.col("prev_edge")
    here = (p["ax"] == F.col("x1")) & (p["ay"] == F.col("y1"))
    other = lambda c: F.when(here, p[f"b{c}"]).otherwise(p[f"a{c}"]).alias(f"p{c}")
    against = {"location": held("location", "use_key.object_id"), "left_loc": held("left_loc", "location")}
    r, right = "right_use.use_key.", []
    if "right_use" in uses.columns:
        right = [held(r + "object_id", "use_key.object_id").alias("right_object_id"), *[F.col(r + k).alias(f"right_{k}") for k in USE_KEY[1:]], (F.col("right_use.obj") != F.col(r + "object_id")).alias("right_inner"), held("right_use.location", r + "object_id").alias("right_loc")]
    derived = ("object_id", "ring_no", "edge_key", "edge_hash", "forward", "prev_edge", "right_use")
    return apart(uses.select(*[against[c].alias(c) if c in against else c for c in uses.columns if c not in derived], *right, other("x"), other("y")), NEAR)


def held(location: str, against: str) -> Column:
    """A location without what it shares with another number; the same again gives the location."""
    return F.col(location).cast("long").bitwiseXOR(F.col(against).cast("long"))


def right_use(of: str) -> Column:
    """The right use of packed owned uses, whose creators have the object `of`; null where there is none."""
    other = held("right_object_id", of)
    key = F.struct(other.alias("object_id"), *[F.col(f"right_{k}").alias(k) for k in USE_KEY[1:]])
    obj = F.when(F.col("right_inner"), -other).otherwise(other)
    return F.when(other.isNotNull(), F.struct(key.alias("use_key"), obj.alias("obj"), F.col("right_loc").bitwiseXOR(other).alias("location")))


def edge_hash(of_packed: bool = True) -> Column:
    """The same for both directions of an edge."""
    x2, y2 = [held_apart(c, NEAR) if of_packed else F.col(c) for c in ("x2", "y2")]
    return F.xxhash64("x1", "y1").bitwiseXOR(F.xxhash64(x2, y2))


def dealt(uses: DataFrame) -> DataFrame:
    """Packed uses dealt by edge and unpacked after the shuffle, so that it moves each point once; windows by BY_EDGE need no other. (Keys of floating-point
    numbers alone would be normalised and shuffled again.)"""
    return unpacked(uses.repartition(edge_hash())).withColumn("edge_hash", edge_hash(of_packed=False))


def unpacked(uses: DataFrame) -> DataFrame:
    uses = together(uses, NEAR)
    location = held("location", "use_key.object_id")
    of = {"location": location}
    if "left_loc" in uses.columns:
        of["left_loc"] = F.col("left_loc").bitwiseXOR(location)
    if "right_object_id" in uses.columns:
        of["right_use"] = right_use("use_key.object_id")
    uses = uses.withColumns(of).drop(*[f"right_{k}" for k in (*USE_KEY, "inner", "loc")])
    u = uses.withColumns({"object_id": F.col("use_key.object_id"), "ring_no": F.col("use_key.ring_no"), "edge_key": edge_key("x1", "y1", "x2", "y2"), "prev_edge": F.when(F.col("px").isNotNull(), edge_key("px", "py", "x1", "y1"))})
    return u.withColumn("forward", (F.col("x1") == F.col("edge_key.ax")) & (F.col("y1") == F.col("edge_key.ay"))).drop("px", "py")
