"""Boundary lines against a topology: anti joins with its nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import apart, edge_key, held_apart, together
from .edges import nodes
from .materialise import discard, keep_lean, sliced
from .rings import block

#: Ordinates that kept vertices of lines hold apart from those of the vertex.
NEAR = {"px": "x", "py": "y"}
#: The same of the ends of edges.
ENDS_NEAR = {"x2": "x1", "y2": "y1"}


def line_vertices(lines: DataFrame, restart_per_part: bool = False) -> DataFrame:
    """lines (line_id, v_ord, x, y[, part]) with consecutive equal vertices dropped, px, py the vertex before. All parts of a line are
    one chain unless `restart_per_part`."""
    if "part" not in lines.columns:
        lines = lines.withColumn("part", F.lit(0))
    w = W.partitionBy("line_id", *(["part"] if restart_per_part else [])).orderBy("part", "v_ord")
    v = lines.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    return v.where("px IS NULL OR x <> px OR y <> py")


def points_detached(lines: DataFrame, edges: DataFrame, at: DataFrame | None = None, **options) -> DataFrame:
    """BOUNDARY_POINT_DETACHED: vertices that are no node. `at`: the edges' nodes where they are known."""
    n = nodes(edges) if at is None else at
    return line_vertices(lines, **options).join(n.select("x", "y"), ["x", "y"], "left_anti").select("line_id", "part", "v_ord", "x", "y")


def edges_invalid(lines: DataFrame, edges: DataFrame, at: DataFrame | None = None, **options) -> DataFrame:
    """BOUNDARY_EDGE_INVALID: neighbouring vertices that are nodes without an edge between. x, y is the
    current vertex, x2, y2 the one before; a detached vertex interrupts the chain. Pairs with an edge, mostly all, go first; two semi joins with
    the nodes see the few that are left."""
    n = nodes(edges) if at is None else at
    pairs = line_vertices(lines, **options).where("px IS NOT NULL").withColumn("edge_key", edge_key("px", "py", "x", "y"))
    loose = pairs.join(edges.select("edge_key"), "edge_key", "left_anti").join(n.select("x", "y"), ["x", "y"], "left_semi")
    loose = loose.join(n.select(F.col("x").alias("px"), F.col("y").alias("py")), ["px", "py"], "left_semi")
    return loose.select("line_id", "part", "v_ord", "x", "y", F.col("px").alias("x2"), F.col("py").alias("y2"))


def kept_vertices(lines: DataFrame, slices: int = 1, **options) -> DataFrame:
    plan = lambda part: apart(line_vertices(part, **options).select("line_id", "part", "v_ord", "x", "y", "px", "py"), NEAR)
    return keep_lean(*sliced(slices, plan, (lines, F.xxhash64(block("line_id")))))


def sliced_errors(v: DataFrame, ends: DataFrame, at: DataFrame, slices: int) -> tuple[DataFrame, DataFrame]:
    """`points_detached` and `edges_invalid` of `kept_vertices`, which are discarded, in slices: a vertex with an edge to the one before is on a node, so only others
    are held against nodes. ends: the edges by their points x1, y1, x2, y2, as `apart` holds them, discarded when they are read."""
    key, fewer, starts = ("edge_key",), -(-slices // 2), held_apart("px", NEAR).isNull()
    last = F.struct("x", "y") >= F.struct("px", "py")
    pairs = together(v.where(~starts), NEAR).select("line_id", "part", "v_ord", edge_key("px", "py", "x", "y").alias("edge_key"), last.alias("last"))

    def without_edge(p: DataFrame, e: DataFrame) -> DataFrame:
        """The shuffle moves each point once: a vertex and the one before are the ends of their edge."""
        p = p.join(e, "edge_key", "left_anti")
        end = lambda here, c: F.when(here, F.col(f"edge_key.b{c}")).otherwise(F.col(f"edge_key.a{c}"))
        p = p.withColumns({"x": end(F.col("last"), "x"), "y": end(F.col("last"), "y"), "px": end(~F.col("last"), "x"), "py": end(~F.col("last"), "y")})
        return apart(p, NEAR).select(v.columns)

    edge = together(ends, ENDS_NEAR).select(edge_key("x1", "y1", "x2", "y2").alias("edge_key"))
    loose = keep_lean(v.where(starts), *sliced(slices, without_edge, (pairs, key), (edge, key)))
    discard(v, ends)
    n, place = at.select("x", "y", F.lit(True).alias("hit")), ("x", "y")
    met = keep_lean(*sliced(fewer, lambda p, m: p.join(m, ["x", "y"], "left").where(F.col("hit").isNull() | ~starts).select(*v.columns, "hit"), (loose, place), (n, place)))
    discard(loose)
    before, place = at.select(F.col("x").alias("px"), F.col("y").alias("py")), ("px", "py")
    invalid = keep_lean(*sliced(fewer, lambda p, m: p.join(m, ["px", "py"], "left_semi").select("line_id", "part", "v_ord", "x", "y", F.col("px").alias("x2"), F.col("py").alias("y2")), (together(met.where("hit"), NEAR), place), (before, place)))
    detached = keep_lean(met.where("hit IS NULL").select("line_id", "part", "v_ord", "x", "y"))
    discard(met)
    return detached, invalid


def boundary_overlaps(lines: DataFrame, **options) -> DataFrame:
    """Extension: edges that more than one line runs along, with their lines counted."""
    v = line_vertices(lines, **options).where("px IS NOT NULL").withColumn("edge_key", edge_key("px", "py", "x", "y"))
    return v.select("edge_key", "line_id").distinct().groupBy("edge_key").agg(F.count("*").alias("lines"), F.min("line_id").alias("first_line")).where("lines > 1")
