"""Face walks: unfilled holes and free-standing surfaces, as path labelling by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialise import discard, keep, keep_lean
from .rings import USE_KEY
from .rotation import ccw_next, half_edges


def candidates(edges: DataFrame, inner: bool | None = None) -> DataFrame:
    """Edges without a right owner: those of interior rings (holes), those of exterior rings (free-standing surfaces), or both."""
    c = edges.where("right_obj IS NULL").withColumn("inner", F.col("left_obj") < 0)
    return c if inner is None else c.where(F.col("inner") == inner)


def successors(edges: DataFrame, inner: bool | None = None) -> DataFrame:
    """(id, next): the candidate of the same kind that follows on the right face, null where the walk leaves the candidates.
    id is the creation key, which orders the walks."""
    turn = ccw_next(half_edges(edges)).where("sign = -1 AND next_sign = 1").select("edge_key", "next_edge")
    c = candidates(edges, inner).select("edge_key", "inner", F.col("created_key").alias("id"))
    ends = c.select(F.col("edge_key").alias("next_edge"), "inner", F.col("id").alias("next"))
    return c.join(turn, "edge_key", "left").join(ends, ["next_edge", "inner"], "left").select("id", "next")


def walk_starts(successor: DataFrame, checkpoint: bool = True) -> DataFrame:
    """(start, length) of every walk. A start is smaller than all candidates before it on its path, or the smallest of its
    cycle; its walk ends before the next start.

    Each round doubles the stretch that is known behind a candidate and keeps the smallest id on it. When a round changes
    no smallest id none is farther away: O(log longest path) rounds of one join each. Rounds are checkpointed, and go when the next one is."""
    state = successor.select("id").join(successor.where("next IS NOT NULL").select(F.col("next").alias("id"), F.col("id").alias("back")), "id", "left").withColumn("low", F.col("id"))
    old = None
    while True:
        behind = state.select(F.col("id").alias("back"), F.col("back").alias("back2"), F.col("low").alias("low2"))
        lower = F.least("low", F.coalesce("low2", "low"))
        new = state.join(behind, "back", "left").select("id", F.col("back2").alias("back"), lower.alias("low"), (lower < F.col("low")).alias("moved"))
        if checkpoint:
            new = keep_lean(new)
            if old is not None:
                discard(old)
            old = new
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    starts = state.groupBy(F.col("low").alias("start")).agg(F.count("*").alias("length"))
    if old is not None:
        starts._kept_at = old._kept_at  # `discard` deletes the last round
    return starts


def walks(edges: DataFrame, inner: bool | None = None) -> DataFrame:
    """Every walk by its first edge: use_key, x, y (the edge's source), is_loc, inner, length. Both kinds are walked at once unless one is asked for."""
    starts = walk_starts(successors(edges, inner))
    first = F.col("created_key").alias("use_key"), F.col("src_x").alias("x"), F.col("src_y").alias("y"), F.col("left_loc").alias("is_loc"), (F.col("left_obj") < 0).alias("inner")
    return edges.join(starts, edges["created_key"] == starts["start"]).select(*first, "length")


def turned_walks(turned: DataFrame) -> DataFrame:
    """The walks of both kinds from `rotation.turns`, as a table of `keep_lean`."""
    opened = turned.where("open")
    starts = walk_starts(opened.select(F.col("created_key").alias("id"), F.col("follower").alias("next")))
    first = F.col("created_key").alias("use_key"), F.col("to_x").alias("x"), F.col("to_y").alias("y"), F.col("left_loc").alias("is_loc"), (F.col("left_obj") < 0).alias("inner")
    walked = keep_lean(opened.join(starts, opened["created_key"] == starts["start"]).select(*first, "length"))
    discard(starts)
    return walked


def holes(edges: DataFrame | None = None, walked: DataFrame | None = None) -> DataFrame:
    """HOLE_EMPTY_INTERIOR: use_key, x, y, is_loc of every interior walk. `walked`: the walks where they are known."""
    return (walks(edges, True) if walked is None else walked).where("inner").drop("inner", "length")


def free_standing(edges: DataFrame | None = None, walked: DataFrame | None = None) -> DataFrame:
    """FREE_STANDING_SURFACE: exterior walks of three edges or more but the longest (the first of equal ones)."""
    w = (keep(walks(edges, False)) if walked is None else walked).where("NOT inner AND length >= 3")
    # Top-1 by aggregate: one row for each task, no global sort.
    longest = w.agg(F.max_by("use_key", F.struct("length", *[(-F.col(f"use_key.{k}")).alias(k) for k in USE_KEY])).alias("longest"))
    return w.join(F.broadcast(longest), F.col("use_key") == F.col("longest"), "left_anti").drop("inner", "length")
