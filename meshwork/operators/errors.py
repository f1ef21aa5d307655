"""The error relation: numbering, repeats, filters, statistics, messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lookup import features_at
from .numbering import numbered

#: Codes that a filter may name (fixed values).
CODES = ("RING_OVERLAPPING_EDGES", "RING_INTERSECTION", "HOLE_EMPTY_INTERIOR", "FREE_STANDING_SURFACE", "BOUNDARY_POINT_DETACHED", "BOUNDARY_EDGE_INVALID", "EDGE_NOT_FOUND", "INVALID_ANGLE")
#: Codes that an export leaves out unless they are named (fixed values).
TECHNICAL = ("EDGE_NOT_FOUND", "INVALID_ANGLE")
#: The order in which detections report unless a caller gives numbers of its own.
PHASES = {"surface": 1, "holes": 2, "free": 3, "boundary": 4}
#: How an error can name a geometry.
ROLES = ("is", "o", "cw", "ccw")

COLUMNS = {"t": "string", "x": "double", "y": "double", "is_loc": "bigint", "o_loc": "bigint", "cw_loc": "bigint", "ccw_loc": "bigint", "x2": "double", "y2": "double", "obj": "bigint", "tx": "double", "ty": "double"}
ORDER = ("phase", "k1", "k2", "k3", "k4", "k5")


def as_errors(df: DataFrame, code: str, phase: str | int) -> DataFrame:
    """Any operator's error rows in the common shape, with the key that orders emission."""
    if "use_key" in df.columns:
        keys = [F.col(f"use_key.{k}") for k in ("object_id", "ring_no", "seg_ord", "v_ord")]
    else:
        keys = [F.col("line_id"), F.col("part"), F.col("v_ord"), F.lit(0)]
    keys.append(F.col("end_no") if "end_no" in df.columns else F.lit(2))
    given = {c: (F.lit(code) if c == "t" else F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in COLUMNS.items()}
    return df.select(F.lit(PHASES.get(phase, phase)).alias("phase"), *[k.cast("long").alias(f"k{i + 1}") for i, k in enumerate(keys)], *given.values())


def number_errors(parts: list[DataFrame]) -> DataFrame:
    """i counts errors in order of emission, p is the first i at the same place (null for that one)."""
    every = reduce(DataFrame.unionByName, parts)
    i = numbered(every, [*ORDER, "t", "x", "y"], "i")
    first = F.min("i").over(W.partitionBy("x", "y"))
    return i.withColumn("p", F.when(first < F.col("i"), first)).select("i", "t", "p", *[c for c in COLUMNS if c != "t"])


def filter_errors(errors: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Errors that repeat no place, of the given codes (all without). Unknown codes raise at once."""
    for c in codes or ():
        if c not in CODES:
            raise ValueError(f"INVALID_ERROR_CODE: {c}")
    own = errors.where("p IS NULL")
    return own.where(F.col("t").isin(list(codes))) if codes else own


def error_statistics(errors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return errors.groupBy(*by, "t").agg(F.count("*").alias("errors"), F.count("p").alias("repeats"))


def with_features(errors: DataFrame, features: DataFrame) -> DataFrame:
    """Errors with the ids of the features that they name, as <role>_feature: is, o, cw and ccw. One look-up for all roles."""
    each = errors.select("i", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_loc").alias("location")) for r in ROLES])).alias("e")).select("i", "e.*")
    found = features_at(each.where("location <> 0"), features, "location").groupBy("i").agg(*[F.max(F.when(F.col("role") == r, F.col("feature_id"))).alias(f"{r}_feature") for r in ROLES])
    return errors.join(found, "i", "left")


def error_message(columns: list[str] = ()) -> Column:
    """A sentence for each error. Geometries go by their location, with the feature's id where `columns` has it (see with_features)."""

    def geometry(role: str) -> Column:
        at = F.coalesce(F.col(f"{role}_loc").cast("string"), F.lit("?"))
        own = F.col(f"{role}_feature")
        return F.when(own.isNotNull(), F.concat(at, F.lit(" of feature "), own)).otherwise(at) if f"{role}_feature" in columns else at

    at = F.concat(F.lit(" at ("), F.col("x").cast("string"), F.lit(", "), F.col("y").cast("string"), F.lit(")"))
    t = F.col("t")
    return (
        F.when(t == "RING_OVERLAPPING_EDGES", F.concat(F.lit("Edge of geometry "), geometry("o"), F.lit(" overlaps geometry "), geometry("is"), at))
        .when(t == "HOLE_EMPTY_INTERIOR", F.concat(F.lit("Interior of geometry "), geometry("is"), F.lit(" is not filled"), at))
        .when(t == "FREE_STANDING_SURFACE", F.concat(F.lit("Geometry "), geometry("is"), F.lit(" does not touch the coverage"), at))
        .when(t == "BOUNDARY_POINT_DETACHED", F.concat(F.lit("Boundary point is on no node"), at))
        .when(t == "BOUNDARY_EDGE_INVALID", F.concat(F.lit("Boundary has no edge between ("), F.col("x2").cast("string"), F.lit(", "), F.col("y2").cast("string"), F.lit(") and its point"), at))
        .when(t.isin(*TECHNICAL), F.concat(F.lit("Edge of object "), F.col("obj").cast("string"), F.lit(" could not be attached"), at))
        .otherwise(F.concat(F.lit("Geometry "), geometry("is"), F.lit(" intersects, clockwise "), geometry("cw"), F.lit(", counter-clockwise "), geometry("ccw"), at))
    )
