"""Scalar geometry on columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Geometry type codes of segments.
ARC, LINE = 1, 2


def edge_key(x1, y1, x2, y2) -> Column:
    """The undirected edge: its two points in order."""
    a, b = F.struct(F.col(x1).alias("x"), F.col(y1).alias("y")), F.struct(F.col(x2).alias("x"), F.col(y2).alias("y"))
    low, high = F.least(a, b), F.greatest(a, b)
    return F.struct(low["x"].alias("ax"), low["y"].alias("ay"), high["x"].alias("bx"), high["y"].alias("by"))


def angle(from_x, from_y, to_x, to_y) -> Column:
    """Direction in radians, -pi to pi."""
    return F.atan2(F.col(to_y) - F.col(from_y), F.col(to_x) - F.col(from_x))


def turn(reference: Column, other: Column) -> Column:
    """How far `other` lies clockwise of `reference`, 0 to 2 pi."""
    d = reference - other
    return F.when(d < 0, d + 2 * math.pi).otherwise(d)


def apart(df: DataFrame, near: dict[str, str]) -> DataFrame:
    """Ordinates (the keys of `near`) as differences d_<name> to others that they are near, which repeat and take little disk. Rows of which a difference would not give
    every ordinate again bit by bit hold all of them in as_is, null elsewhere. `together` is the inverse."""
    d = {f"d_{c}": F.col(c) - F.col(o) for c, o in near.items()}
    # A sum is never -0.0 unless both are, so zeros are held as they are.
    same = [(F.col(o) + d[f"d_{c}"]).eqNullSafe(F.col(c)) & (F.col(c).isNull() | (F.col(c) != 0)) for c, o in near.items()]
    return df.withColumns(d | {"as_is": F.when(~reduce(Column.__and__, same), F.struct(*near))}).drop(*near)


def held_apart(c: str, near: dict[str, str]) -> Column:
    """An ordinate of `apart`."""
    return F.when(F.col("as_is").isNotNull(), F.col(f"as_is.{c}")).otherwise(F.col(near[c]) + F.col(f"d_{c}"))


def together(df: DataFrame, near: dict[str, str]) -> DataFrame:
    return df.withColumns({c: held_apart(c, near) for c in near}).drop(*[f"d_{c}" for c in near], "as_is")
