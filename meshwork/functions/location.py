"""Packed 64-bit locations: [8 bit database][24 bit geometry - feature][32 bit geometry]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW32 = 0xFFFFFFFF
_LOW24 = 0xFFFFFF


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack_location(db, geometry_pos, feature_pos) -> Column:
    delta = (_c(geometry_pos) - _c(feature_pos)).cast("long")
    return F.shiftleft(_c(db).cast("long"), 56).bitwiseOR(F.shiftleft(delta.bitwiseAND(F.lit(_LOW24)), 32)).bitwiseOR(_c(geometry_pos).cast("long").bitwiseAND(F.lit(_LOW32)))


def location_db(v) -> Column:
    return F.shiftrightunsigned(_c(v), 56).cast("int")


def location_delta(v) -> Column:
    return F.shiftrightunsigned(_c(v), 32).bitwiseAND(F.lit(_LOW24)).cast("int")


def location_geometry(v) -> Column:
    return _c(v).bitwiseAND(F.lit(_LOW32))


def location_feature(v) -> Column:
    return location_geometry(v) - location_delta(v)


def location_db_name(v, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(location_db(v).cast("string"), 3, "0"))


def feature_as_location(v) -> Column:
    """The feature's own location (no delta): the key that makes geometries of one feature equal."""
    pos = location_feature(v)
    return pack_location(location_db(v), pos, pos)


def pack_ints(left, right) -> Column:
    return F.shiftleft(_c(left).cast("long"), 32).bitwiseOR(_c(right).cast("long").bitwiseAND(F.lit(_LOW32)))


def left_int(v) -> Column:
    return F.shiftright(_c(v), 32).cast("int")


def right_int(v) -> Column:
    low = _c(v).bitwiseAND(F.lit(_LOW32))
    return F.when(low > 0x7FFFFFFF, low - (1 << 32)).otherwise(low).cast("int")
