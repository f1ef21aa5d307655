"""The location functions for SQL. They are SQL bodies that Catalyst inlines, not Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "topo_pack_location(db INT, geometry_pos BIGINT, feature_pos BIGINT) RETURNS BIGINT": "shiftleft(CAST(db AS BIGINT), 56) | shiftleft((geometry_pos - feature_pos) & 16777215, 32) | (geometry_pos & 4294967295)",
    "topo_location_db(v BIGINT) RETURNS INT": "CAST(shiftrightunsigned(v, 56) AS INT)",
    "topo_location_geometry(v BIGINT) RETURNS BIGINT": "v & 4294967295",
    "topo_location_feature(v BIGINT) RETURNS BIGINT": "(v & 4294967295) - (shiftrightunsigned(v, 32) & 16777215)",
    "topo_location_db_name(v BIGINT, prefix STRING) RETURNS STRING": "concat(prefix, lpad(CAST(shiftrightunsigned(v, 56) AS STRING), 3, '0'))",
    "topo_turn(reference DOUBLE, other DOUBLE) RETURNS DOUBLE": "CASE WHEN reference - other < 0 THEN reference - other + 2 * pi() ELSE reference - other END",
}


def register_functions(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
