"""Polygon coverages derived from the star-schema tables, as SQL that Spark and other engines share.

Order keys are cells of a grid of width 40. Faults are built in: missing, doubled and shifted
cells, stretched cells and tilted triangles, interior rings of which every other is filled, islands, and lines that
leave the edges.
Ordinates are multiples of 1/8, so all engines hold the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CELL = "1000.125e0 + 10 * (k % 40) AS x0, 2000.125e0 + 10 * cast((k - k % 40) / 40 AS bigint) AS y0"

#: rings(object_id, ring_no, is_exterior, x0, y0, a, b, sx): a box from (x0 + sx a, y0 + a) to (x0 + sx b, y0 + b).
RINGS = f"""
cells AS (SELECT o_orderkey AS k, {_CELL} FROM (SELECT o_orderkey, o_orderkey AS k FROM orders) o WHERE o_orderkey % 97 <> 0),
rings AS (
  SELECT 8 * k + 1 AS object_id, 0 AS ring_no, true AS is_exterior, CASE WHEN k % 83 = 0 THEN x0 + 0.5e0 ELSE x0 END AS x0, y0, 0e0 AS a, 10e0 AS b, 1e0 AS sx FROM cells
  UNION ALL SELECT 8 * k + 2, 0, true, x0, y0, 0e0, 10e0, 1e0 FROM cells WHERE k % 89 = 0
  UNION ALL SELECT 8 * k + 1, 1, false, x0, y0, 2.5e0, 7.5e0, 1e0 FROM cells WHERE k % 50 = 0
  UNION ALL SELECT 8 * k + 3, 0, true, x0, y0, 2.5e0, 7.5e0, 1e0 FROM cells WHERE k % 100 = 0
  UNION ALL SELECT 8 * k + 5, 0, true, x0, y0, 0e0, 10e0, 2e0 FROM cells WHERE k % 79 = 0
  UNION ALL SELECT 8 * (1000000000 + s_suppkey) + 1, 0, true, 100000.125e0 + 100 * (s_suppkey % 1000), 100 * cast((s_suppkey - s_suppkey % 1000) / 1000 AS bigint) + 0.125e0, 0e0, 10e0, 1e0 FROM supplier)"""

#: vertices(object_id, ring_no, seg_ord, v_ord, is_exterior, x, y): exteriors counter-clockwise, interiors clockwise; one more vertex
#: closes the ring. Tilted triangles over several cells come after the boxes.
VERTICES = f"""{RINGS},
corners AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) AS c(v, cx, cy)),
tips AS (SELECT * FROM (VALUES (0, 0, 0), (1, 20, 10), (2, 10, 20), (3, 0, 0)) AS c(v, cx, cy)),
vertices AS (
  SELECT object_id, ring_no, 0 AS seg_ord, v AS v_ord, is_exterior,
         x0 + sx * CASE WHEN (CASE WHEN is_exterior THEN cx ELSE cy END) = 1 THEN b ELSE a END AS x,
         y0 + CASE WHEN (CASE WHEN is_exterior THEN cy ELSE cx END) = 1 THEN b ELSE a END AS y
  FROM rings CROSS JOIN corners
  UNION ALL SELECT 8 * k + 4, 0, 0, v, true, x0 + cx, y0 + cy FROM cells CROSS JOIN tips WHERE k % 61 = 0)"""

#: lines(line_id, v_ord, x, y): one line for each order, its items' places on the grid.
LINES = """
items AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
lines AS (
  SELECT l_orderkey AS line_id, n AS v_ord,
         1000.125e0 + 10 * (l_orderkey % 40 + n) AS x,
         2000.125e0 + 10 * (cast((l_orderkey - l_orderkey % 40) / 40 AS bigint) + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END) + CASE WHEN l_partkey % 11 = 0 THEN 0.25e0 ELSE 0e0 END AS y
  FROM items)"""

#: pos_lists(object_id, ring_no, seg_ord, is_exterior, geo_type, pos_list).
POS_LISTS = f"""{RINGS},
pos_lists AS (
  SELECT object_id, ring_no, 0 AS seg_ord, is_exterior, 2 AS geo_type,
         concat(cast(x0 + sx * a AS varchar(30)), ' ', cast(y0 + a AS varchar(30)), ' ', cast(x0 + sx * b AS varchar(30)), ' ', cast(y0 + a AS varchar(30)), '  ', cast(x0 + sx * b AS varchar(30)), ' ', cast(y0 + b AS varchar(30)), ' ', cast(x0 + sx * b AS varchar(30)), ' ', cast(y0 + b AS varchar(30))) AS pos_list
  FROM rings)"""


#: An object's packed location: database 0 holds the grid, database 1 the islands; a cell is a feature of up to five patches.
LOCATION = "CASE WHEN object_id > 8000000000 THEN 72057594037927936 + ((object_id - 1) % 8) * 4294967296 + object_id - 8000000000 ELSE ((object_id - 1) % 8) * 4294967296 + object_id END"

#: features(db_idx, first_geometry, patches, feature_id, feature_type), as many as there are cells and islands.
FEATURES = f"""{RINGS},
features AS (
  SELECT CASE WHEN k >= 1000000000 THEN 1 ELSE 0 END AS db_idx, 8 * (k % 1000000000) AS first_geometry, count(*) AS patches, concat('F', cast(k AS varchar(20))) AS feature_id, CASE WHEN k >= 1000000000 THEN 'Island' ELSE 'Cell' END AS feature_type
  FROM (SELECT DISTINCT object_id, cast((object_id - (object_id - 1) % 8 - 1) / 8 AS bigint) AS k FROM (SELECT object_id FROM rings UNION ALL SELECT 8 * k + 4 FROM cells WHERE k % 61 = 0) o) p GROUP BY k)"""


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "orders", "supplier")
    return spark.sql(f"WITH {VERTICES} SELECT * FROM vertices")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "orders", "supplier")
    return spark.sql(f"WITH {FEATURES} SELECT * FROM features")


def located(df: DataFrame) -> DataFrame:
    return df.withColumn("location", F.expr(LOCATION))


def gml_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, value): the coverage as GML, one feature member a line, in the order of k; a cell is a feature of one or several patches."""
    v = vertices(spark, sf_dir).withColumn("k", F.expr("(object_id - 1) div 8"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", "v_ord", "x", "y"))), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    ring = v.groupBy("k", "object_id", "ring_no", "is_exterior").agg(F.concat_ws(" ", texts).alias("p"))
    kind = F.when(F.col("is_exterior"), "exterior").otherwise("interior")
    curve = F.concat(F.lit('<gml:Ring><gml:curveMember><gml:Curve gml:id="C'), "object_id", F.lit("_"), "ring_no", F.lit('"><gml:segments><gml:LineStringSegment><gml:posList>'), "p", F.lit("</gml:posList></gml:LineStringSegment></gml:segments></gml:Curve></gml:curveMember></gml:Ring>"))
    ring = ring.withColumn("xml", F.concat(F.lit("<gml:"), kind, F.lit(">"), curve, F.lit("</gml:"), kind, F.lit(">")))
    joined = lambda *by: F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(*by, "xml"))), lambda r: r["xml"]))
    patch = ring.groupBy("k", "object_id").agg(joined("ring_no").alias("xml")).withColumn("xml", F.concat(F.lit("<gml:PolygonPatch>"), "xml", F.lit("</gml:PolygonPatch>")))
    head = F.concat(F.lit('<gml:featureMember><adv:Cell gml:id="F'), F.col("k").cast("string"), F.lit('"><adv:modellart><adv:AA_Modellart><adv:advStandardModell>DLKM</adv:advStandardModell></adv:AA_Modellart></adv:modellart><adv:position><gml:Surface gml:id="S'), F.col("k").cast("string"), F.lit('"><gml:patches>'))
    return patch.groupBy("k").agg(joined("object_id").alias("xml")).select("k", F.concat(head, "xml", F.lit("</gml:patches></gml:Surface></adv:position></adv:Cell></gml:featureMember>")).alias("value"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "lineitem")
    return spark.sql(f"WITH {LINES} SELECT * FROM lines")


def pos_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "orders", "supplier")
    return spark.sql(f"WITH {POS_LISTS} SELECT * FROM pos_lists")
