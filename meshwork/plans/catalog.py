"""The engine's queries over coverages derived from the driver's tables, and the same rules as plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import location as loc
from ..functions.poslist import tokenize_pos_lists
from ..functions.sql import register_functions
from ..operators import boundaries, edges, errors, faces, lookup, rings, rotation, validation
from ..operators.materialise import discard, keep
from ..sources import coverages, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- the rules as SQL, built up step by step -------------------------------------------------

_KEY = "object_id, ring_no, seg_ord, v_ord"
_USES = f"""{coverages.VERTICES},
chained AS (SELECT *, lag(x) OVER r AS x1, lag(y) OVER r AS y1 FROM vertices WINDOW r AS (PARTITION BY object_id, ring_no ORDER BY seg_ord, v_ord)),
steps AS (SELECT object_id, ring_no, seg_ord, v_ord, is_exterior, x1, y1, x AS x2, y AS y2, (x1 < x OR (x1 = x AND y1 < y)) AS fwd, row_number() OVER (ORDER BY {_KEY}) AS u
  FROM chained WHERE x1 IS NOT NULL AND (x1 <> x OR y1 <> y)),
uses AS MATERIALIZED (SELECT *, CASE WHEN fwd THEN x1 ELSE x2 END AS ax, CASE WHEN fwd THEN y1 ELSE y2 END AS ay, CASE WHEN fwd THEN x2 ELSE x1 END AS bx, CASE WHEN fwd THEN y2 ELSE y1 END AS by_,
    lag(x1) OVER r AS px, lag(y1) OVER r AS py FROM steps WINDOW r AS (PARTITION BY object_id, ring_no ORDER BY seg_ord, v_ord))"""
_OWNED = f"""{_USES},
firsts AS MATERIALIZED (SELECT ax, ay, bx, by_, min(u) AS u1, count(*) AS uses FROM uses GROUP BY ALL),
marked AS MATERIALIZED (SELECT s.*, f.u1, (s.u > f.u1 AND s.is_exterior = c.is_exterior AND s.fwd = c.fwd) AS same,
    (s.u > f.u1 AND NOT (s.is_exterior = c.is_exterior AND s.fwd = c.fwd)) AS compat, c.object_id AS creator
  FROM uses s JOIN firsts f USING (ax, ay, bx, by_) JOIN uses c ON c.u = f.u1),
rights AS (SELECT u1, min(u) AS u2 FROM marked WHERE compat GROUP BY u1)"""
_EDGES = f"""{_OWNED},
edges AS MATERIALIZED (SELECT f.ax, f.ay, f.bx, f.by_, f.u1 AS u, f.uses, c.px, c.py, c.object_id, c.ring_no, c.seg_ord, c.v_ord, c.is_exterior, c.x1 AS src_x, c.y1 AS src_y, c.x2 AS tgt_x, c.y2 AS tgt_y,
    CASE WHEN c.is_exterior THEN c.object_id ELSE -c.object_id END AS left_obj, c.object_id AS left_loc,
    CASE WHEN o.is_exterior THEN o.object_id ELSE -o.object_id END AS right_obj, o.object_id AS right_loc, r.u2
  FROM firsts f JOIN uses c ON c.u = f.u1 LEFT JOIN rights r ON r.u1 = f.u1 LEFT JOIN uses o ON o.u = r.u2)"""
_OVERLAPS = f"""{_OWNED},
overlapped AS (SELECT m.object_id, m.ring_no, m.seg_ord, m.v_ord, m.x2 AS x, m.y2 AS y, CASE WHEN same THEN m.creator ELSE o.object_id END AS is_loc, m.object_id AS o_loc, CASE WHEN same THEN 'left' ELSE 'right' END AS side
  FROM marked m LEFT JOIN rights r ON r.u1 = m.u1 LEFT JOIN uses o ON o.u = r.u2 WHERE same OR (compat AND m.u > r.u2))"""
_HALVES = f"""{_EDGES},
halves AS MATERIALIZED (
  SELECT e.*, src_x AS x, src_y AS y, tgt_x AS to_x, tgt_y AS to_y, 1 AS sign, atan2(tgt_y - src_y, tgt_x - src_x) AS angle FROM edges e
  UNION ALL SELECT e.*, tgt_x, tgt_y, src_x, src_y, -1, atan2(src_y - tgt_y, src_x - tgt_x) FROM edges e),
turned AS (SELECT *, coalesce(lead(u) OVER n, first_value(u) OVER n) AS next_u, coalesce(lead(sign) OVER n, first_value(sign) OVER n) AS next_sign
  FROM halves WINDOW n AS (PARTITION BY x, y ORDER BY angle, u))"""
# Every half-edge is held against those that were at its node before; the sides of an older edge are owned as of the newer one.
_ATTACHED = f"""{_HALVES},
met AS (SELECT n.u, n.sign, s.u AS su, s.angle AS sa, CASE WHEN n.angle - s.angle < 0 THEN n.angle - s.angle + 2 * pi() ELSE n.angle - s.angle END AS back,
    CASE WHEN s.angle - n.angle <= 0 THEN s.angle - n.angle + 2 * pi() ELSE s.angle - n.angle END AS ahead,
    CASE WHEN s.sign > 0 THEN s.left_obj WHEN s.u2 < n.u THEN s.right_obj END AS ccw_side, CASE WHEN s.sign > 0 THEN s.left_loc WHEN s.u2 < n.u THEN s.right_loc END AS ccw_side_loc,
    CASE WHEN s.sign < 0 THEN s.left_obj WHEN s.u2 < n.u THEN s.right_obj END AS cw_side, CASE WHEN s.sign < 0 THEN s.left_loc WHEN s.u2 < n.u THEN s.right_loc END AS cw_side_loc
  FROM halves n JOIN halves s ON n.x = s.x AND n.y = s.y AND s.u < n.u),
ranked AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY u, sign) AS older, row_number() OVER (PARTITION BY u, sign ORDER BY su) AS by_age,
    row_number() OVER (PARTITION BY u, sign ORDER BY back, su DESC) AS by_back, row_number() OVER (PARTITION BY u, sign ORDER BY ahead, su) AS by_ahead FROM met),
older AS (SELECT u, sign, max(CASE WHEN by_age = 1 THEN sa END) AS first_angle, max(CASE WHEN by_back = 1 THEN ccw_side END) AS cw_obj, max(CASE WHEN by_back = 1 THEN ccw_side_loc END) AS cw_own,
    max(CASE WHEN by_ahead = 1 THEN cw_side END) AS ccw_obj, max(CASE WHEN by_ahead = 1 THEN cw_side_loc END) AS ccw_own FROM ranked WHERE older >= 2 GROUP BY u, sign),
att AS MATERIALIZED (SELECT h.*, CASE WHEN h.sign > 0 AND px IS NOT NULL THEN atan2(py - y, px - x) ELSE first_angle END AS reference, CASE WHEN (px IS NULL) = (h.sign > 0) THEN 0 ELSE 1 END AS end_no,
    coalesce(cw_obj, 0) AS cw_obj, coalesce(cw_own, 0) AS cw_own, coalesce(ccw_obj, 0) AS ccw_obj, coalesce(ccw_own, 0) AS ccw_own
  FROM halves h JOIN older o ON h.u = o.u AND h.sign = o.sign)"""
_CROSS = f"""{_ATTACHED},
crossings AS (SELECT object_id, ring_no, seg_ord, v_ord, x, y, left_loc AS is_loc, ccw_own AS cw_loc, cw_own AS ccw_loc, end_no
  FROM att WHERE angle <> reference AND CASE WHEN is_exterior THEN cw_obj <> 0 AND cw_obj <> left_obj ELSE (ccw_obj <> 0 AND abs(ccw_obj) <> abs(left_obj)) OR (cw_obj <> 0 AND abs(cw_obj) <> abs(left_obj)) END),
spikes AS (SELECT object_id, ring_no, seg_ord, v_ord, x, y, abs(left_obj) AS obj, to_x AS tx, to_y AS ty, end_no FROM att WHERE angle = reference)"""


def _walks(condition: str) -> str:
    return f"""{_HALVES},
cand AS MATERIALIZED (SELECT u, src_x, src_y, left_loc FROM edges WHERE right_obj IS NULL AND {condition}),
succ AS MATERIALIZED (SELECT t.u, t.next_u FROM turned t JOIN cand a ON a.u = t.u JOIN cand b ON b.u = t.next_u WHERE t.sign = -1 AND t.next_sign = 1),
back(u, p) AS (SELECT u, u FROM cand UNION SELECT b.u, s.u FROM back b JOIN succ s ON s.next_u = b.p),
low AS (SELECT u, min(p) AS low FROM back GROUP BY u),
starts AS (SELECT low AS u, count(*) AS length FROM low GROUP BY low)"""


_HOLES = f"{_walks('left_obj < 0')}, found AS (SELECT object_id, ring_no, seg_ord, v_ord, e.src_x AS x, e.src_y AS y, e.left_loc AS is_loc FROM edges e JOIN starts USING (u))"
_FREE = f"""{_walks('left_obj > 0')},
walks AS (SELECT * FROM starts WHERE length >= 3), longest AS (SELECT u FROM walks ORDER BY length DESC, u LIMIT 1),
found AS (SELECT object_id, ring_no, seg_ord, v_ord, e.src_x AS x, e.src_y AS y, e.left_loc AS is_loc FROM edges e JOIN walks USING (u) WHERE u NOT IN (SELECT u FROM longest))"""
_POINTS = f"""{_EDGES}, {coverages.LINES.strip()},
points AS MATERIALIZED (SELECT DISTINCT src_x AS x, src_y AS y FROM edges UNION SELECT tgt_x, tgt_y FROM edges),
strides AS (SELECT *, lag(x) OVER l AS px, lag(y) OVER l AS py FROM lines WINDOW l AS (PARTITION BY line_id ORDER BY v_ord)),
moved AS MATERIALIZED (SELECT * FROM strides WHERE px IS NULL OR x <> px OR y <> py),
detached AS (SELECT line_id, v_ord, x, y FROM moved m WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.x = m.x AND p.y = m.y)),
invalid AS (SELECT m.line_id, m.v_ord, m.x, m.y, m.px AS x2, m.py AS y2 FROM moved m JOIN points a ON a.x = m.x AND a.y = m.y JOIN points b ON b.x = m.px AND b.y = m.py
  LEFT JOIN edges e ON e.ax = CASE WHEN m.px < m.x OR (m.px = m.x AND m.py < m.y) THEN m.px ELSE m.x END AND e.ay = CASE WHEN m.px < m.x OR (m.px = m.x AND m.py < m.y) THEN m.py ELSE m.y END
    AND e.bx = CASE WHEN m.px < m.x OR (m.px = m.x AND m.py < m.y) THEN m.x ELSE m.px END AND e.by_ = CASE WHEN m.px < m.x OR (m.px = m.x AND m.py < m.y) THEN m.y ELSE m.py END WHERE e.u IS NULL)"""


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- what the queries share ------------------------------------------------------------------


def _uses(spark, d):
    return rings.edge_uses(coverages.vertices(spark, d))


def _owned(spark, d):
    return edges.owned_uses(_uses(spark, d))


def _edges(spark, d):
    return edges.edges(_owned(spark, d))


def _halves(spark, d):
    return rotation.half_edges(_edges(spark, d))


def _flat(df: DataFrame, key: str = "use_key") -> DataFrame:
    return df.select(*[F.col(f"{key}.{k}").alias(k) for k in rings.USE_KEY], *[c for c in df.columns if c != key])


def _sign(c: str):
    return F.round(F.degrees(c), 6)


def all_errors(spark, d, vertices: DataFrame | None = None) -> DataFrame:
    parts = validation.detect(coverages.vertices(spark, d) if vertices is None else vertices, coverages.lines(spark, d))
    numbered = errors.number_errors(parts)
    discard(*parts)  # the numbering has written them
    return numbered


_KEYED = "object_id AS k1, ring_no AS k2, seg_ord AS k3, v_ord AS k4"
_ALL = f"""WITH RECURSIVE {_CROSS},
overlapped AS (SELECT m.object_id, m.ring_no, m.seg_ord, m.v_ord, m.x2 AS x, m.y2 AS y, CASE WHEN same THEN m.creator ELSE o.object_id END AS is_loc, m.object_id AS o_loc
  FROM marked m LEFT JOIN rights r ON r.u1 = m.u1 LEFT JOIN uses o ON o.u = r.u2 WHERE same OR (compat AND m.u > r.u2)),
cand AS MATERIALIZED (SELECT u, left_obj < 0 AS inner_ FROM edges WHERE right_obj IS NULL),
succ AS MATERIALIZED (SELECT t.u, t.next_u FROM turned t JOIN cand a ON a.u = t.u JOIN cand b ON b.u = t.next_u AND a.inner_ = b.inner_ WHERE t.sign = -1 AND t.next_sign = 1),
back(u, p) AS (SELECT u, u FROM cand UNION SELECT b.u, s.u FROM back b JOIN succ s ON s.next_u = b.p),
starts AS (SELECT low AS u, count(*) AS length FROM (SELECT u, min(p) AS low FROM back GROUP BY u) GROUP BY low),
walks AS MATERIALIZED (SELECT s.*, inner_ FROM starts s JOIN cand USING (u)),
longest AS (SELECT u FROM walks WHERE NOT inner_ AND length >= 3 ORDER BY length DESC, u LIMIT 1),
{coverages.LINES.strip()},
{_POINTS.split(coverages.LINES.strip())[1].strip().lstrip(',').strip()},
e AS (
  SELECT 1 AS phase, {_KEYED}, 2 AS k5, 'RING_OVERLAPPING_EDGES' AS t, x, y, is_loc, o_loc, NULL::BIGINT AS cw_loc, NULL::BIGINT AS ccw_loc, NULL::DOUBLE AS x2, NULL::DOUBLE AS y2, NULL::BIGINT AS obj, NULL::DOUBLE AS tx, NULL::DOUBLE AS ty FROM overlapped
  UNION ALL SELECT 1, object_id, ring_no, seg_ord, v_ord, end_no, 'RING_INTERSECTION', x, y, is_loc, NULL, cw_loc, ccw_loc, NULL, NULL, NULL, NULL, NULL FROM crossings
  UNION ALL SELECT 1, object_id, ring_no, seg_ord, v_ord, end_no, 'INVALID_ANGLE', x, y, NULL, NULL, NULL, NULL, NULL, NULL, obj, tx, ty FROM spikes
  UNION ALL SELECT CASE WHEN inner_ THEN 2 ELSE 3 END, object_id, ring_no, seg_ord, v_ord, 2, CASE WHEN inner_ THEN 'HOLE_EMPTY_INTERIOR' ELSE 'FREE_STANDING_SURFACE' END, ed.src_x, ed.src_y, ed.left_loc, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM edges ed JOIN walks w USING (u) WHERE inner_ OR (length >= 3 AND u NOT IN (SELECT u FROM longest))
  UNION ALL SELECT 4, line_id, 0, v_ord, 0, 2, 'BOUNDARY_POINT_DETACHED', x, y, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM detached
  UNION ALL SELECT 4, line_id, 0, v_ord, 0, 2, 'BOUNDARY_EDGE_INVALID', x, y, NULL, NULL, NULL, NULL, x2, y2, NULL, NULL, NULL FROM invalid),
numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY phase, k1, k2, k3, k4, k5, t, x, y) AS i, * EXCLUDE (phase, k1, k2, k3, k4, k5) FROM e),
rel AS MATERIALIZED (SELECT *, CASE WHEN min(i) OVER (PARTITION BY x, y) < i THEN min(i) OVER (PARTITION BY x, y) END AS p FROM numbered)"""
_TAGGED = " || ".join(f"coalesce('<{tag}>' || {c} || '</{tag}>', '')" for c, tag in sinks.TAGS.items())
_AT = "' at (' || x || ', ' || y || ')'"
_MESSAGE = f"""CASE t WHEN 'RING_OVERLAPPING_EDGES' THEN 'Edge of geometry ' || o_loc || ' overlaps geometry ' || is_loc || {_AT}
  WHEN 'HOLE_EMPTY_INTERIOR' THEN 'Interior of geometry ' || is_loc || ' is not filled' || {_AT} WHEN 'FREE_STANDING_SURFACE' THEN 'Geometry ' || is_loc || ' does not touch the coverage' || {_AT}
  WHEN 'BOUNDARY_POINT_DETACHED' THEN 'Boundary point is on no node' || {_AT} WHEN 'BOUNDARY_EDGE_INVALID' THEN 'Boundary has no edge between (' || x2 || ', ' || y2 || ') and its point' || {_AT}
  WHEN 'INVALID_ANGLE' THEN 'Edge of object ' || obj || ' could not be attached' || {_AT}
  ELSE 'Geometry ' || is_loc || ' intersects, clockwise ' || cw_loc || ', counter-clockwise ' || ccw_loc || {_AT} END"""
# Whole features in a text of their own: rings of points, objects of rings, features of objects.
_SHAPES = f"""points_of AS (SELECT object_id, ring_no, '[' || string_agg('[' || x || ',' || y || ']', ',' ORDER BY seg_ord, v_ord) || ']' AS r FROM vertices GROUP BY object_id, ring_no),
shapes AS (SELECT object_id, '[' || string_agg(r, ',' ORDER BY ring_no) || ']' AS g FROM points_of GROUP BY object_id),
named AS (SELECT DISTINCT (object_id - 1) // 8 AS k FROM (SELECT unnest([is_loc, o_loc, cw_loc, ccw_loc]) AS object_id FROM rel WHERE p IS NULL) n WHERE object_id <> 0),
areas AS (SELECT k, count(*) AS n, string_agg(g, ',' ORDER BY object_id) AS g FROM shapes JOIN named ON (object_id - 1) // 8 = k GROUP BY k)"""

# ---- queries ---------------------------------------------------------------------------------


@_query("tokenize_poslist", f"""WITH {coverages.RINGS},
c AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1)) AS c(v_pos, cx, cy))
SELECT object_id, ring_no, v_pos AS v_pos, x0 + sx * CASE WHEN cx = 1 THEN b ELSE a END AS x, y0 + CASE WHEN cy = 1 THEN b ELSE a END AS y FROM rings CROSS JOIN c""")
def tokenize_poslist(spark, d):
    t = tokenize_pos_lists(coverages.pos_lists(spark, d))
    return t.select("object_id", "ring_no", F.col("v_ord").alias("v_pos"), "x", "y")


@_query("ring_chain", f"WITH {_USES} SELECT object_id, ring_no, seg_ord, v_ord, is_exterior, x1, y1, x2, y2, fwd AS forward FROM uses")
def ring_chain(spark, d):
    return _flat(_uses(spark, d).select("use_key", "is_exterior", "x1", "y1", "x2", "y2", "forward"))


@_query("edge_dedup", f"WITH {_USES} SELECT ax, ay, bx, by_ AS by, count(*)::BIGINT AS uses FROM uses GROUP BY ALL")
def edge_dedup(spark, d):
    # The map side combines uses of an edge before the shuffle.
    return _uses(spark, d).groupBy("edge_key").agg(F.count("*").alias("uses")).select("edge_key.*", "uses")


@_query("node_dedup", f"WITH {_USES} SELECT x1 AS x, y1 AS y FROM uses UNION SELECT x2, y2 FROM uses")
def node_dedup(spark, d):
    return edges.nodes(_edges(spark, d)).select("x", "y")


@_query("node_degree", f"WITH {_EDGES} SELECT x, y, count(*)::BIGINT AS degree FROM (SELECT src_x AS x, src_y AS y FROM edges UNION ALL SELECT tgt_x, tgt_y FROM edges) GROUP BY x, y")
def node_degree(spark, d):
    return edges.nodes(_edges(spark, d))


@_query("edge_owners", f"WITH {_EDGES} SELECT src_x, src_y, tgt_x, tgt_y, left_obj, right_obj, uses::BIGINT AS uses FROM edges")
def edge_owners(spark, d):
    return _edges(spark, d).select("src_x", "src_y", "tgt_x", "tgt_y", "left_obj", "right_obj", "uses")


@_query("overlapping_edges", f"WITH {_OVERLAPS} SELECT * FROM overlapped")
def overlapping_edges(spark, d):
    return _flat(edges.overlapping_edges(_owned(spark, d)))


@_query("overlap_pairs", f"WITH {_OVERLAPS} SELECT is_loc, o_loc, count(*)::BIGINT AS edges FROM overlapped GROUP BY ALL")
def overlap_pairs(spark, d):
    return edges.overlap_pairs(edges.overlapping_edges(_owned(spark, d)))


@_query("half_edge_angles", f"WITH {_HALVES} SELECT x, y, to_x, to_y, sign, round(degrees(angle), 6) AS degrees FROM halves")
def half_edge_angles(spark, d):
    return _halves(spark, d).select("x", "y", "to_x", "to_y", "sign", _sign("angle").alias("degrees"))


@_query("ccw_next", f"WITH {_HALVES} SELECT t.x, t.y, t.to_x, t.to_y, t.sign, e.ax AS next_ax, e.ay AS next_ay, e.bx AS next_bx, e.by_ AS next_by, next_sign FROM turned t JOIN edges e ON e.u = t.next_u")
def ccw_next(spark, d):
    n = rotation.ccw_next(_halves(spark, d))
    return n.select("x", "y", "to_x", "to_y", "sign", *[F.col(f"next_edge.{k}").alias(f"next_{k}") for k in ("ax", "ay", "bx", "by")], "next_sign")


@_query("ring_intersection", f"WITH {_CROSS} SELECT * FROM crossings")
def ring_intersection(spark, d):
    return _flat(rotation.ring_intersections(rotation.attachments(_halves(spark, d))))


@_query("invalid_angle", f"WITH {_CROSS} SELECT * FROM spikes")
def invalid_angle(spark, d):
    return _flat(rotation.invalid_angles(rotation.attachments(_halves(spark, d))))


@_query("interior_ring_edges", f"WITH {_EDGES} SELECT src_x, src_y, tgt_x, tgt_y, left_obj, right_obj FROM edges WHERE left_obj < 0")
def interior_ring_edges(spark, d):
    return _edges(spark, d).where("left_obj < 0").select("src_x", "src_y", "tgt_x", "tgt_y", "left_obj", "right_obj")


@_query("empty_right_edges", f"WITH {_EDGES} SELECT src_x, src_y, tgt_x, tgt_y, left_obj FROM edges WHERE right_obj IS NULL")
def empty_right_edges(spark, d):
    return _edges(spark, d).where("right_obj IS NULL").select("src_x", "src_y", "tgt_x", "tgt_y", "left_obj")


@_query("holes", f"WITH RECURSIVE {_HOLES} SELECT * FROM found")
def holes(spark, d):
    return _flat(faces.holes(keep(_edges(spark, d))))


@_query("free_standing_surfaces", f"WITH RECURSIVE {_FREE} SELECT * FROM found")
def free_standing_surfaces(spark, d):
    return _flat(faces.free_standing(keep(_edges(spark, d))))


@_query("boundary_points_detached", f"WITH {_POINTS} SELECT * FROM detached")
def boundary_points_detached(spark, d):
    return boundaries.points_detached(coverages.lines(spark, d), _edges(spark, d)).drop("part")


@_query("boundary_edges_invalid", f"WITH {_POINTS} SELECT * FROM invalid")
def boundary_edges_invalid(spark, d):
    return boundaries.edges_invalid(coverages.lines(spark, d), keep(_edges(spark, d))).drop("part")


@_query("boundary_overlaps", f"""WITH {coverages.LINES.strip()},
steps AS (SELECT *, lag(x) OVER l AS px, lag(y) OVER l AS py FROM lines WINDOW l AS (PARTITION BY line_id ORDER BY v_ord)),
k AS (SELECT line_id, least(struct_pack(x := x, y := y), struct_pack(x := px, y := py)) AS a, greatest(struct_pack(x := x, y := y), struct_pack(x := px, y := py)) AS b FROM steps WHERE px IS NOT NULL AND (x <> px OR y <> py))
SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, count(DISTINCT line_id)::BIGINT AS lines, min(line_id) AS first_line FROM k GROUP BY a, b HAVING count(DISTINCT line_id) > 1""")
def boundary_overlaps(spark, d):
    return boundaries.boundary_overlaps(coverages.lines(spark, d)).select("edge_key.*", "lines", "first_line")


@_query("node_lookup", f"WITH {_POINTS}, deg AS (SELECT x, y, count(*) AS degree FROM (SELECT src_x AS x, src_y AS y FROM edges UNION ALL SELECT tgt_x, tgt_y FROM edges) GROUP BY x, y) SELECT line_id, v_ord, l.x, l.y, degree::BIGINT AS degree FROM lines l LEFT JOIN deg ON deg.x = l.x AND deg.y = l.y")
def node_lookup(spark, d):
    return lookup.find_nodes(_edges(spark, d), coverages.lines(spark, d))


@_query("edge_lookup", f"WITH {_POINTS} SELECT line_id, m.v_ord, m.px AS x1, m.py AS y1, m.x AS x2, m.y AS y2, left_obj, right_obj, coalesce(e.u IS NOT NULL, false) AS found FROM moved m LEFT JOIN edges e ON e.ax = CASE WHEN m.px < m.x OR (m.px = m.x AND m.py < m.y) THEN m.px ELSE m.x END AND e.ay = CASE WHEN m.px < m.x OR (m.px = m.x AND m.py < m.y) THEN m.py ELSE m.y END AND e.bx = CASE WHEN m.px < m.x OR (m.px = m.x AND m.py < m.y) THEN m.x ELSE m.px END AND e.by_ = CASE WHEN m.px < m.x OR (m.px = m.x AND m.py < m.y) THEN m.y ELSE m.py END WHERE m.px IS NOT NULL")
def edge_lookup(spark, d):
    v = boundaries.line_vertices(coverages.lines(spark, d)).where("px IS NOT NULL")
    pairs = v.select("line_id", "v_ord", F.col("px").alias("x1"), F.col("py").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return lookup.find_edges(_edges(spark, d), pairs).withColumn("found", F.coalesce("found", F.lit(False)))


@_query("edges_at_point", f"WITH {_HALVES} SELECT x, y, to_x, to_y, sign, left_obj, right_obj FROM halves WHERE x = 1010.125 AND y = 2010.125")
def edges_at_point(spark, d):
    return lookup.edges_at(_edges(spark, d), 1010.125, 2010.125).select("x", "y", "to_x", "to_y", "sign", "left_obj", "right_obj")


@_query("bbox", f"WITH {coverages.VERTICES} SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM vertices")
def bbox(spark, d):
    return edges.bounding_box(coverages.vertices(spark, d))


@_query("error_relation", f"{_ALL} SELECT i, t, p, x, y, is_loc, o_loc, cw_loc, ccw_loc, x2, y2, obj, tx, ty FROM rel")
def error_relation(spark, d):
    return all_errors(spark, d)


@_query("error_stats", f"{_ALL} SELECT t, count(*)::BIGINT AS errors, count(p)::BIGINT AS repeats FROM rel GROUP BY t")
def error_stats(spark, d):
    return errors.error_statistics(all_errors(spark, d))


@_query("error_repeats", f"{_ALL} SELECT i, t, p FROM rel WHERE p IS NOT NULL")
def error_repeats(spark, d):
    return all_errors(spark, d).where("p IS NOT NULL").select("i", "t", "p")


@_query("errors_filtered", f"{_ALL} SELECT i, t, x, y FROM rel WHERE p IS NULL AND t IN ('RING_INTERSECTION', 'HOLE_EMPTY_INTERIOR')")
def errors_filtered(spark, d):
    return errors.filter_errors(all_errors(spark, d), ["RING_INTERSECTION", "HOLE_EMPTY_INTERIOR"]).select("i", "t", "x", "y")


@_query("location_pack", "SELECT l_orderkey, l_linenumber, l_partkey, ((l_suppkey % 100) * 72057594037927936 + (l_linenumber * 7) * 4294967296 + (l_orderkey + 1000))::BIGINT AS location FROM lineitem")
def location_pack(spark, d):
    coverages.register(spark, d, "lineitem")
    t = spark.table("lineitem")
    pos = F.col("l_orderkey") + 1000
    return t.select("l_orderkey", "l_linenumber", "l_partkey", loc.pack_location(F.col("l_suppkey") % 100, pos, pos - F.col("l_linenumber") * 7).alias("location"))


@_query("location_unpack", "SELECT l_orderkey, l_linenumber, l_partkey, (l_suppkey % 100)::INTEGER AS db, 'COVERAGE-' || lpad((l_suppkey % 100)::VARCHAR, 3, '0') AS db_name, l_orderkey + 1000 AS geometry_pos, l_orderkey + 1000 - l_linenumber * 7 AS feature_pos FROM lineitem")
def location_unpack(spark, d):
    p = location_pack(spark, d)
    return p.select("l_orderkey", "l_linenumber", "l_partkey", loc.location_db("location").alias("db"), loc.location_db_name("location", "COVERAGE-").alias("db_name"), loc.location_geometry("location").alias("geometry_pos"), loc.location_feature("location").alias("feature_pos"))


@_query("location_sql", "SELECT l_orderkey, l_linenumber, l_partkey, (l_suppkey % 100)::INTEGER AS db, l_orderkey + 1000 - l_linenumber * 7 AS feature_pos FROM lineitem")
def location_sql(spark, d):
    register_functions(spark)
    coverages.register(spark, d, "lineitem")
    packed = "topo_pack_location(CAST(l_suppkey % 100 AS INT), l_orderkey + 1000, l_orderkey + 1000 - l_linenumber * 7)"
    return spark.sql(f"SELECT l_orderkey, l_linenumber, l_partkey, topo_location_db(v) AS db, topo_location_feature(v) AS feature_pos FROM (SELECT *, {packed} AS v FROM lineitem)")


@_query("named_features", f"{_ALL}, named AS (SELECT unnest([is_loc, o_loc]) AS location FROM overlapped UNION SELECT unnest([is_loc, cw_loc, ccw_loc]) FROM crossings) SELECT DISTINCT location FROM named WHERE location IS NOT NULL AND location <> 0")
def named_features(spark, d):
    """The objects that overlaps and intersections name in any role."""
    owned = keep(_owned(spark, d))
    crossed = rotation.ring_intersections(rotation.attachments(rotation.half_edges(edges.edges(owned))))
    found = [errors.as_errors(edges.overlapping_edges(owned), "RING_OVERLAPPING_EDGES", "surface"), errors.as_errors(crossed, "RING_INTERSECTION", "surface")]
    return sinks.named_locations(found[0].unionByName(found[1]))


@_query("diag", f"WITH {_EDGES} SELECT (SELECT count(DISTINCT object_id) FROM uses)::BIGINT AS objects, (SELECT count(*) FROM uses)::BIGINT AS edge_uses, (SELECT count(*) FROM edges)::BIGINT AS edges, (SELECT count(right_obj) FROM edges)::BIGINT AS edges_with_right, (SELECT count(*) FROM (SELECT src_x, src_y FROM edges UNION SELECT tgt_x, tgt_y FROM edges))::BIGINT AS nodes, 0::BIGINT AS collisions, 0::BIGINT AS lookup_errors")
def diag(spark, d):
    uses = keep(_uses(spark, d))
    return lookup.diagnostics(uses, keep(edges.edges(edges.owned_uses(uses))))


_EDGE_NO = f"""WITH {_HALVES}, no AS (SELECT u, row_number() OVER (ORDER BY u) AS edge FROM edges),
nexts AS (SELECT t.u, max(CASE WHEN t.sign = 1 THEN n.edge * t.next_sign END) AS source_next, max(CASE WHEN t.sign = -1 THEN n.edge * t.next_sign END) AS target_next FROM turned t JOIN no n ON n.u = t.next_u GROUP BY t.u)
SELECT edge, src_x || ' ' || src_y AS source, tgt_x || ' ' || tgt_y AS target, round(degrees(atan2(tgt_y - src_y, tgt_x - src_x)), 6) AS source_degrees, round(degrees(atan2(src_y - tgt_y, src_x - tgt_x)), 6) AS target_degrees,
  source_next, target_next, left_obj, coalesce(right_obj, 0) AS right_obj, left_loc, coalesce(right_loc, 0) AS right_loc FROM edges JOIN no USING (u) JOIN nexts USING (u)"""


@_query("edge_csv", _EDGE_NO)
def edge_csv(spark, d):
    dump = sinks.edge_dump(keep(_edges(spark, d)))
    return dump.withColumns({c: F.round(c, 6) for c in ("source_degrees", "target_degrees")})


@_query("feature_lookup", f"""WITH {_OVERLAPS}, {coverages.FEATURES.split(coverages.RINGS)[1].strip().lstrip(',')}
SELECT o.object_id, ring_no, seg_ord, v_ord, feature_id, feature_type, (is_loc - 1) % 8 AS patch_ord
FROM overlapped o LEFT JOIN features f ON (is_loc - 1) // 8 = f.first_geometry // 8 + CASE WHEN db_idx = 1 THEN 1000000000 ELSE 0 END""")
def feature_lookup(spark, d):
    """The feature that an overlap's first geometry belongs to, by its packed location."""
    owned = edges.owned_uses(rings.edge_uses(coverages.located(coverages.vertices(spark, d))))
    found = lookup.features_at(edges.overlapping_edges(owned), coverages.features(spark, d), "is_loc")
    return _flat(found).select(*rings.USE_KEY, "feature_id", "feature_type", "patch_ord")


@_query("geometry_lookup", f"""WITH {_OVERLAPS}, {coverages.POS_LISTS.split(coverages.RINGS)[1].strip().lstrip(',')}
SELECT o.object_id, o.ring_no, o.seg_ord, o.v_ord, p.ring_no AS at_ring, p.seg_ord AS at_seg, p.geo_type, (o_loc - 1) % 8 AS patch_ord, pos_list FROM overlapped o LEFT JOIN pos_lists p ON p.object_id = o_loc""")
def geometry_lookup(spark, d):
    """The coordinate lists of the geometry that overlaps another, by its packed location."""
    owned = edges.owned_uses(rings.edge_uses(coverages.located(coverages.vertices(spark, d))))
    lists = coverages.located(coverages.pos_lists(spark, d)).withColumns({"feature_id": F.lit(None).cast("string"), "patch_ord": loc.location_delta("location")})
    found = lookup.geometries_at(edges.overlapping_edges(owned), lists, "o_loc")
    return found.select(*[F.col(f"use_key.{k}").alias(k) for k in rings.USE_KEY], F.col("ring_no").alias("at_ring"), F.col("seg_ord").alias("at_seg"), "geo_type", loc.location_delta("o_loc").alias("patch_ord"), "pos_list")


@_query("geojson_points", f"""{_ALL} SELECT i AS id, '{{"type":"Feature","properties":{{"id":"' || i || '","e":"' || {_MESSAGE} || '"}},"geometry":{{"type":"Point","coordinates":[' || x || ',' || y || ']}}}}' AS feature FROM rel WHERE p IS NULL""")
def geojson_points(spark, d):
    return sinks.error_points(errors.filter_errors(all_errors(spark, d)))


@_query("erroneous_features", f"""{_ALL}, {_SHAPES} SELECT 'F' || k AS feature_id, '{{"type":"Feature","properties":{{"id":"F' || k || '"}},"geometry":{{"type":"'
  || CASE WHEN n = 1 THEN 'Polygon","coordinates":' || g ELSE 'MultiPolygon","coordinates":[' || g || ']' END || '}}}}' AS feature FROM areas""")
def erroneous_features(spark, d):
    """The whole features that errors name, each once, as GeoJSON."""
    vertices = coverages.located(coverages.vertices(spark, d))
    found = errors.filter_errors(all_errors(spark, d, vertices))
    return sinks.erroneous_features(found, vertices, coverages.features(spark, d), validation.slices_for(vertices))


@_query("error_xml", f"""{_ALL} SELECT i, '<e i="' || i || '" t="' || t || '"' || coalesce(' p="' || p || '"', '') || '>' || {_TAGGED} || '</e>' AS xml FROM rel""")
def error_xml(spark, d):
    return sinks.error_elements(all_errors(spark, d))
