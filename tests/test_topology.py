"""Hand-made coverages: what each detection reports on them."""

from __future__ import annotations

import math
import random
from itertools import count

import pytest
from meshwork.operators import boundaries, edges, errors, faces, lookup, rings, rotation
from meshwork.operators.materialise import keep

SCHEMA = "object_id bigint, ring_no int, seg_ord int, v_ord int, is_exterior boolean, location bigint, x double, y double"
A = [(0, 0), (1, 0), (1, 1), (0, 1)]
B = [(1, 0), (2, 0), (2, 1), (1, 1)]
C = [(10, 0), (11, 0), (11, 1), (10, 1)]
BIG, HOLE = [(0, 0), (3, 0), (3, 3), (0, 3)], [(1, 1), (1, 2), (2, 2), (2, 1)]


def coverage(spark, *objects):
    """objects: lists of rings in parse order; the first ring is the exterior, all are closed here."""
    rows = []
    for o, obj in zip(count(1), objects):
        for r, ring in enumerate(obj):
            rows += [(o, r, 0, v, r == 0, o, float(x), float(y)) for v, (x, y) in enumerate([*ring, ring[0]])]
    return spark.createDataFrame(rows, SCHEMA)


def build(spark, *objects):
    owned = keep(edges.owned_uses(rings.edge_uses(coverage(spark, *objects))))
    return owned, keep(edges.edges(owned))


def crossings(e):
    return [(r.x, r.y, r.is_loc, r.cw_loc, r.ccw_loc) for r in rotation.ring_intersections(rotation.attachments(rotation.half_edges(e))).collect()]


def places(df):
    return sorted((r.x, r.y, r.is_loc) for r in df.collect())


def line(spark, *points):
    return spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "line_id bigint, v_ord int, x double, y double")


def test_two_squares_share_an_edge(spark):
    owned, e = build(spark, [A], [B])
    assert edges.overlapping_edges(owned).count() == 0 and crossings(e) == []
    assert (edges.nodes(e).count(), e.count()) == (6, 7)
    shared = lookup.find_edges(e, spark.createDataFrame([(1.0, 1.0, 1.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")).first()
    assert (shared.left_obj, shared.right_obj) == (1, 2)
    assert places(faces.holes(e)) == [] and places(faces.free_standing(e)) == []


def test_an_object_parsed_twice_overlaps(spark):
    owned, _ = build(spark, [A], [A])
    got = [(r.x, r.y, r.is_loc, r.o_loc) for r in edges.overlapping_edges(owned).orderBy("use_key").collect()]
    assert got == [(1, 0, 1, 2), (1, 1, 1, 2), (0, 1, 1, 2), (0, 0, 1, 2)]


def test_a_distant_square_stands_free(spark):
    assert places(faces.free_standing(build(spark, [A], [C])[1])) == [(10, 0, 2)]


def test_holes(spark):
    _, e = build(spark, [BIG, HOLE])
    assert places(faces.holes(e)) == [(1, 1, 1)]
    owned, e = build(spark, [BIG, HOLE], [[(1, 1), (2, 1), (2, 2), (1, 2)]])
    assert places(faces.holes(e)) == [] and crossings(e) == [] and edges.overlapping_edges(owned).count() == 0
    assert {(r.left_obj, r.right_obj) for r in e.where("left_obj < 0").collect()} == {(-1, 2)}


def test_a_hole_filled_with_another_vertex(spark):
    _, e = build(spark, [BIG, HOLE], [[(1, 1), (1.5, 1), (2, 1), (2, 2), (1, 2)]])
    assert crossings(e) == [(2, 1, 2, 1, 1)]
    assert places(faces.holes(e)) == [(2, 1, 1)] and places(faces.free_standing(e)) == []


def test_intersections_depend_on_the_order(spark):
    tilted = [(0, 0), (2, 1), (1, 2)]
    assert crossings(build(spark, [A], [tilted])[1]) == [(0, 0, 2, 1, 1)]
    assert crossings(build(spark, [tilted], [A])[1]) == []


def spikes(e):
    return [(r.x, r.y, r.obj, r.tx, r.ty, r.end_no) for r in rotation.invalid_angles(rotation.attachments(rotation.half_edges(e))).collect()]


def test_a_ring_that_doubles_back_has_an_invalid_angle(spark):
    _, e = build(spark, [A], [[(5, 1), (1, 1), (3, 1), (3, 5)]])
    assert spikes(e) == [(1, 1, 2, 3, 1, 1)]


def test_an_edge_along_the_first_one_of_its_node_is_checked(spark):
    _, e = build(spark, [A], [[(-5, -5), (0, 0), (3, 0), (3, -5)]])
    assert spikes(e) == [] and [c[:3] for c in crossings(e)] == [(0, 0, 2)]


@pytest.mark.parametrize(
    ("points", "detached", "invalid"),
    [
        ([(0, 0), (1, 0), (2, 0)], [], []),
        ([(0, 0), (1, 1)], [], [(1, 1, 0, 0)]),
        ([(0, 0), (0.5, 0), (1, 0), (2, 0)], [(0.5, 0)], []),
        ([(0, 0), (0, 0), (1, 0)], [], []),
    ],
)
def test_boundaries(spark, points, detached, invalid):
    _, e = build(spark, [A], [B])
    at = line(spark, *points)
    assert [(r.x, r.y) for r in boundaries.points_detached(at, e).collect()] == detached
    assert [(r.x, r.y, r.x2, r.y2) for r in boundaries.edges_invalid(at, e).collect()] == invalid


def test_stars_are_swept_like_joined(spark):
    r = random.Random(4)
    spokes = [[(0, 0), (r.randrange(-50, 50), r.randrange(1, 50)), (r.randrange(-50, 50), r.randrange(-50, -1))] for _ in range(30)]
    _, e = build(spark, *[[s] for s in spokes], [[*A], [(0.2, 0.2), (0.2, 0.5), (0.5, 0.2)]])
    h = keep(rotation.half_edges(e))
    a, b = (sorted(map(str, rotation.attachments(h, star_degree=d).select("x", "y", "n_edge", "n_sign", "older", "cw", "ccw", "first_angle").collect())) for d in (1000, 3))
    assert a == b and a


def model(objects):
    """The rules as one sequential walk over all uses: owners, overlaps, and what is reported when an edge is attached."""
    edges_, found, crossed, spiked, at = {}, [], [], [], {}

    def attach(edge, node, to, reference, end_no):
        here, new = at.setdefault(node, []), math.atan2(to[1] - node[1], to[0] - node[0])
        if len(here) >= 2:
            if new == (here[0][0] if reference is None else reference):
                spiked.append((*node, edge["object"], *to, end_no))
            else:
                turn = lambda d: d + 2 * math.pi if d < 0 else d
                cw = min(here, key=lambda h: (turn(new - h[0]), -h[2]["no"]))
                ccw = min(here, key=lambda h: (turn(h[0] - new) or 2 * math.pi, h[2]["no"]))
                side = lambda h, ccw_side: h[2]["left" if (h[1] > 0) == ccw_side else "right"] or 0
                a, b, own = side(cw, True), side(ccw, False), edge["left"]
                if own > 0 and a not in (0, own) or own < 0 and any(o and abs(o) != -own for o in (a, b)):
                    crossed.append((*node, abs(own), abs(b), abs(a), end_no))
        here.append((new, 1 if node == edge["src"] else -1, edge))

    for o, obj in zip(count(1), objects):
        for k, ring in enumerate(obj):
            previous = None
            for p, q in zip(ring, [*ring[1:], ring[0]]):
                if p == q:
                    continue
                key, use = (min(p, q), max(p, q)), (k == 0, p < q)
                if key not in edges_:
                    edge = edges_[key] = {"use": use, "object": o, "left": o if k == 0 else -o, "right": None, "src": p, "tgt": q, "no": len(edges_)}
                    back = previous and math.atan2(previous[1] - p[1], previous[0] - p[0])
                    ends = [(q, p, None), (p, q, back)] if previous else [(p, q, None), (q, p, None)]
                    for n, (node, to, reference) in enumerate(ends):
                        attach(edge, node, to, reference, n)
                elif edges_[key]["use"] == use:
                    found.append((*q, abs(edges_[key]["left"]), o))
                elif edges_[key]["right"]:
                    found.append((*q, abs(edges_[key]["right"]), o))
                else:
                    edges_[key]["right"] = o if k == 0 else -o
                previous = p
    return edges_, sorted(found), sorted(crossed), sorted(spiked), at


def walked(edges_, at, inner):
    """Walks over marked edges in order of creation: (first edge, edges marked)."""
    order = {n: sorted(h, key=lambda x: (x[0], x[2]["no"])) for n, h in at.items()}
    marked, out = set(), []

    def following(e):
        here = order[e["tgt"]]
        k = next(i for i, h in enumerate(here) if h[2] is e and h[1] < 0)
        _, sign, nxt = here[(k + 1) % len(here)]
        return nxt if sign > 0 else None

    free = lambda e: e is not None and e["right"] is None and (e["left"] < 0) == inner and e["no"] not in marked
    for e in edges_.values():
        if free(e):
            n, x = 0, e
            while free(x):
                marked.add(x["no"])
                n, x = n + 1, following(x)
            out.append((e, n))
    return out


def random_objects(r, n):
    for _ in range(n):
        x, y, s = r.randrange(6), r.randrange(6), r.choice([1, 1, 2])
        ring = r.choice([[(x, y), (x + s, y), (x + s, y + s), (x, y + s)], [(x, y), (x + 2, y + 1), (x + 1, y + 2)], [(x, y), (x + s, y), (x + 2 * s, y), (x, y + s)], [(x, y), (x + 2, y), (x + 1, y), (x + 1, y + 1)]])
        k = r.randrange(len(ring))
        obj = [(ring[k:] + ring[:k])[:: r.choice([1, -1])]]
        if r.random() < 0.3:
            obj.append([(x, y), (x, y + 1), (x + 1, y + 1), (x + 1, y)][:: r.choice([1, -1])])
        yield obj


def test_random_coverages_equal_the_sequential_model(spark):
    r = random.Random(9)
    seen = [0] * 5
    for size in (8, 20, 60, 60):
        objects = list(random_objects(r, size))
        want, found, crossed, spiked, at = model(objects)
        owned = keep(edges.owned_uses(rings.edge_uses(coverage(spark, *objects).repartition(7))))
        e = keep(edges.edges(owned))
        assert sorted((x.x, x.y, x.is_loc, x.o_loc) for x in edges.overlapping_edges(owned).collect()) == found
        assert {((x.edge_key.ax, x.edge_key.ay), (x.edge_key.bx, x.edge_key.by)): (x.left_obj, x.right_obj) for x in e.collect()} == {k: (v["left"], v["right"]) for k, v in want.items()}
        att = keep(rotation.attachments(rotation.half_edges(e), star_degree=12))
        assert sorted((x.x, x.y, x.is_loc, x.cw_loc, x.ccw_loc, x.end_no) for x in rotation.ring_intersections(att).collect()) == crossed
        assert sorted((x.x, x.y, x.obj, x.tx, x.ty, x.end_no) for x in rotation.invalid_angles(att).collect()) == spiked
        place = lambda w: (*w[0]["src"], w[0]["object"])
        inner, outer = walked(want, at, True), [w for w in walked(want, at, False) if w[1] >= 3]
        both = keep(faces.walks(e))
        assert places(faces.holes(e)) == places(faces.holes(e, both)) == sorted(map(place, inner))
        outer.remove(max(outer, key=lambda w: (w[1], -w[0]["no"])))
        assert places(faces.free_standing(e)) == places(faces.free_standing(e, both)) == sorted(map(place, outer))
        seen = [a + len(b) for a, b in zip(seen, (found, crossed, spiked, inner, outer))]
    assert all(seen)


def test_the_end_that_reports_first(spark):
    """A ring that starts at a known node reports its first edge's source end first, a later edge its target end."""
    star = [[(0, 0), (2, 0), (2, 2), (0, 2)], [(4, 0), (6, 0), (6, 2), (4, 2)]]
    found = model([[s] for s in star] + [[[(1, 1), (0, 0), (4, 0), (1, 5)]], [[(0, 0), (6, 2), (9, 9)]]])[2]
    _, e = build(spark, *[[s] for s in star], [[(1, 1), (0, 0), (4, 0), (1, 5)]], [[(0, 0), (6, 2), (9, 9)]])
    got = [(x.x, x.y, x.is_loc, x.cw_loc, x.ccw_loc, x.end_no) for x in rotation.ring_intersections(rotation.attachments(rotation.half_edges(e))).collect()]
    assert sorted(got) == found and len(found) >= 4


def test_edges_at_a_point_go_counter_clockwise_with_their_owners(spark):
    """Four squares around (1, 1): owners as seen from the node, in order of angle."""
    _, e = build(spark, [A], [B], [[(0, 1), (1, 1), (1, 2), (0, 2)]], [[(1, 1), (2, 1), (2, 2), (1, 2)]])
    got = lookup.edges_at(e, 1.0, 1.0).collect()
    assert [(r.to_x, r.to_y) for r in got] == [(1, 0), (2, 1), (1, 2), (0, 1)]
    assert [(r.sign, r.left_obj, r.right_obj) for r in got] == [(-1, 1, 2), (-1, 2, 4), (1, 3, 4), (1, 1, 3)]
    assert got[0].details == "to (1.0, 0.0) -90.0° left 1 right 2"
    assert lookup.edges_at(e, 7.0, 7.0).count() == 0
    turned = {(r.to_x, r.to_y): (r.next_edge.ax, r.next_edge.ay, r.next_edge.bx, r.next_edge.by, r.next_sign) for r in got}
    assert turned == {(1, 0): (1, 1, 2, 1, -1), (2, 1): (1, 1, 1, 2, 1), (1, 2): (0, 1, 1, 1, 1), (0, 1): (1, 0, 1, 1, -1)}
    [none] = lookup.find_nodes(e, spark.createDataFrame([(7.0, 7.0)], "x double, y double")).collect()
    assert none.degree is None


def test_numbering_and_filters(spark):
    owned, e = build(spark, [A], [A], [A])
    every = keep(errors.number_errors([errors.as_errors(edges.overlapping_edges(owned), "RING_OVERLAPPING_EDGES", "surface"), errors.as_errors(faces.holes(e), "HOLE_EMPTY_INTERIOR", "holes")]))
    rows = every.orderBy("i").collect()
    assert [r.i for r in rows] == list(range(1, 9)) and [r.p for r in rows] == [None] * 4 + [1, 2, 3, 4]
    assert errors.filter_errors(every).count() == 4
    assert errors.filter_errors(every, ["HOLE_EMPTY_INTERIOR"]).count() == 0
    with pytest.raises(ValueError, match="INVALID_ERROR_CODE"):
        errors.filter_errors(every, ["NO_SUCH_CODE"])


def test_long_paths_double(spark):
    """A path of 300 candidates and a cycle of 7, with starts by prefix minima."""
    r = random.Random(2)
    ids = r.sample(range(1000), 307)
    path, cycle = ids[:300], ids[300:]
    rows = [(a, b) for a, b in zip(path, [*path[1:], None])] + [(a, b) for a, b in zip(cycle, [*cycle[1:], cycle[0]])]
    want, low = {}, None
    for p in path:
        low = p if low is None else min(low, p)
        want[low] = want.get(low, 0) + 1
    want[min(cycle)] = 7
    df = spark.createDataFrame(rows, "id bigint, next bigint")
    assert {x.start: x.length for x in faces.walk_starts(df).collect()} == want
