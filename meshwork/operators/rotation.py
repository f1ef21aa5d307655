"""Half-edges in angular order around their nodes, and the checks made when an edge is attached."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import angle, apart, edge_key, together, turn
from ..workers import python_workers
from .edges import signed_object
from .materialise import in_slice, keep
from .rings import USE_KEY, held, right_use

#: Nodes of a higher degree are swept one by one instead of compared in arrays.
STAR_DEGREE = 64
_TURN = 2 * math.pi


def half_edges(edges: DataFrame) -> DataFrame:
    """Two rows per edge: x, y (its node), sign (1 leaves from the source), angle, and what the checks need of the edge."""
    shared = ("edge_key", "created_key", "is_exterior", "prev_edge", "left_obj", "left_loc", "right_obj", "right_loc", "right_key")
    ends = F.array(
        F.struct(F.col("src_x").alias("x"), F.col("src_y").alias("y"), F.col("tgt_x").alias("to_x"), F.col("tgt_y").alias("to_y"), F.lit(1).alias("sign"), F.col("src_angle").alias("angle")),
        F.struct(F.col("tgt_x").alias("x"), F.col("tgt_y").alias("y"), F.col("src_x").alias("to_x"), F.col("src_y").alias("to_y"), F.lit(-1).alias("sign"), F.col("tgt_angle").alias("angle")),
    )
    return edges.select(*shared, F.inline(ends))


#: The node of half-edges from `dealt_halves`.
BY_NODE = ("x", "y", "node_hash")
#: Ordinates that tables and shuffles of half-edges hold apart from those of the node.
_NEAR = {"to_x": "x", "to_y": "y", "px": "x", "py": "y"}
_TO_NEAR = {c: _NEAR[c] for c in ("to_x", "to_y")}


def dealt_halves(flat: DataFrame, k: int = 0, slices: int = 1) -> DataFrame:
    """The half-edges at the nodes of slice k, dealt by node, from `edges.flat_edges`. Windows by BY_NODE need no other shuffle. What follows from other columns
    is not shuffled; `turns` adds edge_key and prev_edge after its windows. Edges with no end in the slice go before anything is made of them."""
    at = lambda x, y: in_slice(F.xxhash64(x, y), k, slices)
    end = lambda a, b, sign: F.struct(*[F.col(f"{p}_{c}").alias(t + c) for p, t in ((a, ""), (b, "to_")) for c in "xy"], F.lit(sign).alias("sign"))
    shared = [c for c in flat.columns if c[:4] not in ("src_", "tgt_")]
    h = flat.where(at("src_x", "src_y") | at("tgt_x", "tgt_y")).select(*shared, F.inline(F.array(end("src", "tgt", 1), end("tgt", "src", -1))))
    h = together(apart(h.where(at("x", "y")), _NEAR).repartition(F.xxhash64("x", "y")), _NEAR)
    right = right_use("created_object_id")
    more = {
        "node_hash": F.xxhash64("x", "y"),
        "angle": angle("x", "y", "to_x", "to_y"),
        "created_key": F.struct(*[F.col(f"created_{n}").alias(n) for n in USE_KEY]),
        "right_key": right["use_key"],
        "left_obj": signed_object("created_object_id"),
        "left_loc": held("left_loc", "created_object_id"),
        "right_obj": right["obj"],
        "right_loc": right["location"],
    }
    return h.withColumns(more).drop("right_inner", *[f"{c}_{n}" for c in ("created", "right") for n in USE_KEY])


def _next(*columns: str, node: tuple[str, ...] = ("x", "y")):
    """What the counter-clockwise successor at the node has in `columns`."""
    w = W.partitionBy(*node).orderBy("angle", "created_key")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    here = F.struct(*columns)
    return F.coalesce(F.lead(here).over(w), F.first(here).over(whole))


def ccw_next(halves: DataFrame) -> DataFrame:
    """Each half-edge with its counter-clockwise successor at the node: order by angle, then creation, then wrap around."""
    return halves.withColumn("next", _next("edge_key", "sign")).select("*", F.col("next.edge_key").alias("next_edge"), F.col("next.sign").alias("next_sign")).drop("next")


def _sweep_star(pdf: pd.DataFrame) -> pd.DataFrame:
    """The same for one node of a high degree: half-edges enter a sorted list in order of creation."""
    import bisect

    pdf = pdf.assign(_k=[tuple(k.values()) if isinstance(k, dict) else tuple(k) for k in pdf["created_key"]]).sort_values("_k").reset_index(drop=True)
    angles, at, out = [], [], []
    for i, row in enumerate(pdf.itertuples(index=False)):
        if i >= 2:
            p = bisect.bisect_right(angles, row.angle)  # equal angles count as clockwise, the newest first
            out.append((row.x, row.y, row.edge_key, row.sign, i, at[p - 1], at[p % len(at)], pdf["angle"][0]))
        p = bisect.bisect_right(angles, row.angle)
        angles.insert(p, row.angle)
        at.insert(p, i)
    cols = ("sign", "left_obj", "left_loc", "right_obj", "right_loc", "right_key", "angle")
    pick = lambda i: {c: (None if pd.isna(pdf[c][i]) else pdf[c][i]) if not isinstance(pdf[c][i], dict) else pdf[c][i] for c in cols}
    rows = [(x, y, e, s, n, pick(a), pick(b), f) for x, y, e, s, n, a, b, f in out]
    return pd.DataFrame(rows, columns=["x", "y", "n_edge", "n_sign", "older", "cw", "ccw", "first_angle"])


_NEIGHBOUR = ("sign", "left_obj", "left_loc", "right_obj", "right_loc", "right_key", "angle")
_FOUND = ("x", "y", "n_edge", "n_sign", "older", "cw", "ccw", "first_angle")


def attachments(halves: DataFrame, star_degree: int = STAR_DEGREE) -> DataFrame:
    """New half-edges with the neighbours they were set between, as of their creation.

    One shuffle on the node: a window hands each half-edge its older ones as an array, in which the nearest on either side
    are found. Nodes of a higher degree than `star_degree` get no array and are swept one by one."""
    h = _set_between(halves, star_degree).where("older >= 2 OR degree > " + str(star_degree))
    return _swept(keep(h.withColumnsRenamed({"edge_key": "n_edge", "sign": "n_sign"})), star_degree)


def _set_between(halves: DataFrame, star_degree: int, by: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Half-edges with degree, older, first_angle, and cw and ccw where the node is no star."""
    node = W.partitionBy(*by)
    order = node.orderBy("created_key")
    older = order.rowsBetween(W.unboundedPreceding, -1)
    one = F.struct("created_key", *_NEIGHBOUR)
    h = halves.withColumn("degree", F.count("*").over(node))
    h = h.withColumns({"older": (F.row_number().over(order) - 1).cast("long"), "first_angle": F.first("angle").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), "olds": F.collect_list(F.when(F.col("degree") <= star_degree, one)).over(older)})

    def nearest(distance, key):
        best = F.array_min(F.transform("olds", lambda o: F.struct(distance(o["angle"]).alias("d"), key(o["created_key"]).alias("k"), o.alias("o"))))["o"]
        return F.when(best.isNotNull(), F.struct(*[best[c].alias(c) for c in _NEIGHBOUR]))

    back = lambda a: turn(F.col("angle"), a)
    ahead = lambda a: F.when(a - F.col("angle") <= 0, a - F.col("angle") + _TURN).otherwise(a - F.col("angle"))
    newest = lambda k: F.struct(*[(-k[c]).alias(c) for c in ("object_id", "ring_no", "seg_ord", "v_ord")])
    late = lambda c: F.when(F.col("older") >= 2, c)
    return h.withColumns({"cw": late(nearest(back, newest)), "ccw": late(nearest(ahead, lambda k: k))}).drop("olds")


def _swept(h: DataFrame, star_degree: int) -> DataFrame:
    python_workers(h.sparkSession)
    small, stars = h.where(F.col("degree") <= star_degree).drop("degree"), h.where(F.col("degree") > star_degree)
    rest = stars.drop("degree", "older", "cw", "ccw", "first_angle")
    swept = stars.withColumnsRenamed({"n_edge": "edge_key", "n_sign": "sign"}).groupBy("x", "y").applyInPandas(_sweep_star, small.select(*_FOUND).schema)
    return small.unionByName(rest.join(swept, ["x", "y", "n_edge", "n_sign"]))


def turns(halves: DataFrame, star_degree: int = STAR_DEGREE) -> DataFrame:
    """What all detections need of the nodes, after one shuffle: x, y, and `first` for one row of each node; `open` for edges without a right owner, by their half-edge at
    the target (x, y of the source as to_x, to_y), with `follower`, the creation key of the open edge of the same kind that follows on the right face;
    `bad` for half-edges that are in error and all of stars. Other rows are left out, and columns that nothing reads are null."""
    node = BY_NODE if "node_hash" in halves.columns else BY_NODE[:2]
    h = halves.withColumn("next", _next("sign", "created_key", "left_obj", "right_obj", node=node))
    h = _set_between(h, star_degree, node)
    if "px" in h.columns:
        source = F.struct(*[F.when(F.col("sign") > 0, F.col(c)).otherwise(F.col(f"to_{c}")).alias(c) for c in "xy"])
        h = h.withColumns({"edge_key": edge_key("x", "y", "to_x", "to_y"), "_s": source})
        h = h.withColumn("prev_edge", F.when(F.col("px").isNotNull(), edge_key("px", "py", "_s.x", "_s.y")))
    h = _is_invalid(h.withColumn("n_sign", F.col("sign")))
    n, opened = F.col("next"), (F.col("sign") == -1) & F.col("right_obj").isNull()
    goes_on = (n["sign"] == 1) & n["right_obj"].isNull() & ((n["left_obj"] < 0) == (F.col("left_obj") < 0))
    wrong = F.coalesce((F.col("older") >= 2) & (F.col("invalid") | _crosses()), F.lit(False)) | (F.col("degree") > star_degree)
    h = h.withColumns({"first": F.col("older") == 0, "open": opened, "bad": wrong}).where("first OR open OR bad")
    either, bad = F.col("open") | F.col("bad"), F.col("bad")
    some = [F.when(either, F.col(c)).alias(c) for c in ("created_key", "to_x", "to_y", "left_obj", "left_loc")]
    rest = [F.when(bad, F.col(c)).alias(a) for c, a in (("edge_key", "n_edge"), ("sign", "n_sign"))]
    rest += [F.when(bad, F.col(c)).alias(c) for c in ("angle", "is_exterior", "prev_edge", "right_obj", "right_loc", "right_key", "degree", "older", "first_angle", "cw", "ccw")]
    return h.select("x", "y", "first", "open", "bad", F.when(F.col("open") & goes_on, n["created_key"]).alias("follower"), *some, *rest)


def bad_attachments(turned: DataFrame, star_degree: int = STAR_DEGREE) -> DataFrame:
    """The rows of `attachments` that are in error, and those of stars, from `turns`."""
    return _swept(turned.where("bad").drop("first", "open", "bad", "follower"), star_degree)


def packed_turns(turned: DataFrame) -> DataFrame:
    """`turns` with each object and point once and points held apart from the node, as tables keep them. `unpacked_turns` adds the rest again."""
    of = F.col("created_key.object_id")
    follower = F.struct((F.col("follower.object_id").bitwiseXOR(of)).alias("object_id"), *[F.col(f"follower.{k}").alias(k) for k in USE_KEY[1:]])
    lean = {"follower": F.when(F.col("follower").isNotNull(), follower), "left_loc": held("left_loc", "created_key.object_id"), "left_obj": F.col("left_obj") != of}
    return apart(turned.withColumns(lean | _held_sides()).withColumnRenamed("left_obj", "left_inner").drop("n_edge"), _TO_NEAR)


def _held_sides() -> dict[str, Column]:
    """Locations and keys of neighbours and right sides, held against the object on their side; the same again gives them back."""
    at = lambda c, obj: F.col(c).bitwiseXOR(F.abs(obj))
    key = lambda k, obj: F.when(F.col(k).isNotNull(), F.struct(at(f"{k}.object_id", obj).alias("object_id"), *[F.col(f"{k}.{c}").alias(c) for c in USE_KEY[1:]]))
    out = {"right_loc": at("right_loc", F.col("right_obj")), "right_key": key("right_key", F.col("right_obj"))}
    for s in ("cw", "ccw"):
        left, right = F.col(f"{s}.left_obj"), F.col(f"{s}.right_obj")
        new = {"left_loc": at(f"{s}.left_loc", left), "right_loc": at(f"{s}.right_loc", right), "right_key": key(f"{s}.right_key", right)}
        out[s] = F.when(F.col(s).isNotNull(), F.struct(*[new.get(c, F.col(f"{s}.{c}")).alias(c) for c in _NEIGHBOUR]))
    return out


def unpacked_turns(kept: DataFrame) -> DataFrame:
    kept = together(kept, _TO_NEAR)
    of = F.col("created_key.object_id")
    follower = F.struct((F.col("follower.object_id").bitwiseXOR(of)).alias("object_id"), *[F.col(f"follower.{k}").alias(k) for k in USE_KEY[1:]])
    more = {"follower": F.when(F.col("follower").isNotNull(), follower), "left_loc": held("left_loc", "created_key.object_id"), "left_obj": F.when(F.col("left_inner"), -of).otherwise(of)}
    return kept.withColumns(more | _held_sides() | {"n_edge": F.when(F.col("bad"), edge_key("x", "y", "to_x", "to_y"))}).drop("left_inner")


def _occupant(side: str, positive: str, negative: str):
    """Owner on one side of neighbour `side` when the new edge came: the right one only if it was set before."""
    s = F.col(side)
    early = s["right_key"] < F.col("created_key")
    right = lambda f: F.when(early, s[f"right_{f}"])
    of = {"left": lambda f: s[f"left_{f}"], "right": right}
    return {f: F.coalesce(F.when(s["sign"] > 0, of[positive](f)).otherwise(of[negative](f)), F.lit(0)) for f in ("obj", "loc")}


def _is_invalid(att: DataFrame) -> DataFrame:
    """The reference at the source end of an edge that continues its ring is the ring's previous edge, else the node's first half-edge."""
    p = F.col("prev_edge")
    starts = (p["ax"] == F.col("x")) & (p["ay"] == F.col("y"))
    back = F.atan2(F.when(starts, p["by"]).otherwise(p["ay"]) - F.col("y"), F.when(starts, p["bx"]).otherwise(p["ax"]) - F.col("x"))
    return att.withColumn("invalid", F.col("angle") == F.when((F.col("n_sign") > 0) & p.isNotNull(), back).otherwise(F.col("first_angle")))


def _end_no():
    """Which of an edge's ends reports first: the source end where the edge starts its ring, else the target end."""
    return F.when(F.col("prev_edge").isNull() == (F.col("n_sign") > 0), 0).otherwise(1).alias("end_no")


def _sides():
    return _occupant("cw", "left", "right"), _occupant("ccw", "right", "left")


def _crosses():
    """An exterior edge in another's interior, an interior one beside another object's."""
    on_cw, on_ccw = _sides()
    own = F.col("left_obj")
    other = lambda o: (o["obj"] != 0) & (F.abs(o["obj"]) != F.abs(own))
    return F.when(F.col("is_exterior"), (on_cw["obj"] != 0) & (on_cw["obj"] != own)).otherwise(other(on_ccw) | other(on_cw))


def ring_intersections(att: DataFrame) -> DataFrame:
    """RING_INTERSECTION: use_key, x, y, is_loc, cw_loc, ccw_loc, end_no."""
    a = _is_invalid(att).where(~F.col("invalid"))
    on_cw, on_ccw = _sides()
    return a.where(_crosses()).select(F.col("created_key").alias("use_key"), "x", "y", F.col("left_loc").alias("is_loc"), on_ccw["loc"].alias("cw_loc"), on_cw["loc"].alias("ccw_loc"), _end_no())


def invalid_angles(att: DataFrame) -> DataFrame:
    """INVALID_ANGLE: a new half-edge in the very direction of its reference (see _is_invalid)."""
    return _is_invalid(att).where("invalid").select(F.col("created_key").alias("use_key"), "x", "y", F.abs("left_obj").alias("obj"), F.col("to_x").alias("tx"), F.col("to_y").alias("ty"), _end_no())
