"""All detections on tables of any size, within a small multiple of the input's disk.

A shuffle of all uses or half-edges takes several times the input. So plans whose rows meet by edge or node run on slices of these, one after the other, and
what a step has read goes when it is done. Tables between steps hold what later steps read and no more."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import apart, together
from . import boundaries, edges, errors, faces, rings, rotation
from .materialise import discard, input_bytes, keep_lean, sliced

#: Coverages read from files of so many bytes are dealt with in slices: by edge or node in so many, by object or line, and what few rows reach, in half of it.
SLICES, SLICED_FROM = 8, 8 << 20


def slices_for(vertices: DataFrame) -> int:
    return SLICES if input_bytes(vertices) >= SLICED_FROM else 1


def detect(vertices: DataFrame, lines: DataFrame, slices: int | None = None) -> list[DataFrame]:
    """The errors of every detection in the common shape, as tables of `keep_lean`."""
    n = slices or slices_for(vertices)
    fewer = -(-n // 2)
    uses = keep_lean(*sliced(fewer, lambda v: rings.packed(rings.edge_uses(v, in_blocks=True)), (vertices, F.xxhash64(rings.block()))))
    shape = lambda u: rings.packed(edges.reported(edges.owned_uses(rings.dealt(u), rings.BY_EDGE)).drop("uses"))
    packed = keep_lean(*sliced(n, shape, (uses, rings.edge_hash())))
    discard(uses)
    flat = edges.flat_edges(packed)
    kept = keep_lean(*[lambda k=k: rotation.packed_turns(rotation.turns(rotation.dealt_halves(flat, k, n))) for k in range(n)])
    turned = rotation.unpacked_turns(kept)
    att = rotation.bad_attachments(turned)
    surface = [
        errors.as_errors(edges.overlapping_edges(rings.unpacked(packed)), "RING_OVERLAPPING_EDGES", "surface"),
        errors.as_errors(rotation.ring_intersections(att), "RING_INTERSECTION", "surface"),
        errors.as_errors(rotation.invalid_angles(att), "INVALID_ANGLE", "surface"),
    ]
    surface = keep_lean(reduce(DataFrame.unionByName, surface))
    ends = keep_lean(apart(together(packed.where("n = 1"), rings.NEAR).select("x1", "y1", "x2", "y2"), boundaries.ENDS_NEAR))
    discard(packed)
    walked = faces.turned_walks(turned)
    open_faces = [errors.as_errors(faces.holes(walked=walked), "HOLE_EMPTY_INTERIOR", "holes"), errors.as_errors(faces.free_standing(walked=walked), "FREE_STANDING_SURFACE", "free")]
    open_faces = keep_lean(reduce(DataFrame.unionByName, open_faces))
    discard(walked)
    at = keep_lean(kept.where("first").select("x", "y"))
    discard(kept)
    detached, invalid = boundaries.sliced_errors(boundaries.kept_vertices(lines, fewer), ends, at, n)
    discard(at)
    at_lines = [errors.as_errors(detached, "BOUNDARY_POINT_DETACHED", "boundary"), errors.as_errors(invalid, "BOUNDARY_EDGE_INVALID", "boundary")]
    at_lines = keep_lean(*at_lines)
    discard(detached, invalid)
    return [surface, open_faces, at_lines]
