"""Rings, rectangles and circles as Column expressions: seed cleaning, intersection tests, subdivision of search tiles.

A ring is ``array<struct<lng, lat>>``, a rectangle the columns or literals south, west, north and east.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from spinewright.functions.keys import EARTH_M, distance_m

M_PER_DEGREE = EARTH_M * math.pi / 180
# A search is full at so many results or pages; limits of subdivision.
FULL_RESULTS, FULL_PAGES, MAX_DEPTH, MIN_SIDE_M, MAX_OVERLAP = 60, 3, 5, 500, 0.75


class Rect(NamedTuple):
    south: Column
    west: Column
    north: Column
    east: Column


def _edges(ring: Column) -> Column:
    """Each point with the next."""
    n = F.size(ring)
    return F.when(n > 1, F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def clockwise(ring: Column) -> Column:
    """Whether a ring runs clockwise, as outer rings do."""
    return F.coalesce(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["b"]["lng"] - e["a"]["lng"]) * (e["b"]["lat"] + e["a"]["lat"])), F.lit(0.0)) > 0


def cleaned(ring: Column, digits: int = 4) -> Column:
    """Coordinates rounded half up, then points equal to the one before them left out."""
    scale = 10**digits
    at = lambda v: F.floor(v * scale + 0.5) / scale
    points = F.transform(ring, lambda p: F.struct(at(p["lng"]).alias("lng"), at(p["lat"]).alias("lat")))
    once = F.transform(F.array(points), lambda ps: F.filter(ps, lambda p, i: (i == 0) | (p != F.element_at(ps, F.greatest(i, F.lit(1))))))
    return once[0]


def outer_rings(rings: Column) -> Column:
    """The clockwise rings, cleaned, that keep four points or more."""
    return F.filter(F.transform(F.filter(rings, clockwise), cleaned), lambda r: F.size(r) >= 4)


def bounding_box(rings: Column) -> Column:
    points = F.flatten(rings)
    axis = lambda f, pick: pick(F.transform(points, lambda p: p[f]))
    return F.struct(axis("lat", F.array_min).alias("south"), axis("lng", F.array_min).alias("west"), axis("lat", F.array_max).alias("north"), axis("lng", F.array_max).alias("east"))


def circle_box(lat: Column, lng: Column, radius_m: Column) -> Rect:
    angle = radius_m / EARTH_M
    d_lat, d_lng = F.degrees(angle), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians(lat)))))
    return Rect(lat - d_lat, lng - d_lng, lat + d_lat, lng + d_lng)


def overlap(a: Rect, b: Rect) -> Column:
    return (a.south <= b.north) & (b.south <= a.north) & (a.west <= b.east) & (b.west <= a.east)


def meets_circle(r: Rect, lat: Column, lng: Column, radius_m: Column) -> Column:
    """Whether the rectangle's point nearest to the centre is within the radius."""
    return distance_m(lat, lng, F.least(r.north, F.greatest(r.south, lat)), F.least(r.east, F.greatest(r.west, lng))) <= radius_m


def in_ring(lng: Column, lat: Column, ring: Column) -> Column:
    """Ray casting; the last point is joined to the first."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    at = lambda e: e["a"]["lng"] + (e["b"]["lng"] - e["a"]["lng"]) * (lat - e["a"]["lat"]) / F.nullif(e["b"]["lat"] - e["a"]["lat"], F.lit(0.0))
    crossed = F.filter(_edges(closed), lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lng < at(e)))
    return F.coalesce(F.size(crossed) % 2 == 1, F.lit(False))


def _side_of_line(a: Column, b: Column, x: Column, y: Column) -> Column:
    return (b["lng"] - a["lng"]) * (y - a["lat"]) - (b["lat"] - a["lat"]) * (x - a["lng"])


def _edge_meets_rect(a: Column, b: Column, r: Rect) -> Column:
    """A segment meets a rectangle if their boxes overlap and the corners don't all lie on one side of its line."""
    sides = F.array(*[_side_of_line(a, b, x, y) for x in (r.west, r.east) for y in (r.south, r.north)])
    box = Rect(F.least(a["lat"], b["lat"]), F.least(a["lng"], b["lng"]), F.greatest(a["lat"], b["lat"]), F.greatest(a["lng"], b["lng"]))
    return overlap(box, r) & (F.array_min(sides) <= 0) & (F.array_max(sides) >= 0)


def meets_rings(r: Rect, rings: Column) -> Column:
    """Whether the rectangle and any outer ring share a point; touching counts."""
    # a segment inside, across or on the rectangle meets it; without one, the ring holds the rectangle or misses it
    edge = lambda ring: F.exists(F.coalesce(_edges(ring), F.expr("cast(array() as array<struct<a:struct<lng:double,lat:double>,b:struct<lng:double,lat:double>>>)")), lambda e: _edge_meets_rect(e["a"], e["b"], r))
    return F.exists(rings, lambda ring: edge(ring) | in_ring(r.west, r.south, ring))


def next_step(results: Column, pages: Column, depth: Column, r: Rect, shared: Column) -> Column:
    """What follows a tile's search: done, max_depth, min_size, novelty or subdivide. ``shared``: the part of its results
    that its parent had too, null at the root."""
    full = (results == FULL_RESULTS) | (F.coalesce(pages, F.lit(0)) >= FULL_PAGES)
    height, width = (r.north - r.south) * M_PER_DEGREE, (r.east - r.west) * M_PER_DEGREE * F.cos(F.radians((r.south + r.north) / 2))
    return F.when(~full, "done").when(depth >= MAX_DEPTH, "max_depth").when(F.least(height, width) / 2 < MIN_SIDE_M, "min_size").when(shared >= MAX_OVERLAP, "novelty").otherwise("subdivide")
