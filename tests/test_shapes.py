"""Points in shapes and the search of shapes against every shape on every point."""

import math
import random

from pyspark.sql import functions as F

from spinewright.operators import geometry, shapes

SHAPES = "shape_id long, rings array<array<struct<lng:double,lat:double>>>, lat double, lng double, radius_m double"
POINTS = "place_id long, rank long, point_lat double, point_lng double"


def _holds(shape, lat, lng):
    _, rings, a, b, m = shape
    if m is not None:
        h = math.sin(math.radians(lat - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(lat)) * math.sin(math.radians(lng - b) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h)) <= m
    odd = lambda ring: sum(((y > lat) != (v > lat)) and lng < x + (u - x) * (lat - y) / (v - y) for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2
    return any(odd(r) for r in rings if len(r) > 2)


def _some(r):
    ring = lambda x, y, d: [(x + d * math.cos(t) * r.uniform(0.3, 1), y + d * math.sin(t) * r.uniform(0.3, 1)) for t in sorted(r.uniform(0, 6.28) for _ in range(r.randint(3, 14)))]
    out = [(i, [ring(r.uniform(-99, -95), r.uniform(28, 31), r.choice([0.01, 0.2, 1.5])) for _ in range(r.choice([1, 1, 3]))], None, None, None) for i in range(30)]
    out += [(100 + i, None, r.uniform(28, 31), r.uniform(-99, -95), r.choice([40.0, 3e3, 9e4])) for i in range(15)]
    # a square on borders of cells, and rings that are none
    return [*out, (200, [[(-90.0, 22.5), (-90.0, 45.0), (-67.5, 45.0), (-67.5, 22.5)]], None, None, None), (201, [[(1.0, 1.0), (2.0, 2.0)]], None, None, None), (202, [], None, None, None)]


def test_points_in_shapes_equal_every_shape_on_every_point(spark):
    r = random.Random(5)
    made = _some(r)
    points = [(i, 0, r.uniform(27, 32), r.uniform(-100, -94)) for i in range(1500)] + [(9000, 0, 22.5, -90.0), (9001, 0, 33.75, -78.75), (9002, 0, None, 1.0), (9003, 0, 90.0, 180.0)]
    points += [(i, 0, *points[7][2:]) for i in range(5000, 5300)]  # many points at one place
    out = shapes.points_in_shapes(spark.createDataFrame(points, POINTS), spark.createDataFrame(made, SHAPES))
    got = [(x["place_id"], x["shape_id"]) for x in out.collect()]
    want = {(p[0], s[0]) for p in points if p[2] is not None for s in made if _holds(s, p[2], p[3])}
    assert len(got) == len(set(got)) and set(got) == want and len({s for _, s in want}) > 25
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_shapes_and_no_points(spark):
    none, some = spark.createDataFrame([], SHAPES), spark.createDataFrame(_some(random.Random(1)), SHAPES)
    assert shapes.points_in_shapes(spark.createDataFrame([(1, 0, 30.0, -97.0)], POINTS), none).count() == 0
    assert shapes.points_in_shapes(spark.createDataFrame([], POINTS), some).count() == 0


def test_a_cover_is_disjoint_and_mostly_inside(spark):
    circle = spark.createDataFrame([(1, None, 30.0, -97.0, 50_000.0)], SHAPES)
    cells = shapes.cover(circle).collect()
    areas = {inside: sum(4.0 ** -x["depth"] for x in cells if x["inside"] == inside) for inside in (True, False)}
    assert areas[True] > 2 * areas[False]
    by_key = {(x["depth"], x["x"], x["y"]) for x in cells}
    assert len(by_key) == len(cells) and not any((d - k, x >> k, y >> k) in by_key for d, x, y in by_key for k in range(1, d))


def _searched(spark, made, points):
    s = spark.createDataFrame(made, SHAPES)
    box, circle = geometry.bounding_box(F.col("rings")), geometry.circle_box(F.col("lat"), F.col("lng"), F.col("radius_m"))
    s = s.select("*", *[F.coalesce(getattr(circle, k), box[k]).alias(k) for k in ("south", "west", "north", "east")])
    return {(x["shape_id"], x["path"]): x for x in shapes.searched(s, spark.createDataFrame(points, POINTS)).collect()}


def test_search_stops_for_its_reasons(spark):
    r = random.Random(8)
    square = lambda d: [[(-97 - d, 30 - d), (-97 - d, 30 + d), (-97 + d, 30 + d), (-97 + d, 30 - d), (-97 - d, 30 - d)]]
    spread = [(i, i, 30 + r.uniform(-1, 1), -97 + r.uniform(-1, 1)) for i in range(300)]
    t = _searched(spark, [(1, square(1.0), None, None, None)], spread)
    assert t[1, "r"]["results"] == 60 and t[1, "r"]["pages"] == 3 and t[1, "r"]["step"] == "subdivide"
    assert len([k for k in t if len(k[1]) == 2]) == 4 and all(x["step"] == "done" for (_, p), x in t.items() if len(p) == 3)
    # all places in one corner: the child answers what its parent did
    same = [(i, i, 30.6 + i / 1e4, -96.4 + i / 1e4) for i in range(100)]
    t = _searched(spark, [(1, square(1.0), None, None, None)], same)
    assert {p: x["step"] for (_, p), x in t.items()} == {"r": "subdivide", "r0": "done", "r1": "done", "r2": "done", "r3": "novelty"}
    assert t[1, "r3"]["shared"] == 1.0 and t[1, "r0"]["shared"] is None and t[1, "r0"]["results"] == 0
    # a small tile has no children
    t = _searched(spark, [(1, square(0.004), None, None, None)], [(i, i, 30 + r.uniform(-0.004, 0.004), -97.0) for i in range(80)])
    assert {p: x["step"] for (_, p), x in t.items()} == {"r": "min_size"}
    # 41 to 59 answers take three pages, which is full too; quadrants off a shape are left out
    corner = [[(-98.0, 29.0), (-98.0, 29.1), (-97.9, 29.0), (-98.0, 29.0)], [(-97.99, 30.5), (-97.99, 31.0), (-97.5, 31.0), (-97.99, 30.5)]]
    t = _searched(spark, [(1, corner, None, None, None)], [(i, i, 29.0 + 2 * i / 50, -98.0 + i / 100) for i in range(45)])
    assert t[1, "r"]["step"] == "subdivide" and {p for _, p in t} == {"r", "r0", "r2", "r3"} - ({"r3"} if (1, "r3") not in t else set())


def test_search_of_nothing(spark):
    assert _searched(spark, [(1, None, 30.0, -97.0, 9e4)], [])[1, "r"]["step"] == "done"
    assert _searched(spark, [], [(1, 1, 30.0, -97.0)]) == {}
