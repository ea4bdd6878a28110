"""Queries over shapes and points: stars and circles around suppliers and nations, with the orders as points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinewright.core import read
from spinewright.functions.keys import EARTH_M
from spinewright.operators import geometry, shapes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: The corners of a star of radius 1, closed.
_STAR = ((1.0, 0.0), (0.3, 0.25), (0.0, 1.0), (-0.3, 0.3), (-1.0, 0.125), (-0.25, -0.3), (0.125, -1.0), (0.35, -0.2), (1.0, 0.0))
_POINTS = """p AS MATERIALIZED (SELECT o_orderkey AS id, o_orderkey * 7919 % 1009 AS rank, 29.0 + o_orderkey * 37 % 10007 / 10007.0::DOUBLE * 1.5 AS lat,
  -96.5 + (o_custkey * 101 + o_orderkey * 13) % 10009 / 10009.0::DOUBLE * 2.0 AS lng FROM orders)"""


def _shapes_sql(table: str, key: str, size: str, metres: str) -> str:
    """Even keys are stars of ``size`` degrees, odd ones circles of ``metres``."""
    corners = ", ".join(f"{{'x1': lng + {a[0]}::DOUBLE * d, 'y1': lat + {a[1]}::DOUBLE * d, 'x2': lng + {b[0]}::DOUBLE * d, 'y2': lat + {b[1]}::DOUBLE * d}}" for a, b in zip(_STAR, _STAR[1:], strict=False))
    return f"""c AS (SELECT {key} AS shape_id, 29.0::DOUBLE + {key} * 61 % 151 / 100.0::DOUBLE AS lat, -96.5::DOUBLE + {key} * 83 % 199 / 100.0::DOUBLE AS lng, {size} AS d, CASE WHEN {key} % 2 = 1 THEN ({metres})::DOUBLE END AS m FROM {table}),
s AS MATERIALIZED (SELECT *, [{corners}] AS edges, CASE WHEN m IS NULL THEN d ELSE degrees(m / {EARTH_M}::DOUBLE) END AS d_lat, CASE WHEN m IS NULL THEN d ELSE degrees(asin(least(1, sin(m / {EARTH_M}::DOUBLE) / cos(radians(lat))))) END AS d_lng FROM c)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(k.alias("place_id"), (k * 7919 % 1009).alias("rank"), (29.0 + k * 37 % 10007 / F.lit(10007.0) * 1.5).alias("point_lat"), (-96.5 + (c * 101 + k * 13) % 10009 / F.lit(10009.0) * 2.0).alias("point_lng"))


def _shapes(table: DataFrame, key: str, size: Column, metres: Column) -> DataFrame:
    k = F.col(key)
    at = table.select(k.alias("shape_id"), (29.0 + k * 61 % 151 / F.lit(100.0)).alias("lat"), (-96.5 + k * 83 % 199 / F.lit(100.0)).alias("lng"), size.alias("d"), F.when(k % 2 == 1, metres.cast("double")).alias("radius_m"))
    star = F.array(*[F.struct((F.col("lng") + x * F.col("d")).alias("lng"), (F.col("lat") + y * F.col("d")).alias("lat")) for x, y in _STAR])
    return at.withColumn("rings", F.when(F.col("radius_m").isNull(), F.array(star)))


def _distance(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return f"2 * {EARTH_M}::DOUBLE * asin(sqrt(least(1, power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lng2} - {lng1}) / 2), 2))))"


def _odd(edges: str, lng: str, lat: str) -> str:
    return f"len(list_filter({edges}, lambda e: (e.y1 > {lat}) <> (e.y2 > {lat}) AND {lng} < e.x1 + (e.x2 - e.x1) * ({lat} - e.y1) / (e.y2 - e.y1))) % 2 = 1"


_SUPPLIER_SIZE, _SUPPLIER_M = "0.05::DOUBLE + s_suppkey % 7 / 40.0::DOUBLE", "2000 + s_suppkey * 977 % 20000"


@query(f"""WITH {_POINTS}, {_shapes_sql("supplier", "s_suppkey", _SUPPLIER_SIZE, _SUPPLIER_M)}
SELECT p.id AS place_id, shape_id FROM p, s WHERE CASE WHEN m IS NULL THEN {_odd("edges", "p.lng", "p.lat")} ELSE {_distance("s.lat", "s.lng", "p.lat", "p.lng")} <= m END""")
def shape_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = _shapes(read(spark, sf_dir, "supplier"), "s_suppkey", 0.05 + k % 7 / F.lit(40.0), 2000 + k * 977 % 20000)
    return shapes.points_in_shapes(_points(spark, sf_dir), s).select("place_id", "shape_id")


_SIDES = " AND ".join(f"{f}({', '.join(f'(e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1)' for x in ('west', 'east') for y in ('south', 'north'))}) {sign} 0" for f, sign in (("least", "<="), ("greatest", ">=")))
_MEETS = f"""CASE WHEN m IS NULL THEN len(list_filter(edges, lambda e: least(e.y1, e.y2) <= north AND south <= greatest(e.y1, e.y2) AND least(e.x1, e.x2) <= east AND west <= greatest(e.x1, e.x2) AND {_SIDES})) > 0 OR {_odd("edges", "west", "south")}
  ELSE {_distance("lat", "lng", "least(north, greatest(south, lat))", "least(east, greatest(west, lng))")} <= m END"""
_STEP = f"""CASE WHEN len(ids) < {geometry.FULL_RESULTS} AND ceil(len(ids) / {shapes.PAGE}.0) < {geometry.FULL_PAGES} THEN 'done' WHEN depth >= {geometry.MAX_DEPTH} THEN 'max_depth'
  WHEN least((north - south) * {geometry.M_PER_DEGREE}::DOUBLE, (east - west) * {geometry.M_PER_DEGREE}::DOUBLE * cos(radians((south + north) / 2))) / 2 < {geometry.MIN_SIDE_M} THEN 'min_size' WHEN shared >= {geometry.MAX_OVERLAP} THEN 'novelty' ELSE 'subdivide' END"""
_IDS = f"coalesce((list(p.id ORDER BY p.rank, p.id) FILTER (p.id IS NOT NULL))[1:{shapes.MOST_RESULTS}], [])"
_HELD = "LEFT JOIN p ON p.lat BETWEEN south AND north AND p.lng BETWEEN west AND east"


@query(f"""WITH RECURSIVE {_POINTS}, {_shapes_sql("nation", "n_nationkey", "0.2::DOUBLE + n_nationkey % 5 / 10.0::DOUBLE", "9000 + n_nationkey * 3001 % 40000")},
t AS (
  SELECT *, {_STEP} AS step FROM (SELECT shape_id, 'r' AS path, 0 AS depth, south, west, north, east, NULL::DOUBLE AS shared, {_IDS} AS ids FROM (SELECT shape_id, lat - d_lat AS south, lng - d_lng AS west, lat + d_lat AS north, lng + d_lng AS east FROM s) r {_HELD} GROUP BY ALL)
  UNION ALL
  SELECT *, {_STEP} AS step FROM (SELECT shape_id, path, depth, south, west, north, east, CASE WHEN len(ids) > 0 THEN len(list_intersect(ids, above)) / len(ids)::DOUBLE END AS shared, ids FROM (
    SELECT shape_id, path, depth, south, west, north, east, above, {_IDS} AS ids FROM (
      SELECT q.* FROM (SELECT shape_id, path || i AS path, depth + 1 AS depth, CASE WHEN i >= 2 THEN (south + north) / 2 ELSE south END AS south, CASE WHEN i % 2 = 1 THEN (west + east) / 2 ELSE west END AS west,
        CASE WHEN i >= 2 THEN north ELSE (south + north) / 2 END AS north, CASE WHEN i % 2 = 1 THEN east ELSE (west + east) / 2 END AS east, ids AS above FROM t, (VALUES (0), (1), (2), (3)) v(i) WHERE step = 'subdivide') q
      JOIN s USING (shape_id) WHERE {_MEETS}) c {_HELD} GROUP BY ALL)))
SELECT shape_id, path, depth, len(ids) AS results, ceil(len(ids) / {shapes.PAGE}.0)::BIGINT AS pages, shared,
  CASE WHEN step = 'subdivide' AND (shape_id, path) NOT IN (SELECT (shape_id, path[:-2]) FROM t WHERE depth > 0) THEN 'done' ELSE step END AS step FROM t""")
def shape_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    s = _shapes(read(spark, sf_dir, "nation"), "n_nationkey", 0.2 + k % 5 / F.lit(10.0), 9000 + k * 3001 % 40000)
    circle = geometry.circle_box(F.col("lat"), F.col("lng"), F.col("radius_m"))
    side = lambda of_circle, of_star: F.when(F.col("radius_m").isNotNull(), of_circle).otherwise(of_star)
    s = s.select(
        "shape_id", "rings", "lat", "lng", "radius_m", side(circle.south, F.col("lat") - F.col("d")).alias("south"), side(circle.west, F.col("lng") - F.col("d")).alias("west"),
        side(circle.north, F.col("lat") + F.col("d")).alias("north"), side(circle.east, F.col("lng") + F.col("d")).alias("east"),
    )
    return shapes.searched(s, _points(spark, sf_dir)).select("shape_id", "path", "depth", "results", "pages", "shared", "step")
