"""Points in many shapes by an equality join on quad-tree cells, and the search of shapes by tiles that subdivide.

A shape is a row of ``shape_id`` and either ``rings`` (``array<array<struct<lng, lat>>>``, outer rings) or a circle's
``lat``, ``lng`` and ``radius_m``. The cells of depth ``d`` cut the globe into ``2**d`` columns and rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinewright.core import materialize, sized_join
from spinewright.functions.keys import EARTH_M, distance_m
from spinewright.operators import geometry
from spinewright.operators.geometry import Rect

MOST_DEPTH = 24
#: How much finer the cells of a shape are than those that its box fits in.
FINER = 5
#: Cells that may be broadcast; a cell holds up to ``SLOTS`` edges.
BROADCAST_CELLS = 50_000
#: Cells of a task's shapes; each takes some microseconds, and some 25 where its row has many edges.
CELLS_A_TASK = 250_000
#: Points and cells that a task of the join meets, and the points of a cell from which it is dealt over several.
ROWS_A_TASK, CELL_POINTS = 50_000, 100_000
#: A row of cells that so few edges cross holds them as plain columns, whose tests Spark compiles.
SLOTS = 8
_EDGES = "array<array<struct<a:struct<lng:double,lat:double>,b:struct<lng:double,lat:double>>>>"


def cell_rect(depth: Column, x: Column, y: Column) -> Rect:
    """A cell's rectangle. Its borders are whole multiples of a power of two of the globe's sides, so neighbours share them."""
    cells = F.pow(F.lit(2.0), depth)
    south, west = F.lit(-90.0) + y * 180.0 / cells, F.lit(-180.0) + x * 360.0 / cells
    return Rect(south, west, F.lit(-90.0) + (y + 1) * 180.0 / cells, F.lit(-180.0) + (x + 1) * 360.0 / cells)


def cell_of(value: Column, least: float, side: float, depth: int) -> Column:
    """The column (or row) of cells that holds a coordinate; the division is mended where it rounds across a border."""
    n = 1 << depth
    at = F.floor((value - least) * n / side).cast("long")
    border = lambda i: F.lit(least) + i * side / float(n)
    at = F.when(value < border(at), at - 1).when(value >= border(at + 1), at + 1).otherwise(at)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), at)).cast("long")


def _strip(edges: Column, r: Rect) -> Column:
    """The edges a ray at one of the rectangle's latitudes can cross; the others never count."""
    return F.transform(edges, lambda ring: F.filter(ring, lambda e: (F.least(e["a"]["lat"], e["b"]["lat"]) <= r.north) & (F.greatest(e["a"]["lat"], e["b"]["lat"]) >= r.south)))


def _odd(ring: Column, lng: Column, lat: Column) -> Column:
    """Ray casting over the edges of one ring."""
    at = lambda e: e["a"]["lng"] + (e["b"]["lng"] - e["a"]["lng"]) * (lat - e["a"]["lat"]) / F.nullif(e["b"]["lat"] - e["a"]["lat"], F.lit(0.0))
    return F.size(F.filter(ring, lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lng < at(e)))) % 2 == 1


def _slots() -> list[tuple[dict[str, Column], dict[str, Column]]]:
    """The two ends of each slot's edge."""
    return [tuple({c: F.col(f"{end}{i}_{c}") for c in ("lng", "lat")} for end in "ab") for i in range(SLOTS)]


def _slots_odd(lng: Column, lat: Column) -> Column:
    """As :func:`_odd` over the slots; an edge that doesn't rise is never divided by its height."""
    at = lambda a, b: a["lng"] + (b["lng"] - a["lng"]) * (lat - a["lat"]) / (b["lat"] - a["lat"])
    return reduce(lambda x, y: x != y, [((a["lat"] > lat) != (b["lat"] > lat)) & (lng < at(a, b)) for a, b in _slots()])


def _rows(shapes: DataFrame, finer: int) -> DataFrame:
    """The rows of cells of each shape's box, ``finer`` levels below those that it fits in: ``shape_id, lat, lng, radius_m, depth, y,
    first_x, last_x, edges``, with the edges that decide for their points. Rings of fewer than three points have none."""
    has = F.col("radius_m").isNotNull()
    circle = geometry.circle_box(F.col("lat"), F.col("lng"), F.col("radius_m"))
    box = F.when(has, F.struct(circle.south.alias("south"), circle.west.alias("west"), circle.north.alias("north"), circle.east.alias("east"))).otherwise(geometry.bounding_box(F.col("rings")))
    closed = F.transform(F.filter("rings", lambda r: F.size(r) > 2), lambda r: geometry._edges(F.concat(r, F.slice(r, 1, 1))))
    rows = shapes.select("shape_id", "lat", "lng", "radius_m", box.alias("box"), F.coalesce(F.when(~has, closed), F.expr(f"cast(array() as {_EDGES})")).alias("edges")).where("box.south is not null")
    # few small files would be read by one task; a shuffle also keeps the box from being worked out for each use
    rows = rows.repartition(shapes.count() * 4**finer // CELLS_A_TASK + 1, "shape_id")
    fits = lambda whole, side: F.floor(F.log2(F.lit(whole) / F.greatest(side, F.lit(1e-6))))
    start = F.least(fits(180.0, F.col("box.north") - F.col("box.south")), fits(360.0, F.col("box.east") - F.col("box.west")), F.lit(MOST_DEPTH - finer))
    rows, n = rows.withColumn("depth", (F.greatest(F.lit(0), start) + finer).cast("int")), F.pow(F.lit(2.0), "depth")
    # a little beyond the box, so that no point on its border is lost to rounding
    end = lambda v, least, side, by: F.greatest(F.lit(0), F.least(n - 1, F.floor((F.col(f"box.{v}") - least) / side * n + by))).cast("long")
    rows = rows.withColumns({"first_x": end("west", -180.0, 360.0, -1e-6), "last_x": end("east", -180.0, 360.0, 1e-6)})
    each = rows.withColumn("y", F.explode(F.sequence(end("south", -90.0, 180.0, -1e-6), end("north", -90.0, 180.0, 1e-6)))).drop("box").where("first_x <= last_x")
    r = cell_rect(F.col("depth"), F.col("first_x"), F.col("y"))
    return materialize(each.withColumn("edges", F.filter(_strip(F.col("edges"), r), lambda ring: F.size(ring) > 0)))


def _few(edges: Column) -> Column:
    return (F.size(edges) <= 1) & (F.size(F.flatten(edges)) <= SLOTS)


def _cells(rows: DataFrame) -> DataFrame:
    """Cells that meet their shape: the columns of their row, ``x``, ``inside`` where the shape holds all of them, and ``few`` where
    the slots hold the edges of their row; a slot without one has an edge far north of all points."""
    slots = {f"{end}{i}_{c}": F.coalesce(F.get("flat", F.lit(i))[end][c], F.lit(1e3)) for i in range(SLOTS) for end in "ab" for c in ("lng", "lat")}
    rows = rows.withColumns({"flat": F.flatten("edges"), "few": _few(F.col("edges"))}).withColumns(slots).drop("flat")
    cells = rows.withColumn("x", F.explode(F.sequence("first_x", "last_x"))).drop("first_x", "last_x")
    r = cell_rect(F.col("depth"), F.col("x"), F.col("y"))
    cells = cells.withColumns(dict(zip(("south", "west", "north", "east"), r, strict=True)))
    r, circle = Rect(*map(F.col, ("south", "west", "north", "east"))), F.col("radius_m").isNotNull()
    touched = F.transform("edges", lambda ring: F.exists(ring, lambda e: geometry._edge_meets_rect(e["a"], e["b"], r)))
    holding = F.transform("edges", lambda ring: _odd(ring, r.west, r.south))
    whole = F.exists(F.arrays_zip(touched.alias("t"), holding.alias("h")), lambda z: z["h"] & ~z["t"])
    corners = F.greatest(*[distance_m(F.col("lat"), F.col("lng"), a, b) for a in (r.south, r.north) for b in (r.west, r.east)])
    near = geometry.meets_circle(r, F.col("lat"), F.col("lng"), F.col("radius_m"))
    touch = reduce(lambda x, y: x | y, [geometry._edge_meets_rect(a, b, r) for a, b in _slots()])
    # 0: outside, 1: on the border, 2: inside
    of_circle = F.when(corners <= F.col("radius_m"), 2).when(near, 1).otherwise(0)
    of_few = F.when(touch, 1).when(_slots_odd(r.west, r.south), 2).otherwise(0)
    of_many = F.when(whole, 2).when(F.exists(touched, lambda t: t), 1).otherwise(0)
    # an array of one: a condition on the plain column would be pushed below it, and all of it worked out twice
    met = cells.withColumn("met", F.explode(F.array(F.when(circle, of_circle).when(F.col("few"), of_few).otherwise(of_many)))).where("met > 0")
    return met.withColumn("inside", F.col("met") == 2).drop("met", "south", "west", "north", "east")


def cover(shapes: DataFrame, finer: int = FINER) -> DataFrame:
    """``shape_id, depth, x, y, inside, edges, lat, lng, radius_m``: disjoint cells that cover each shape, all of them ``finer`` levels
    below those that its box fits in. A cell that the shape holds is ``inside``; the others are on its border and carry the
    edges that decide for their points."""
    cells = _cells(_rows(shapes, finer)).withColumn("edges", F.when(~F.col("inside"), F.col("edges")))
    return cells.select("shape_id", "depth", "x", "y", "inside", "edges", "lat", "lng", "radius_m")


def _in_circle(lng: Column, lat: Column, cos_lat: Column) -> Column:
    """Whether the distance to a circle's centre is within its radius. As ``x**2 - x**4 / 3 <= sin(x)**2 <= x**2``, the haversine lies
    between two sums of squares, and its sines are worked out only where these leave the answer open."""
    half = lambda a, b: (a - b) * (math.pi / 360) * ((a - b) * (math.pi / 360))
    a, b, scale = half(lat, F.col("lat")), half(lng, F.col("lng")), cos_lat * F.col("cos_centre")
    most = a + scale * b
    least = most - (a * a + scale * b * b) / 3
    exact = distance_m(F.col("lat"), F.col("lng"), lat, lng) <= F.col("radius_m")
    return F.when((scale >= 0) & (most <= F.col("within") * (1 - 1e-9)), True).when((scale >= 0) & (least > F.col("within") * (1 + 1e-9)), False).otherwise(F.coalesce(exact, F.lit(False)))


def points_in_shapes(points: DataFrame, shapes: DataFrame, finer: int = FINER) -> DataFrame:
    """Each row of ``points`` (``point_lat``, ``point_lng`` and more) with the ``shape_id`` of every shape that holds it.

    A point meets the cells it lies in, one a depth of the cover, by equality; a shape's cells are disjoint, so a match
    comes up once. Inside cells need no test, border cells one over the edges of their row: ray casting for rings, the
    distance for circles. Cells whose row has many edges are joined apart, as Spark doesn't compile their tests. The cover is
    broadcast while its boxes hold few cells, else both sides are shuffled by cell, in tasks of so many rows (few bytes make
    many pairs); a cell of very many points is dealt over several."""
    rows = _rows(shapes, finer)
    counted = rows.agg(F.collect_set("depth").alias("depths"), F.sum(F.col("last_x") - F.col("first_x") + 1).alias("cells"), F.bool_and(_few(F.col("edges"))).alias("few")).first()
    depths = sorted(counted["depths"])  # MOST_DEPTH values
    lat, lng = F.col("point_lat"), F.col("point_lng")
    if not depths:
        return points.join(shapes.select("shape_id"), F.lit(False))
    at = [F.struct(F.lit(d).alias("depth"), F.shiftright("cell_x", depths[-1] - d).alias("x"), F.shiftright("cell_y", depths[-1] - d).alias("y")) for d in depths]
    located = points.where(lat.isNotNull() & lng.isNotNull()).withColumns({"cell_x": cell_of(lng, -180.0, 360.0, depths[-1]), "cell_y": cell_of(lat, -90.0, 180.0, depths[-1]), "cos_lat": F.cos(F.radians(lat))})
    probes = located.withColumn("at", F.explode(F.array(*at))).select(*points.columns, "cos_lat", "at.depth", "at.x", "at.y")
    angle = F.least(F.col("radius_m") / (2 * EARTH_M), F.lit(math.pi / 2))
    cells = _cells(rows).withColumns({"cos_centre": F.cos(F.radians("lat")), "within": F.pow(F.sin(angle), F.lit(2.0))})
    plain, slots = ["shape_id", "depth", "x", "y", "inside", "lat", "lng", "radius_m"], [c for a, b in _slots() for c in (*a.values(), *b.values())]
    exact = F.when(F.col("radius_m").isNotNull(), _in_circle(lng, lat, F.col("cos_lat"))).otherwise(_slots_odd(lng, lat))
    sides = [(cells.where("few").select(*plain, "cos_centre", "within", *slots), exact)]
    if not counted["few"]:
        sides.append((cells.where("not few").select(*plain, "edges"), F.exists("edges", lambda ring: _odd(ring, lng, lat))))
    met = _meeting(probes, points.columns, [c for c, _ in sides], counted["cells"])
    return reduce(DataFrame.unionByName, [m.where(F.col("inside") | holds).select(*points.columns, "shape_id") for m, (_, holds) in zip(met, sides, strict=True)])


def _meeting(probes: DataFrame, columns: list[str], sides: list[DataFrame], most: int) -> list[DataFrame]:
    """``probes`` with the rows of each of ``sides`` in their cell; ``most``: the cells there may be."""
    on = ["depth", "x", "y"]
    if most <= BROADCAST_CELLS:
        return [probes.join(F.broadcast(c), on) for c in sides]
    crowded = materialize(probes.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > CELL_POINTS).select(*on, F.ceil(F.col("n") / CELL_POINTS).cast("long").alias("blocks")))
    tasks = min(2_000, 1 + (probes.count() + most) // ROWS_A_TASK)
    if not crowded.isEmpty():
        blocks, on = F.coalesce("blocks", F.lit(1)), [*on, "block"]
        probes = sized_join(probes, crowded, on[:3], "left").withColumn("block", F.pmod(F.xxhash64(*columns), blocks)).drop("blocks")
        sides = [sized_join(c, crowded, on[:3], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("blocks") for c in sides]
    # cells come first: what is read of a left row is read once for all points
    return [c.repartition(tasks, *on).join(probes.repartition(tasks, *on).hint("merge"), on) for c in sides]


def points_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """``points`` with the columns of every box (``south``, ``west``, ``north``, ``east``) that holds them, borders included.
    A box meets the four cells at most that it fits in."""
    fits = lambda whole, side: F.floor(F.log2(F.lit(whole) / F.greatest(side, F.lit(1e-6))))
    depth = F.greatest(F.lit(0), F.least(fits(180.0, F.col("north") - F.col("south")), fits(360.0, F.col("east") - F.col("west")), F.lit(MOST_DEPTH))).cast("int")
    deep = materialize(boxes.withColumn("depth", depth))
    depths = sorted(r["depth"] for r in deep.select("depth").distinct().collect())
    if not depths:
        return points.join(boxes, F.lit(False))
    lat, lng = F.col("point_lat"), F.col("point_lng")
    # a box's cells by the same rule as a point's
    corner = lambda c, least, side: reduce(lambda out, d: out.when(F.col("depth") == d, cell_of(F.col(c), least, side, d)), depths, F.when(F.lit(False), F.lit(0).cast("long")))
    cells = deep.withColumn("x", F.explode(F.sequence(corner("west", -180.0, 360.0), corner("east", -180.0, 360.0)))).withColumn("y", F.explode(F.sequence(corner("south", -90.0, 180.0), corner("north", -90.0, 180.0))))
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), cell_of(lng, -180.0, 360.0, d).alias("x"), cell_of(lat, -90.0, 180.0, d).alias("y")) for d in depths]))
    probes = points.where(lat.isNotNull() & lng.isNotNull()).withColumn("at", at).select(*points.columns, "at.depth", "at.x", "at.y")
    met = sized_join(probes, materialize(cells), ["depth", "x", "y"])
    return met.where(lat.between(F.col("south"), F.col("north")) & lng.between(F.col("west"), F.col("east"))).select(*points.columns, *boxes.columns)


#: A search answers with so many places at most, twenty to a page.
MOST_RESULTS, PAGE = geometry.FULL_RESULTS, 20


def searched(shapes: DataFrame, places: DataFrame, most: int = MOST_RESULTS, page: int = PAGE) -> DataFrame:
    """The adaptive search of every shape, a row a tile: ``shape_id, path, depth, south, west, north, east, results, pages,
    shared, step``.

    ``shapes``: as above with ``south, west, north, east`` of their box, the root tile; ``places``: ``place_id, rank, point_lat,
    point_lng``. A tile's search answers with the first ``most`` places in its rectangle by ``rank`` and id, and how many
    pages those take. :func:`geometry.next_step` decides by saturation, depth, the sides of its children and the share
    of its answer that its parent's had; a tile that goes on is replaced by the quadrants that meet the shape, and one
    without such quadrants is done.

    All tiles of a depth are searched together, so the rounds are as many as depths. Places meet the roots' rectangles by
    cells; from then on a place moves from a tile to its quadrants by comparing two coordinates, and only places of tiles
    that go on move. A tile's answer is the top of a window, which Spark cuts to ``most`` rows a task before the shuffle."""
    root = shapes.select("shape_id", F.lit("r").alias("path"), F.lit(0).alias("depth"), "south", "west", "north", "east")
    members = materialize(points_in_boxes(places, root).select("shape_id", "path", "place_id", "rank", "point_lat", "point_lng"))
    tiles, before, out = root, None, []
    for depth in range(geometry.MAX_DEPTH + 1):
        answer = materialize(_first(members, most))
        if before is None:
            seen = answer.withColumn("again", F.lit(False))
        else:
            parent = before.select("shape_id", F.col("path").alias("of"), "place_id", F.lit(True).alias("again"))
            seen = answer.withColumn("of", F.expr("left(path, length(path) - 1)")).join(parent, ["shape_id", "of", "place_id"], "left")
        counted = seen.groupBy("shape_id", "path").agg(F.count("*").alias("results"), F.count_if(F.coalesce("again", F.lit(False))).alias("both"))
        met = tiles.join(counted, ["shape_id", "path"], "left").withColumn("results", F.coalesce("results", F.lit(0)).cast("long"))
        met = met.withColumns({"pages": F.ceil(F.col("results") / page), "shared": F.when(F.lit(depth > 0) & (F.col("results") > 0), F.col("both") / F.col("results"))})
        rect = Rect(*map(F.col, ("south", "west", "north", "east")))
        judged = materialize(met.withColumn("step", geometry.next_step(F.col("results"), F.col("pages"), F.col("depth"), rect, F.col("shared"))).drop("both"))
        children = materialize(_children(judged.where("step = 'subdivide'"), shapes))
        parents = children.select("shape_id", F.expr("left(path, length(path) - 1)").alias("path"), F.lit(True).alias("goes_on")).distinct()
        done = judged.join(parents, ["shape_id", "path"], "left")
        out.append(done.withColumn("step", F.when((F.col("step") == "subdivide") & F.col("goes_on").isNull(), "done").otherwise(F.col("step"))).drop("goes_on"))
        if children.isEmpty():
            break
        moved = members.withColumnRenamed("path", "of").join(children.withColumn("of", F.expr("left(path, length(path) - 1)")), ["shape_id", "of"])
        moved = moved.where(F.col("point_lat").between(F.col("south"), F.col("north")) & F.col("point_lng").between(F.col("west"), F.col("east")))
        members = materialize(moved.select("shape_id", "path", "place_id", "rank", "point_lat", "point_lng"))
        tiles, before = children, answer
    columns = ["shape_id", "path", "depth", "south", "west", "north", "east", "results", "pages", "shared", "step"]
    return reduce(DataFrame.unionByName, [x.select(columns) for x in out])


def _first(members: DataFrame, most: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("shape_id", "path").orderBy("rank", "place_id")
    return members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("shape_id", "path", "place_id")


def _children(tiles: DataFrame, shapes: DataFrame) -> DataFrame:
    """The quadrants of ``tiles`` that meet their shape."""
    quarter: Callable[[bool, bool], Column] = lambda upper, right: F.struct(
        F.concat("path", F.lit(str(2 * upper + right))).alias("path"), (F.col("mid_lat") if upper else F.col("south")).alias("south"), (F.col("mid_lng") if right else F.col("west")).alias("west"),
        (F.col("north") if upper else F.col("mid_lat")).alias("north"), (F.col("east") if right else F.col("mid_lng")).alias("east"),
    )
    split = tiles.withColumns({"mid_lat": (F.col("south") + F.col("north")) / 2, "mid_lng": (F.col("west") + F.col("east")) / 2})
    four = split.withColumn("q", F.explode(F.array(*[quarter(u, r) for u in (False, True) for r in (False, True)]))).select("shape_id", (F.col("depth") + 1).alias("depth"), "q.*")
    j = four.join(shapes.select("shape_id", "rings", "lat", "lng", "radius_m"), "shape_id")
    rect = Rect(*map(F.col, ("south", "west", "north", "east")))
    meets = F.when(F.col("radius_m").isNotNull(), geometry.meets_circle(rect, F.col("lat"), F.col("lng"), F.col("radius_m"))).otherwise(geometry.meets_rings(rect, F.col("rings")))
    return j.where(meets).select("shape_id", "path", "depth", "south", "west", "north", "east")
