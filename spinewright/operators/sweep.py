"""Planning a geographic sweep: cells with expected outlets, request ranges, quad-tree tiles, stored leaves, matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinewright.functions import keys


def apportioned(cells: DataFrame, parent: str, total: str, measured: str) -> DataFrame:
    """Adds ``expected``: a cell's measured count, or an equal share of what its parent's total leaves for the rest."""
    w = Window.partitionBy(parent)
    rest = F.greatest(F.lit(0), F.col(total) - F.coalesce(F.sum(measured).over(w), F.lit(0)))
    open_ = F.sum(F.when(F.col(measured).isNull(), 1).otherwise(0)).over(w)
    return cells.withColumn("expected", F.coalesce(F.col(measured).cast("long"), F.floor(rest / open_ + 0.5).cast("long")))


def request_range(types: Column) -> tuple[Column, Column]:
    """Requests of a cell with so many types: one a type at least; three pages of three tiles each at most."""
    return types.cast("long"), F.ceil(types * 9).cast("long")


def quadrants(tiles: DataFrame) -> DataFrame:
    """The four children of each tile ``path, south, west, north, east``: path digit 0 south-west, 1 south-east, 2 north-west, 3 north-east."""
    q = tiles.withColumns({"mid_lat": (F.col("south") + F.col("north")) / 2, "mid_lng": (F.col("west") + F.col("east")) / 2}).withColumn("q", F.explode(F.array(*map(F.lit, range(4)))))
    upper, right = F.col("q") >= 2, F.col("q") % 2 == 1
    return q.select(
        F.concat("path", F.col("q").cast("string")).alias("path"), F.when(upper, F.col("mid_lat")).otherwise(F.col("south")).alias("south"), F.when(right, F.col("mid_lng")).otherwise(F.col("west")).alias("west"),
        F.when(upper, F.col("north")).otherwise(F.col("mid_lat")).alias("north"), F.when(right, F.col("east")).otherwise(F.col("mid_lng")).alias("east"),
    )


def subdivided(points: DataFrame, root: tuple[float, float, float, float], saturated: int, depth: int) -> DataFrame:
    """All tiles with their point counts: a tile with ``saturated`` points or more is split, down to ``depth``; empty
    children never come up. ``root``: south, west, north, east.

    A point's deepest path is computed in its row, its tiles are that path's prefixes, and one aggregation counts them
    all. A tile comes up if all tiles above it are full, which is its parent being full, as counts only fall downwards.
    """
    south, west, north, east = root
    inside = points.where((F.col("lat") >= south) & (F.col("lat") < north) & (F.col("lng") >= west) & (F.col("lng") < east))
    start = F.struct(F.lit("r").alias("path"), *[F.lit(float(v)).alias(k) for k, v in zip(("south", "west", "north", "east"), root, strict=True)])

    def step(t: Column, _: Column) -> Column:
        mid_lat, mid_lng = (t["south"] + t["north"]) / 2, (t["west"] + t["east"]) / 2
        upper, right = F.col("lat") >= mid_lat, F.col("lng") >= mid_lng
        digit = F.when(upper, F.when(right, "3").otherwise("2")).otherwise(F.when(right, "1").otherwise("0"))
        return F.struct(
            F.concat(t["path"], digit).alias("path"), F.when(upper, mid_lat).otherwise(t["south"]).alias("south"), F.when(right, mid_lng).otherwise(t["west"]).alias("west"),
            F.when(upper, t["north"]).otherwise(mid_lat).alias("north"), F.when(right, t["east"]).otherwise(mid_lng).alias("east"),
        )

    deepest = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step)["path"] if depth else F.lit("r")
    # counted by the deepest path first, so the prefixes are those of tiles, not of points
    leaves = inside.groupBy(deepest.alias("leaf")).agg(F.count("*").alias("n"))
    tiles = leaves.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("leaf")), lambda i: F.substring("leaf", F.lit(1), i))).alias("path"))
    counted = tiles.groupBy("path").agg(F.sum("n").alias("points"))
    # a tile's parent and its children meet in one task: five rows at most
    family = counted.select("path", "points", F.explode(F.array(F.struct(F.col("path").alias("of"), F.lit(True).alias("parent")), F.struct(F.expr("left(path, length(path) - 1)").alias("of"), F.lit(False).alias("parent")))).alias("x"))
    above = F.max(F.when(F.col("x.parent"), F.col("points"))).over(Window.partitionBy("x.of"))
    placed = family.withColumn("above", above).where("not x.parent")
    return placed.where((F.col("path") == "r") | (F.col("above") >= saturated)).select("path", "points")


def shallowest(tiles: DataFrame) -> DataFrame:
    """Paths without a stored proper prefix: each path's prefixes are spelled out and anti-joined by equality."""
    prefixes = tiles.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("path") - 1, F.lit(1))), lambda i: F.substring("path", F.lit(1), i))).alias("prefix")).where(F.length("prefix") < F.length("path"))
    covered = prefixes.join(tiles.select(F.col("path").alias("prefix")).distinct(), "prefix", "left_semi").select("path").distinct()
    return tiles.join(covered, "path", "left_anti")


def decided(probes: DataFrame, probe: str, score: str, tie: str, attach: int, tentative: int) -> DataFrame:
    """Each probe's best match: attached at ``attach`` or more, tentative at ``tentative``, else unmatched. If a second one
    reaches ``attach`` too, neither is attached: the best is tentative and ``tied`` names the second.

    The two best come from one pass over the rows, so that what makes them runs once: each task keeps a probe's two first."""
    rank = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))
    first = probes.select(probe, rank.alias("x")).withColumn("r", F.dense_rank().over(Window.partitionBy(probe).orderBy("x"))).where("r <= 2")
    two = first.groupBy(probe).agg(F.min("x").alias("b"), F.min(F.when(F.col("r") == 2, F.col("x"))).alias("n"))
    two = two.select(probe, F.col("b.t").alias("best"), (-F.col("b.s")).alias(score), F.when(-F.col("n.s") >= attach, F.col("n.t")).alias("tied"))
    outcome = F.when((F.col(score) >= attach) & F.col("tied").isNull(), "attached").when(F.col(score) >= tentative, "tentative").otherwise("unmatched")
    return two.select(probe, "best", score, "tied", outcome.alias("outcome"))


def versioned(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


# Country names that end an address outside the area.
FOREIGN = ("mexico", "méxico", "canada", "guatemala", "belize", "honduras", "el salvador", "nicaragua", "costa rica", "panama", "panamá", "cuba")
REFERENCE_MILES = 25


def out_of_area(address: Column) -> Column:
    """Whether an address ends in a foreign country's name, its letters composed or not; no address says nothing."""
    tail = F.trim(F.element_at(F.split(F.trim(address), ","), -1))
    return F.coalesce(keys.fold(F.lower(tail)).isin(*{keys.plain(c) for c in FOREIGN}), F.lit(False))


def service_area_score(fallback: Column, same_phone: Column, same_city: Column, similarity: Column) -> Column:
    """The score of a listing without a storefront: 95 by phone, city and name, else ``fallback`` up to 94."""
    sure = F.coalesce(same_phone & same_city & (similarity >= 0.6), F.lit(False))
    return F.when(sure, 95).otherwise(F.least(fallback, F.lit(94)))


def expected_outlets(cells: DataFrame, counts: DataFrame, statewide: DataFrame, counties: int) -> DataFrame:
    """Cells ``cluster, unit, county, share, miles`` with ``exact`` and ``expected`` outlets.

    A county has its measured count (``counts``: county, cluster, outlets) or an equal part of what the measured ones
    leave of the state's (``statewide``: cluster, outlets). A city has its ``share`` of its county; a radius its square
    against 25 miles, a whole county at most. An unknown cluster gives null, never zero."""
    measured = counts.groupBy("cluster").agg(F.sum("outlets").alias("known"), F.count("*").alias("n"))
    part = statewide.join(measured, "cluster", "left").select("cluster", F.try_divide(F.col("outlets") - F.coalesce("known", F.lit(0)), F.lit(counties) - F.coalesce("n", F.lit(0))).alias("part"))
    j = cells.join(counts.select("county", "cluster", "outlets"), ["county", "cluster"], "left").join(part, "cluster", "left")
    ratio = F.when(F.col("miles").isNotNull(), F.least(F.lit(1.0), F.pow(F.col("miles") / REFERENCE_MILES, 2))).otherwise(F.coalesce("share", F.lit(1.0)))
    exact = F.coalesce(F.col("outlets").cast("double"), F.col("part")) * ratio
    return j.select(*cells.columns, exact.alias("exact"), F.floor(exact + 0.5).cast("long").alias("expected"))


def cost_range(searches: Column, used: Column, remaining: Column, price: int = 35_000, free: int = 1_000) -> dict[str, Column]:
    """Requests and micro-dollars of so many type searches, low and high, and the high cost's percentage of what remains."""
    left = F.greatest(F.lit(0), F.lit(free) - used)
    low, high = request_range(searches)
    cost = lambda n: (F.greatest(F.lit(0), n - left) * price).cast("long")
    percent = F.when(remaining > 0, F.try_divide(100 * cost(high), remaining)).when(cost(high) > 0, 100.0).otherwise(0.0)
    return {"requests_low": low, "requests_high": high, "micros_low": cost(low), "micros_high": cost(high), "percent_high": percent}


def admitted(runs: DataFrame, now: Column) -> DataFrame:
    """Adds ``state`` to runs (``run_id, org, status, queued_at, started_at, heartbeat``): a queued run of over 15 minutes has
    never_started, a running one silent for 30 is abandoned, and of an org's other live runs only the oldest is admitted."""
    age = lambda c: F.unix_micros(now) - F.unix_micros(c.cast("timestamp"))
    lost = (F.when((F.col("status") == "queued") & (age(F.col("queued_at")) > 15 * 60_000_000), "never_started")
            .when((F.col("status") == "running") & (age(F.coalesce("heartbeat", "started_at")) > 30 * 60_000_000), "abandoned"))
    live = F.col("status").isin("queued", "running") & F.col("lost").isNull()
    r = runs.withColumn("lost", lost)
    first = r.where(live).groupBy("org").agg(F.min(F.struct("queued_at", "run_id"))["run_id"].alias("first"))
    state = F.coalesce("lost", F.when(live, F.when(F.col("run_id") == F.col("first"), "admitted").otherwise("refused")), "status")
    return r.join(first, "org", "left").withColumn("state", state).drop("lost", "first")


def root_tiles(cells: DataFrame, types: DataFrame) -> DataFrame:
    """A root tile for each cell (``cluster, unit_kind, unit``) and search type of its cluster (``cluster, type``), each key once."""
    key = F.concat(F.col("unit_kind"), F.lit(":"), F.replace("unit", F.lit("\0"), F.lit("/")), F.lit("|"), F.col("type"), F.lit("|r"))
    return cells.join(types, "cluster").withColumn("tile_key", key).dropDuplicates(["tile_key", "cluster"])


def cells_of_week(cells: DataFrame, key: str, week: int, partitions: int = 4) -> DataFrame:
    """The cells whose turn it is: a cell's part follows from a hash of its key, and the parts take turns by week."""
    return cells.where(F.pmod(keys.fnv1a32(F.col(key)), F.lit(partitions)) == week % partitions)
