"""External listings: candidates for a probe, changes of a tile, checks of what is stored, single geocodes, closing of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinewright.core import materialize, sized_join
from spinewright.functions import keys
from spinewright.operators.resolve import NAME_SIMILARITY, live, score, sides
from spinewright.operators.sweep import decided, service_area_score

# Half the box of the proximity arm in degrees, and the most candidates of an arm.
BOX_LAT, BOX_LNG = 0.00135, 0.0015
NEAREST, OTHERS = 5, 10
#: Rows of a cell that the proximity arm meets at first, by how much more each time while these don't settle a place, and
#: the places of one task.
SHOWN, MORE, PLACES = 64, 16, 5_000
# A listing is full at so many results or pages.
FULL_RESULTS, FULL_PAGES = 60, 3


def _first(rows: DataFrame, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def similar_names(probes: DataFrame, names: DataFrame, threshold: float = NAME_SIMILARITY) -> DataFrame:
    """``area, probe, name, similarity`` of distinct ``area, probe`` and ``area, name``.

    A name that is similar enough holds at least a ``threshold`` of the probe's grams, so one of the probe's rarest
    n - ceil(t n) + 1 is among the name's: an equi-join on these, then the exact similarity.
    """
    # written first: an explode's filter on its array would else be pushed below distinct, to grams of every row
    p, n = materialize(probes.distinct().withColumn("pg", keys.trigrams(F.col("probe")))), materialize(names.distinct().withColumn("ng", keys.trigrams(F.col("name"))))
    index = n.select("area", "name", "ng", F.explode("ng").alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("often"))
    grams = p.select("area", "probe", "pg", F.explode("pg").alias("gram")).join(often, "gram")
    rare = grams.withColumn("r", F.row_number().over(Window.partitionBy("area", "probe").orderBy("often", "gram"))).where(F.col("r") <= F.size("pg") - F.ceil(threshold * F.size("pg")) + 1)
    met = rare.join(index, ["area", "gram"]).withColumn("similarity", F.round(keys.gram_similarity(F.col("pg"), F.col("ng")), 6)).where(F.col("similarity") >= threshold)
    return met.select("area", "probe", "name", "similarity").distinct()


def probe_candidates(probes: DataFrame, businesses: DataFrame, city: str | None = None) -> DataFrame:
    """``idx, id, name_similarity``: the businesses that any arm finds for a probe, each once.

    ``probes``: ``idx, name_norm, phone, postal, street_num, lat, lng, sab``; ``businesses``: ``id, name_norm, phone, blockable, postal,
    street_num, lat, lng, city``. Arms: phone; address and place for probes with a storefront; similar names of the
    postal area, or of ``city`` for service-area probes (``sab``). An arm gives ``OTHERS`` by id, the names ``NEAREST`` by
    similarity. Keys that many businesses share are cut to what an arm can give before the join. Merged-away businesses
    are no candidates; a tenant's probes and businesses are passed without those of others. Cells of the proximity arm are as
    small as its box, so a cell holds what stands within some 150 m.
    """
    c, found = F.col, _found(probes, businesses, city)
    grams = lambda rows, key, name: rows.select(key, keys.gram_codes(keys.trigrams(c("name_norm"))).alias(name))
    sides = found.join(grams(probes, "idx", "pg"), "idx").join(grams(live(businesses), "id", "bg"), "id")
    return sides.select("idx", "id", F.round(F.coalesce(keys.gram_similarity(c("pg"), c("bg")), F.lit(0.0)), 6).alias("name_similarity"))


def _found(probes: DataFrame, businesses: DataFrame, city: str | None) -> DataFrame:
    """``idx, id`` of :func:`probe_candidates`."""
    c, b = F.col, live(businesses)
    front = probes.where(~c("sab"))
    by_phone = _first(b.where(c("blockable") & c("phone").isNotNull()).select("phone", "id"), ["phone"], ["id"], OTHERS)
    by_address = _first(b.where("postal is not null and street_num is not null").select("postal", "street_num", "id"), ["postal", "street_num"], ["id"], OTHERS)
    arms = [probes.select("idx", "phone").join(by_phone, "phone").select("idx", "id"), front.select("idx", "postal", "street_num").join(by_address, ["postal", "street_num"]).select("idx", "id")]

    area = F.when(~c("sab"), F.concat(F.lit("p"), "postal")).otherwise(F.lit(None if city is None else f"c{city}"))
    asked = probes.where("name_norm is not null").select("idx", area.alias("area"), c("name_norm").alias("probe")).where("area is not null")
    inside = [b.select("id", c("name_norm").alias("name"), F.concat(F.lit("p"), "postal").alias("area"))]
    if city is not None:
        inside.append(b.where(F.lower("city") == city).select("id", c("name_norm").alias("name"), F.lit(f"c{city}").alias("area")))
    named = reduce(DataFrame.unionByName, inside).where("name is not null and area is not null")
    best = similar_names(asked.select("area", "probe"), named.select("area", "name")).join(_first(named, ["area", "name"], ["id"], NEAREST), ["area", "name"])
    best = _first(best, ["area", "probe"], [F.desc("similarity"), "id"], NEAREST)
    arms.append(asked.join(best, ["area", "probe"]).select("idx", "id"))

    arms.append(front.select("idx", c("lat").alias("p_lat"), c("lng").alias("p_lng")).join(_nearby(front, b), ["p_lat", "p_lng"]).select("idx", "id"))
    return reduce(DataFrame.unionByName, arms).distinct()


def _nearby(probes: DataFrame, businesses: DataFrame) -> DataFrame:
    """``p_lat, p_lng, id``: the first ``OTHERS`` businesses by id in the box around each distinct place of the probes.

    Businesses at one place are cut to what an arm can give before any pair is formed, and probes at one place ask once,
    so a building that holds a third of all rows costs a few pairs. A place meets only the first rows by id of the cells
    around it; of a cell that has more, the next row stands for all that isn't shown, in the box or not. If it is not among the
    first ``OTHERS``, no row behind it is either and the place is settled; else the place asks again and is shown more."""
    c = F.col
    cell = lambda x, d: F.floor(F.col(x) / d).cast("long")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("s")
    inside = c("lat").between(c("p_lat") - BOX_LAT, c("p_lat") + BOX_LAT) & c("lng").between(c("p_lng") - BOX_LNG, c("p_lng") + BOX_LNG)
    asked = materialize(probes.where("lat is not null and lng is not null").select(c("lat").alias("p_lat"), c("lng").alias("p_lng")).distinct())
    places = _first(businesses.where("lat is not null and lng is not null").select("lat", "lng", "id"), ["lat", "lng"], ["id"], OTHERS)
    places = materialize(places.select("id", "lat", "lng", cell("lat", BOX_LAT).alias("x"), cell("lng", BOX_LNG).alias("y")))
    settled, shown = [], SHOWN
    while True:
        rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
        head = materialize(places.withColumn("r", rank).where(c("r") <= shown + 1).withColumn("hidden", c("r") > shown).drop("r"))
        at = asked.repartition(1 + asked.count() // PLACES, "p_lat", "p_lng").select("p_lat", "p_lng", around)
        at = at.select("p_lat", "p_lng", (cell("p_lat", BOX_LAT) + c("s.i")).alias("x"), (cell("p_lng", BOX_LNG) + c("s.j")).alias("y"))
        near = sized_join(at, head, ["x", "y"]).where(c("hidden") | inside).select("p_lat", "p_lng", "id", "hidden")
        first = materialize(_first(near, ["p_lat", "p_lng"], ["id"], OTHERS))
        asked = materialize(first.where("hidden").select("p_lat", "p_lng").distinct())
        settled.append(first.join(asked, ["p_lat", "p_lng"], "left_anti").select("p_lat", "p_lng", "id"))
        if asked.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        shown *= MORE


def matched(probes: DataFrame, businesses: DataFrame, city: str | None = None, attach: int = 90, tentative: int = 80, same_row: bool = False) -> DataFrame:
    """``probe, best, score, tied, outcome`` of every probe with a candidate: found by the arms, scored, decided.

    Both tables have the columns of a business; probes also ``idx`` and ``sab``. A listing with a storefront is scored like a pair of
    businesses; a service-area one by phone, city and name, else by the same score, up to 94. ``same_row`` leaves out a
    probe's own row where both tables are one."""
    found = _found(probes, businesses, city).select(F.col("idx").alias("left_id"), F.col("id").alias("right_id"))
    found = materialize(found.where("left_id <> right_id") if same_row else found)
    # the arms name the first few of a key, so the businesses found are far fewer than all, and mostly few enough to be broadcast
    known = materialize(businesses.join(found.select(F.col("right_id").alias("id")).distinct(), "id", "left_semi"))
    scored = score(sides(found, probes.withColumn("id", F.col("idx")), known, ["sab"], ["city"]))
    same_phone, same_city = F.coalesce(F.col("l_phone") == F.col("r_phone"), F.lit(False)), F.lower("r_city") == F.lit(city)
    final = F.when(F.col("l_sab"), service_area_score(F.col("score"), same_phone, same_city, F.col("name_similarity"))).otherwise(F.col("score")).cast("long")
    return decided(scored.select(F.col("left_id").alias("probe"), F.col("right_id").alias("other"), final.alias("score")), "probe", "score", "other", attach, tentative)


def tile_changes(stored: DataFrame, seen: DataFrame, listings: DataFrame) -> DataFrame:
    """``tile, verdict, added, gone`` of every listing (``tile, results, pages, checked``) against the ``stored`` members (``tile, member``).

    A full listing is saturated whatever else it shows, and proves nobody gone; a tile never checked is a baseline.
    """
    s, n = stored.select("tile", "member").distinct().withColumn("s", F.lit(1)), seen.select("tile", "member").distinct().withColumn("n", F.lit(1))
    known = F.col("s").isNotNull() & F.col("checked")
    j = listings.join(s.join(n, ["tile", "member"], "full"), "tile", "left").groupBy("tile", "results", "pages", "checked")
    counted = j.agg(F.count_if(F.col("n").isNotNull() & ~known).alias("added"), F.count_if(known & F.col("n").isNull()).alias("missing"))
    full = (F.col("results") >= FULL_RESULTS) | (F.coalesce("pages", F.lit(0)) >= FULL_PAGES)
    verdict = (F.when(full, "saturated").when(~F.col("checked"), "baseline").when((F.col("added") > 0) & (F.col("missing") > 0), "both")
               .when(F.col("added") > 0, "new").when(F.col("missing") > 0, "gone").otherwise("unchanged"))
    return counted.select("tile", verdict.alias("verdict"), "added", F.when(full, 0).otherwise(F.col("missing")).cast("long").alias("gone"))


def tile_parts(key: Column) -> Column:
    """``struct(unit_kind, unit, type, path)`` of a tile key ``kind:unit|type|path``; null if it has another shape."""
    pattern = r"^([a-z_]+):([^|]*)\|([^|]*)\|(r[0-3]*)$"
    parts = F.struct(*[F.regexp_extract(key, pattern, i).alias(n) for i, n in enumerate(("unit_kind", "unit", "type", "path"), 1)])
    return F.when(key.rlike(pattern), parts)


# What may be stored of a match.
_POINTS = ["name", "phone", "address", "distance", "cluster"]
_FLAGS = ["city", "sab", "listingPhone", "listingLocation"]
_SIGNALS = ["name", "phone", "address", "distance"]
_RULES = ["phone_locality_name", "phone_locality_review", "over_25km", "sab_phone_city"]


def refused_feature(features: Column, memory_only: list[str] | None = None) -> Column:
    """The first key, by name, of a JSON object of features that may not be stored; ``features`` itself if it is no object; else null.

    Points are whole numbers, flags 0 or 1, signals and rules come from fixed lists; ``memory_only`` keys are skipped.
    """
    values = F.from_json(F.when(F.trim(features).startswith("{"), features), "map<string,string>")
    one_of = lambda names: "(?:" + "|".join(names) + ")"
    allowed = {**dict.fromkeys(_POINTS, r"^-?[0-9]+$"), **dict.fromkeys(_FLAGS, "^[01]$"), "signals": rf'^\[(?:"{one_of(_SIGNALS)}"(?:,"{one_of(_SIGNALS)}")*)?\]$', "rule": f"^{one_of(_RULES)}$"}
    fits = lambda e: reduce(lambda w, x: w.when(e["key"] == x[0], F.coalesce(e["value"].rlike(x[1]), F.lit(False))), allowed.items(), F.when(e["key"].isin(memory_only or []), True)).otherwise(False)
    bad = F.array_sort(F.transform(F.filter(F.map_entries(values), lambda e: ~fits(e)), lambda e: e["key"]))
    return F.when(values.isNull(), "features").otherwise(F.try_element_at(bad, F.lit(1)))


_MATCHES = "result struct<addressMatches: array<struct<matchedAddress: string, coordinates: struct<x: double, y: double>, geographies: struct<Counties: array<struct<GEOID: string, NAME: string, STATE: string>>>>>>"


def geocoded_county(response: Column, state: str = "48") -> Column:
    """``struct(lat, lng, county_fips, county_name, matched_address, failure_reason)`` of a one-line geocoder's JSON.

    ``x`` is the longitude. Reasons: unreachable (no response), bad_shape, no_match, not_texas.
    """
    matches = F.from_json(response, _MATCHES)["result"]["addressMatches"]
    first = F.try_element_at(matches, F.lit(1))
    county = F.try_element_at(first["geographies"]["Counties"], F.lit(1))
    whole = first["matchedAddress"].isNotNull() & first["coordinates"]["x"].isNotNull() & first["coordinates"]["y"].isNotNull() & county["GEOID"].isNotNull() & county["NAME"].isNotNull() & county["STATE"].isNotNull()
    reason = F.when(response.isNull(), "unreachable").when(matches.isNull(), "bad_shape").when(F.size(matches) == 0, "no_match").when(~F.coalesce(whole, F.lit(False)), "bad_shape").when(county["STATE"] != state, "not_texas")
    ok = lambda v, name: F.when(reason.isNull(), v).alias(name)
    return F.struct(ok(first["coordinates"]["y"], "lat"), ok(first["coordinates"]["x"], "lng"), ok(county["GEOID"], "county_fips"), ok(county["NAME"], "county_name"), ok(first["matchedAddress"], "matched_address"), reason.alias("failure_reason"))


def closed_out(abandoned: DataFrame, searches: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger after abandoned runs (``run_id``) are closed, and each one's ``cost``.

    ``searches``: ``run_id, request_id, micros``, the request being null when none was in flight; ``ledger``: ``request_id, run_id,
    micros``. A request in flight is settled as charged unless the ledger has it, so a rerun adds nothing.
    """
    flying = searches.where("request_id is not null").join(abandoned.select("run_id"), "run_id", "left_semi").join(ledger.select("request_id"), "request_id", "left_anti")
    settled = flying.groupBy("request_id").agg(F.min(F.struct("run_id", "micros")).alias("s")).select("request_id", "s.run_id", "s.micros")
    after = ledger.select("request_id", "run_id", "micros").unionByName(settled)
    cost = abandoned.select("run_id").join(after.groupBy("run_id").agg(F.sum("micros").alias("cost")), "run_id", "left").na.fill(0, ["cost"])
    return after, cost
