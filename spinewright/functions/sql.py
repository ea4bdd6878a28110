"""Functions and table functions for ``spark.sql``. Bodies are SQL, so Catalyst inlines them like any expression.

``register`` puts them in a session: ``distance_m``, ``fnv1a_32``, ``partition_of``, ``tile_key``, ``county_code``, ``score_band``,
``features_ok``, and the table functions ``quadrants_of``, ``plan_run_searches`` and ``places_transient_stats``, the last over the
views that :func:`transient_views` names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spinewright.functions.keys import EARTH_M

_HALF = "pow(sin(radians({b} - {a}) / 2), 2)"
# The fields of stored features by what they hold, the signals and the rules they may name.
_NUMBERS = ("name", "phone", "address", "distance", "cluster", "nameSim")
_FLAGS = ("city", "sab", "listingPhone", "listingLocation")
_SIGNALS = ("name", "phone", "address", "distance")
_RULES = ("phone_locality_name", "phone_locality_review", "over_25km", "sab_phone_city")
_IS_NUMBER = "rlike(schema_of_variant({v}), '^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)')"
_SCALARS = {
    "distance_m(lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE) RETURNS DOUBLE": f"""
        2 * {EARTH_M} * asin(sqrt(least(1.0D, {_HALF.format(a="lat1", b="lat2")} + cos(radians(lat1)) * cos(radians(lat2)) * {_HALF.format(a="lng1", b="lng2")})))
        * if(lat1 + lng1 + lat2 + lng2 IS NULL, NULL, 1)""",
    "fnv1a_32(text STRING) RETURNS BIGINT": """
        aggregate(filter(sequence(0, length(text)), i -> i > 0), 2166136261L, (h, i) -> ((h ^ ascii(substring(text, i, 1))) * 16777619L) & 4294967295L)""",
    "partition_of(cell_key STRING) RETURNS INT": "CAST(fnv1a_32(cell_key) % 4 AS INT)",
    "tile_key(unit_kind STRING, unit_id STRING, places_type STRING, path STRING) RETURNS STRING": "concat(unit_kind, ':', unit_id, '|', places_type, '|', path)",
    "county_code(code INT) RETURNS STRING": "lpad(CAST(code AS STRING), 3, '0')",
    "score_band(score INT) RETURNS STRING": "CASE WHEN score >= 95 THEN 'auto' WHEN score >= 80 THEN 'review' ELSE 'below' END",
    # an object of known fields only, each of its kind
    "features_ok(features STRING) RETURNS BOOLEAN": f"""
        CASE WHEN coalesce(left(schema_of_variant(try_parse_json(features)), 6) = 'OBJECT', false) THEN forall(map_entries(CAST(try_parse_json(features) AS MAP<STRING, VARIANT>)), e -> coalesce(CASE
          WHEN e.key IN {_NUMBERS} THEN {_IS_NUMBER.format(v="e.value")}
          WHEN e.key = 'distanceM' THEN {_IS_NUMBER.format(v="e.value")} OR schema_of_variant(e.value) = 'VOID'
          WHEN e.key = 'signals' THEN left(schema_of_variant(e.value), 5) = 'ARRAY' AND forall(try_variant_get(e.value, '$', 'array<variant>'), x -> schema_of_variant(x) = 'STRING' AND try_variant_get(x, '$', 'string') IN {_SIGNALS})
          WHEN e.key = 'rule' THEN schema_of_variant(e.value) = 'STRING' AND try_variant_get(e.value, '$', 'string') IN {_RULES}
          WHEN e.key IN {_FLAGS} THEN {_IS_NUMBER.format(v="e.value")} AND try_variant_get(e.value, '$', 'double') IN (0, 1)
          ELSE false END, false)) ELSE false END""",
}
_SEARCH = "tileKey STRING, cellKey STRING, clusterKey STRING, placesType STRING, kind STRING, depth INT, parentTileKey STRING, unitKind STRING, unitId STRING, quadPath STRING, south DOUBLE, west DOUBLE, north DOUBLE, east DOUBLE"
_TABLES = {
    "quadrants_of(path STRING, south DOUBLE, west DOUBLE, north DOUBLE, east DOUBLE) RETURNS TABLE (path STRING, south DOUBLE, west DOUBLE, north DOUBLE, east DOUBLE)": """
        SELECT concat(quadrants_of.path, CAST(q AS STRING)), if(q >= 2, (quadrants_of.south + quadrants_of.north) / 2, quadrants_of.south), if(q % 2 = 1, (quadrants_of.west + quadrants_of.east) / 2, quadrants_of.west),
               if(q >= 2, quadrants_of.north, (quadrants_of.south + quadrants_of.north) / 2), if(q % 2 = 1, quadrants_of.east, (quadrants_of.west + quadrants_of.east) / 2)
        FROM explode(array(0, 1, 2, 3)) AS t(q)""",
    # the rows a run adds; a search's id follows from run and tile, so planning again gives the same
    "plan_run_searches(run STRING, run_kind STRING, run_status STRING, searches STRING) RETURNS TABLE (search_id STRING, tile_key STRING, parent_tile_key STRING, depth INT)": f"""
        SELECT md5(concat(plan_run_searches.run, '|', s.tileKey)), s.tileKey, s.parentTileKey, s.depth
        FROM explode(CASE
          WHEN plan_run_searches.run_status IS NULL OR plan_run_searches.run_status NOT IN ('queued', 'running') THEN raise_error('plan_run_searches: run is not active')
          WHEN NOT coalesce(left(schema_of_variant(try_parse_json(plan_run_searches.searches)), 5) = 'ARRAY', false) THEN raise_error('plan_run_searches: searches must be a json array')
          WHEN exists(from_json(plan_run_searches.searches, 'array<struct<{_SEARCH}>>'), x -> x IS NULL OR x.tileKey IS NULL) THEN raise_error('plan_run_searches: each search needs a tileKey')
          WHEN exists(from_json(plan_run_searches.searches, 'array<struct<{_SEARCH}>>'), x -> NOT (x.kind <=> if(plan_run_searches.run_kind = 'change_check', 'ids_only', 'enterprise'))) THEN raise_error('plan_run_searches: search kind does not match the run')
          ELSE from_json(plan_run_searches.searches, 'array<struct<{_SEARCH}>>') END) AS t(s)""",
    "places_transient_stats(at TIMESTAMP) RETURNS TABLE (place_ids_held BIGINT, coordinates_held BIGINT, oldest_coordinate_ms BIGINT, expired_awaiting_purge BIGINT, oldest_expired_ms BIGINT, last_purge_ms BIGINT, last_rows_purged BIGINT)": """
        SELECT ids.n, co.held, co.oldest, co.expired, co.oldest_expired, p.last.ms, p.last.rows_purged
        FROM (SELECT count(*) AS n FROM (SELECT place_id FROM transient_members UNION SELECT place_id FROM transient_attachments)) ids
        CROSS JOIN (SELECT count_if(live) AS held, min(unix_millis(observed_at)) FILTER (WHERE live) AS oldest, count_if(NOT live) AS expired, min(unix_millis(expires_at)) FILTER (WHERE NOT live) AS oldest_expired
                    FROM (SELECT observed_at, expires_at, expires_at > places_transient_stats.at AS live FROM transient_coordinates)) co
        CROSS JOIN (SELECT max(struct(ran_at, purge_id, unix_millis(ran_at) AS ms, rows_purged)) AS last FROM transient_purges) p""",
}


def register(spark: SparkSession, tables: bool = True) -> None:
    """Make the functions known to the session. ``places_transient_stats`` needs its views, so it is left out where they are missing."""
    for signature, body in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    for signature, body in _TABLES.items() if tables else ():
        if not signature.startswith("places_transient_stats") or spark.catalog.tableExists("transient_purges"):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def transient_views(members: DataFrame, attachments: DataFrame, coordinates: DataFrame, purges: DataFrame) -> None:
    """Name what ``places_transient_stats`` reads: ``place_id``; ``place_id``; ``observed_at, expires_at``; ``purge_id, ran_at, rows_purged``."""
    for name, df in (("members", members), ("attachments", attachments), ("coordinates", coordinates), ("purges", purges)):
        df.createOrReplaceTempView(f"transient_{name}")
