"""Queries of JSON records, lists and maps, and of the functions for ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinewright.core import read
from spinewright.functions import records, sql
from spinewright.functions.keys import EARTH_M

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(text: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLES[f.__name__] = f, text
        return f

    return add


_DOC = """'{"id": ' || event_id || ', "props": ' || props || ', "' || event_type || '": "' || event_type || '", "even": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "none": null, "list": [' || event_id % 3 || ', "x"], "part": ' || event_id % 7 || '.5}'"""


def _doc() -> Column:
    return F.expr(_DOC)


@query(f"""WITH d AS (SELECT event_id, ({_DOC})::JSON AS doc FROM events), k AS (SELECT event_id, doc, unnest(json_keys(doc)) AS key FROM d), v AS (SELECT event_id, key, json_extract(doc, '$."' || key || '"') AS v FROM k)
SELECT key, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type,
  count(*) AS rows, count(DISTINCT CASE WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN v ->> '$' END) AS "values" FROM v GROUP BY 1, 2""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", _doc().alias("doc"))
    plain = F.when(~F.col("type").isin("object", "array", "null"), F.col("value"))
    return records.each_field(e, "doc", ["event_id"]).groupBy("key", "type").agg(F.count("*").alias("rows"), F.countDistinct(plain).alias("values"))


@query("""SELECT user_id, event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE user_id % 3 > 0""")
def json_record_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("user_id % 3 > 0")
    record = F.struct("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    arrays = e.groupBy("user_id").agg(F.to_json(F.collect_list(record)).alias("records"))
    return records.record_set(arrays, "records", "event_id bigint, event_type string, k bigint", ["user_id"])


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'patched' WHEN 1 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 3 = 0 THEN 1.5::DOUBLE ELSE value END AS value, user_id FROM events""")
def json_populate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    patch = F.when(F.col("event_id") % 3 == 0, '{"kind": "patched", "value": 1.5, "other": 1}').when(F.col("event_id") % 3 == 1, '{"kind": null}')
    base = F.struct(F.col("event_type").alias("kind"), "value", "user_id")
    return e.select("event_id", records.populated(base, patch, [("kind", "string"), ("value", "double"), ("user_id", "bigint")]).alias("r")).select("event_id", "r.*")


@query("""SELECT user_id, event_type, count(*) AS n, count(*) FILTER (event_id % 2 = 1) > 0 AS late_known FROM events GROUP BY 1, 2""")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counts by type of the two halves of the events, added up, and the later half's laid over the earlier one's
    counts = read(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 2).alias("half"), "event_type").agg(F.count("*").alias("n"))
    entries = lambda half: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("half") == half, F.struct("event_type", "n")))))
    maps = counts.groupBy("user_id").agg(entries(0).alias("early"), entries(1).alias("late"))
    flags = lambda m, v: F.transform_values(m, lambda k, n: F.lit(v))
    both = maps.select("user_id", records.overlaid(flags("early", False), flags("late", True)).alias("known"), F.explode(records.added(F.col("early"), F.col("late"))).alias("event_type", "n"))
    return both.select("user_id", "event_type", "n", F.element_at("known", F.col("event_type")).alias("late_known"))


@query("""SELECT event_id, 2 - (event_id % 4 = 0)::INT AS n, event_type || CASE WHEN event_id % 4 > 0 THEN ' k' ELSE '' END AS listed FROM events""")
def list_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    raw = F.array(F.lit(""), F.col("event_type"), F.lit("  "), F.when(F.col("event_id") % 4 > 0, "k"), F.lit(None).cast("string"))
    clean = records.only_once(records.present(raw))
    return e.select("event_id", F.size(clean).alias("n"), F.array_join(clean, " ").alias("listed"))


_CELL = "s_name || '|' || s_nationkey"
_AT = "29.0::DOUBLE + s_suppkey % 40 / 100.0::DOUBLE AS a, -96.0::DOUBLE + s_suppkey % 30 / 100.0::DOUBLE AS o"


@query(f"""WITH s AS (SELECT *, {_AT} FROM supplier)
SELECT s_suppkey, round(2 * {EARTH_M}::DOUBLE * asin(sqrt(least(1, power(sin(radians(29.2::DOUBLE - a) / 2), 2) + cos(radians(a)) * cos(radians(29.2::DOUBLE)) * power(sin(radians(-95.9::DOUBLE - o) / 2), 2)))), 3) AS metres,
  (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({_CELL}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) % 4)::INT AS part,
  'city:' || s_name || '|shop|r' || s_suppkey % 4 AS tile, lpad((s_suppkey % 254)::VARCHAR, 3, '0') AS county,
  CASE WHEN s_suppkey % 100 >= 95 THEN 'auto' WHEN s_suppkey % 100 >= 80 THEN 'review' ELSE 'below' END AS band, s_suppkey % 6 < 2 AS features_ok FROM s""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    read(spark, sf_dir, "supplier").createOrReplaceTempView("sql_suppliers")
    features = """CASE s_suppkey % 6 WHEN 0 THEN '{"name": 40, "signals": ["name", "phone"], "city": 1}' WHEN 1 THEN '{"rule": "over_25km", "distanceM": null}'
      WHEN 2 THEN '{"signals": ["name", "other"]}' WHEN 3 THEN '{"name": "40"}' WHEN 4 THEN '["name"]' ELSE '{"sab": 2}' END"""
    return spark.sql(f"""SELECT s_suppkey, round(distance_m(29.0D + s_suppkey % 40 / 100.0D, -96.0D + s_suppkey % 30 / 100.0D, 29.2D, -95.9D), 3) AS metres, partition_of({_CELL}) AS part,
      tile_key('city', s_name, 'shop', 'r' || s_suppkey % 4) AS tile, county_code(CAST(s_suppkey % 254 AS INT)) AS county, score_band(CAST(s_suppkey % 100 AS INT)) AS band, features_ok({features}) AS features_ok FROM sql_suppliers""")


@query("""SELECT n_nationkey, md5('run' || n_nationkey || '|t' || i) AS search_id, 't' || i AS tile_key, CASE WHEN i > 0 THEN 't0' END AS parent_tile_key, (i > 0)::INT AS depth
FROM nation, (SELECT unnest(generate_series(0, 3)) AS i) WHERE i <= n_nationkey % 4""")
def sql_planned_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    search = lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("tileKey"), F.lit("enterprise").alias("kind"), F.when(i > 0, 1).otherwise(0).alias("depth"), F.when(i > 0, "t0").alias("parentTileKey"))
    runs = read(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.transform(F.sequence(F.lit(0), (F.col("n_nationkey") % 4).cast("int")), search)).alias("searches"))
    runs.createOrReplaceTempView("sql_runs")
    return spark.sql("SELECT n_nationkey, p.* FROM sql_runs, LATERAL plan_run_searches(concat('run', n_nationkey), 'sweep', 'running', searches) p")


@query("""SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 UNION SELECT p_partkey FROM part WHERE p_size < 5)) AS place_ids_held, count(*) FILTER (d > t) AS coordinates_held,
  min(epoch_ms(o)) FILTER (d > t) AS oldest_coordinate_ms, count(*) FILTER (d <= t) AS expired_awaiting_purge, min(epoch_ms(d)) FILTER (d <= t) AS oldest_expired_ms,
  (SELECT max(epoch_ms(o_orderdate)) FROM orders) AS last_purge_ms, (SELECT arg_max(o_custkey, (o_orderdate, o_orderkey)) FROM orders) AS last_rows_purged
FROM (SELECT l_shipdate::TIMESTAMP AS o, l_shipdate::TIMESTAMP + INTERVAL 30 DAY AS d, TIMESTAMP '1997-06-01' AS t FROM lineitem)""")
def sql_transient_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    seen = F.col("l_shipdate").cast("timestamp")
    sql.transient_views(
        li.where("l_linenumber = 1").select(F.col("l_partkey").alias("place_id")), read(spark, sf_dir, "part").where("p_size < 5").select(F.col("p_partkey").alias("place_id")),
        li.select(seen.alias("observed_at"), (seen + F.expr("interval 30 days")).alias("expires_at")), o.select(F.col("o_orderkey").alias("purge_id"), F.col("o_orderdate").cast("timestamp").alias("ran_at"), F.col("o_custkey").alias("rows_purged")),
    )
    sql.register(spark)
    return spark.sql("SELECT * FROM places_transient_stats(TIMESTAMP '1997-06-01 00:00:00')")
