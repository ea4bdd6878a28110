"""Listing queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinewright.core import read
from spinewright.operators import listings
from spinewright.plans.resolve_queries import _BIZ, businesses

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: The arms of a probe's candidates, up to their union ``u``.
LISTING_ARMS = f"""WITH {_BIZ}, p AS MATERIALIZED (SELECT id AS idx, name_norm, phone, postal, street_num, lat, lng, id % 5 = 0 AS sab FROM biz),
a1 AS (SELECT idx, id, p.name_norm AS pn, b.name_norm AS bn, row_number() OVER (PARTITION BY idx ORDER BY id) AS r FROM p JOIN biz b ON b.phone = p.phone AND b.blockable),
a2 AS (SELECT idx, id, p.name_norm AS pn, b.name_norm AS bn, row_number() OVER (PARTITION BY idx ORDER BY id) AS r FROM p JOIN biz b ON b.postal = p.postal AND b.street_num = p.street_num WHERE NOT sab),
a3 AS (SELECT idx, id, p.name_norm AS pn, b.name_norm AS bn, row_number() OVER (PARTITION BY idx ORDER BY sim DESC, id) AS r FROM p JOIN biz b ON CASE WHEN sab THEN lower(b.postal) = 'brand#11' ELSE b.postal = p.postal END JOIN sims s ON s.a = p.name_norm AND s.b = b.name_norm WHERE sim >= 0.45),
a4 AS (SELECT idx, id, p.name_norm AS pn, b.name_norm AS bn, row_number() OVER (PARTITION BY idx ORDER BY id) AS r FROM
  (SELECT *, floor(lat / 0.00135::DOUBLE)::BIGINT + i AS y, floor(lng / 0.0015::DOUBLE)::BIGINT + j AS x FROM p, (VALUES (-1), (0), (1)) v(i), (VALUES (-1), (0), (1)) w(j) WHERE NOT sab) p
  JOIN (SELECT *, floor(lat / 0.00135::DOUBLE)::BIGINT AS y, floor(lng / 0.0015::DOUBLE)::BIGINT AS x FROM biz) b ON b.x = p.x AND b.y = p.y AND b.lat BETWEEN p.lat - 0.00135::DOUBLE AND p.lat + 0.00135::DOUBLE AND b.lng BETWEEN p.lng - 0.0015::DOUBLE AND p.lng + 0.0015::DOUBLE),
u AS MATERIALIZED (SELECT idx, id, pn, bn FROM a1 WHERE r <= 10 UNION SELECT idx, id, pn, bn FROM a2 WHERE r <= 10 UNION SELECT idx, id, pn, bn FROM a3 WHERE r <= 5 UNION SELECT idx, id, pn, bn FROM a4 WHERE r <= 10)"""


@query(f"""{LISTING_ARMS}
SELECT idx, id, sim AS name_similarity FROM u JOIN sims ON a = pn AND b = bn""")
def listing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = businesses(spark, sf_dir).withColumn("city", F.col("postal"))
    probes = b.select(F.col("id").alias("idx"), "name_norm", "phone", "postal", "street_num", "lat", "lng", (F.col("id") % 5 == 0).alias("sab"))
    return listings.probe_candidates(probes, b, "brand#11")


@query("""WITH s AS (SELECT DISTINCT user_id AS tile, event_type AS member FROM events WHERE ts < TIMESTAMP '2024-01-04'), n AS (SELECT DISTINCT user_id AS tile, event_type AS member FROM events WHERE ts >= TIMESTAMP '2024-01-27'),
l AS (SELECT user_id AS tile, count(*) AS results, user_id % 4 AS pages, user_id % 7 > 0 AS checked FROM events GROUP BY user_id),
d AS (SELECT l.tile, results >= 60 OR pages >= 3 AS is_full, checked, (SELECT count(*) FROM n WHERE n.tile = l.tile AND (NOT checked OR n.member NOT IN (SELECT member FROM s WHERE s.tile = l.tile))) AS added, (SELECT count(*) FROM s WHERE checked AND s.tile = l.tile AND s.member NOT IN (SELECT member FROM n WHERE n.tile = l.tile)) AS missing FROM l)
SELECT tile, CASE WHEN is_full THEN 'saturated' WHEN NOT checked THEN 'baseline' WHEN added > 0 AND missing > 0 THEN 'both' WHEN added > 0 THEN 'new' WHEN missing > 0 THEN 'gone' ELSE 'unchanged' END AS verdict, added, CASE WHEN is_full THEN 0 ELSE missing END AS gone FROM d""")
def tile_change_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("tile"), F.col("event_type").alias("member"), "ts")
    seen = e.groupBy("tile").agg(F.count("*").alias("results")).withColumns({"pages": F.col("tile") % 4, "checked": F.col("tile") % 7 > 0})
    return listings.tile_changes(e.where("ts < timestamp_ntz'2024-01-04'"), e.where("ts >= timestamp_ntz'2024-01-27'"), seen)


@query("""SELECT p_partkey, 'city' AS unit_kind, p_brand AS unit, p_type AS type, 'r' || (p_size % 4) AS path FROM part""")
def tile_key_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("city:"), "p_brand", F.lit("|"), "p_type", F.lit("|r"), (F.col("p_size") % 4).cast("string"))
    return read(spark, sf_dir, "part").withColumn("t", listings.tile_parts(key)).select("p_partkey", "t.*")


@query("""SELECT coalesce(r, 'stored') AS refused, count(*) AS rows FROM (SELECT CASE event_type WHEN 'error' THEN 'features' WHEN 'view' THEN 'rating' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'sab' END WHEN 'signup' THEN 'signals' END AS r FROM events) GROUP BY 1""")
def feature_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    text = (F.when(F.col("event_type") == "error", "[]").when(F.col("event_type") == "view", F.concat(F.lit('{"name":'), k, F.lit(',"rating":4.5}')))
            .when(F.col("event_type") == "click", F.concat(F.lit('{"sab":'), F.when(F.col("event_id") % 2 == 0, "2").otherwise("1"), F.lit(',"rule":"over_25km"}')))
            .when(F.col("event_type") == "signup", '{"signals":["name","other"]}').otherwise('{"signals":["name","phone"],"city":0,"address":30}'))
    reason = listings.refused_feature(text)
    return read(spark, sf_dir, "events").groupBy(F.coalesce(reason, F.lit("stored")).alias("refused")).agg(F.count("*").alias("rows"))


@query("""WITH a AS (SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'P'), f AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'N' OR l_linestatus = 'F' THEN floor(l_extendedprice * 100 + 0.5)::BIGINT END AS m FROM lineitem)
SELECT run_id, coalesce(sum(m), 0)::BIGINT AS cost FROM a LEFT JOIN f ON l_orderkey = run_id GROUP BY 1""")
def abandoned_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_extendedprice").cast("string")).alias("request_id"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("micros"), "l_returnflag", "l_linestatus")
    runs = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("run_id"))
    searches = li.select("run_id", F.when(F.col("l_returnflag") == "N", F.col("request_id")).alias("request_id"), "micros")
    return listings.closed_out(runs, searches, li.where("l_linestatus = 'F'"))[1]
