"""Queries of the run report's tables and of a business's listings: orders as runs and attachments, line items as what they did."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinewright.core import read
from spinewright.operators import reports
from spinewright.plans.screen_queries import _FIRMS, firms

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_ID = "l_orderkey * 1000003 + l_linenumber * 100019 + l_suppkey * 7 + l_partkey"
_RUNS = """runs AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'stopped' ELSE 'running' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'change_check' ELSE 'sweep' END AS kind FROM orders)"""
_SEARCHES = f"""searches AS (SELECT l_orderkey AS run_id, 't' || ({_ID}) AS tile_key, CASE WHEN l_linestatus = 'F' THEN 'done' WHEN l_partkey % 2 = 0 THEN 'planned' ELSE 'searching' END AS status, l_quantity >= 45 AS saturated, l_quantity >= 48 AS subdivided,
  l_quantity BETWEEN 45 AND 47 AS truncated, CASE WHEN l_quantity BETWEEN 45 AND 47 THEN CASE WHEN l_tax > 0.04 THEN 'max_depth' ELSE 'novelty' END END AS why,
  CASE WHEN l_linenumber < 6 THEN ['unchanged', 'new', 'gone', 'both', 'saturated', 'baseline'][1 + l_suppkey % 6] END AS verdict, CASE WHEN l_linenumber < 6 THEN l_partkey % 4 END AS new_ids, CASE WHEN l_linenumber < 5 THEN l_partkey % 3 END AS gone_ids FROM lineitem)"""
_OUTCOMES = """outcomes AS (SELECT l_orderkey AS run_id, l_partkey % 5 AS place_id, ['attached', 'tentative', 'unmatched', 'outside'][1 + l_suppkey % 4] AS outcome, 'c' || (l_partkey % 6) AS cluster_key FROM lineitem)"""
_SEEN = f"""seen AS (SELECT {_ID} AS obs_id, o_custkey AS business_id, l_orderkey AS place_id, l_orderkey AS attachment_id, l_suppkey % 50 AS run_id, l_returnflag <> 'N' AS had_website,
  ['none', 'other', 'social', 'directory', 'platform_subdomain', 'business_site_dead'][1 + l_suppkey % 6] AS host_class, epoch(l_shipdate)::BIGINT AS observed_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
_ATTACHED = """attached AS (SELECT o_orderkey AS attachment_id, o_orderkey AS place_id, o_custkey AS business_id, CASE o_orderstatus WHEN 'F' THEN 'attached' WHEN 'P' THEN 'rejected' ELSE 'tentative' END AS status, o_orderkey % 100 AS score, CASE WHEN o_orderkey % 2 = 0 THEN epoch(o_orderdate)::BIGINT END AS decided_at FROM orders)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "stopped").otherwise("running")
    clusters = F.array(F.concat(F.lit("c"), (k % 6).cast("string")), F.concat(F.lit("c"), ((k + 2) % 6).cast("string")))
    return read(spark, sf_dir, "orders").select(k.alias("run_id"), status.alias("status"), F.when(k % 3 == 0, "change_check").otherwise("sweep").alias("kind"), clusters.alias("cluster_keys"))


def _dealt(values: tuple[str, ...], by: str):  # noqa: ANN202
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, early = F.col("l_quantity"), F.col("l_linenumber") < 6
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.concat(F.lit("t"), F.expr(_ID).cast("string")).alias("tile_key"), F.when(F.col("l_linestatus") == "F", "done").when(F.col("l_partkey") % 2 == 0, "planned").otherwise("searching").alias("status"),
        (q >= 45).alias("saturated"), (q >= 48).alias("subdivided"), q.between(45, 47).alias("truncated"), F.when(q.between(45, 47), F.when(F.col("l_tax") > 0.04, "max_depth").otherwise("novelty")).alias("why"),
        F.when(early, _dealt(("unchanged", "new", "gone", "both", "saturated", "baseline"), "l_suppkey")).alias("verdict"), F.when(early, F.col("l_partkey") % 4).alias("new_ids"), F.when(F.col("l_linenumber") < 5, F.col("l_partkey") % 3).alias("gone_ids"),
    )


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_partkey") % 5).alias("place_id"), _dealt(("attached", "tentative", "unmatched", "outside"), "l_suppkey").alias("outcome"), F.concat(F.lit("c"), (F.col("l_partkey") % 6).cast("string")).alias("cluster_key"))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("business_id"))
    return read(spark, sf_dir, "lineitem").join(o, "l_orderkey").select(
        F.expr(_ID).alias("obs_id"), "business_id", F.col("l_orderkey").alias("place_id"), F.col("l_orderkey").alias("attachment_id"), (F.col("l_suppkey") % 50).alias("run_id"), (F.col("l_returnflag") != "N").alias("had_website"),
        _dealt(reports.HOST_CLASSES, "l_suppkey").alias("host_class"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("observed_at"),
    )


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "attached").when(F.col("o_orderstatus") == "P", "rejected").otherwise("tentative")
    return read(spark, sf_dir, "orders").select(k.alias("attachment_id"), k.alias("place_id"), F.col("o_custkey").alias("business_id"), status.alias("status"), (k % 100).alias("score"), F.when(k % 2 == 0, F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("decided_at"))


@query(f"""WITH {_RUNS}, l AS (SELECT l_orderkey AS run_id, ['ts_enterprise', 'ts_essentials', 'pd_pro'][1 + l_suppkey % 3] AS unit, 1 + l_linenumber % 3 AS units, CASE WHEN l_partkey % 4 > 0 THEN l_partkey * 10 ELSE 0 END AS micros FROM lineitem)
SELECT run_id, k.unit, coalesce(sum(units), 0)::BIGINT AS requests, coalesce(sum(units) FILTER (micros = 0), 0)::BIGINT AS free, coalesce(sum(micros), 0)::BIGINT AS micros FROM runs CROSS JOIN (VALUES ('ts_enterprise'), ('ts_essentials')) k(unit) LEFT JOIN l USING (run_id, unit) GROUP BY 1, 2""")
def report_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), _dealt(("ts_enterprise", "ts_essentials", "pd_pro"), "l_suppkey").alias("unit"), (F.col("l_linenumber") % 3 + 1).cast("long").alias("units"),
        F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey") * 10).otherwise(0).cast("long").alias("micros"),
    )
    return reports.requests_by_unit(_runs(spark, sf_dir), ledger)


@query(f"""WITH {_RUNS}, {_SEARCHES} SELECT run_id, count(tile_key) AS total, count(*) FILTER (s.status = 'done') AS searched, count(*) FILTER (saturated) AS saturated, count(*) FILTER (subdivided) AS subdivided, count(*) FILTER (truncated) AS truncated
FROM runs LEFT JOIN searches s USING (run_id) GROUP BY 1""")
def report_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tile_counts(_runs(spark, sf_dir), _searches(spark, sf_dir))


@query(f"""WITH {_RUNS}, {_SEARCHES} SELECT run_id, tile_key, 'truncated' AS kind, why FROM searches WHERE truncated
UNION ALL SELECT run_id, tile_key, 'unsearched', NULL FROM searches s JOIN runs r USING (run_id) WHERE r.status IN ('complete', 'failed', 'stopped') AND s.status IN ('planned', 'searching')""")
def report_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unfinished_tiles(_runs(spark, sf_dir), _searches(spark, sf_dir))


@query(f"""WITH {_RUNS}, {_OUTCOMES}, b AS (SELECT run_id, place_id, max(CASE outcome WHEN 'attached' THEN 3 WHEN 'tentative' THEN 2 WHEN 'unmatched' THEN 1 ELSE 0 END) AS r FROM outcomes GROUP BY 1, 2)
SELECT run_id, count(*) FILTER (r >= 1) AS found, count(*) FILTER (r = 3) AS attached, count(*) FILTER (r = 2) AS tentative, count(*) FILTER (r = 1) AS unmatched FROM runs LEFT JOIN b USING (run_id) GROUP BY 1""")
def report_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.outcome_counts(_runs(spark, sf_dir), _outcomes(spark, sf_dir))


@query(f"""WITH {_OUTCOMES}, k AS (SELECT 'c' || i AS cluster_key, 'Cluster ' || i AS display_name, 7 - i AS sort_order FROM generate_series(0, 4) t(i)),
n AS (SELECT o_orderkey AS run_id, pos, 'c' || ((o_orderkey + 2 * pos) % 6) AS cluster_key FROM orders, (VALUES (0), (1)) t(pos))
SELECT n.run_id, n.cluster_key, display_name, row_number() OVER (PARTITION BY n.run_id ORDER BY sort_order NULLS LAST, n.cluster_key, pos)::INT AS place, coalesce(c.found, 0) AS found, coalesce(c.attached, 0) AS attached, coalesce(c.tentative, 0) AS tentative, coalesce(c.unmatched, 0) AS unmatched
FROM n LEFT JOIN k USING (cluster_key) LEFT JOIN (SELECT run_id, cluster_key, count(*) FILTER (outcome <> 'outside') AS found, count(*) FILTER (outcome = 'attached') AS attached, count(*) FILTER (outcome = 'tentative') AS tentative, count(*) FILTER (outcome = 'unmatched') AS unmatched FROM outcomes GROUP BY 1, 2) c ON c.run_id = n.run_id AND c.cluster_key = n.cluster_key""")
def report_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = spark.range(5).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("cluster_key"), F.concat(F.lit("Cluster "), F.col("id").cast("string")).alias("display_name"), (7 - F.col("id")).alias("sort_order"))
    return reports.outcomes_by_cluster(_runs(spark, sf_dir), _outcomes(spark, sf_dir), clusters)


@query(f"""WITH {_SEEN}, {_ATTACHED}, h AS (SELECT unnest(['none', 'other', 'social', 'directory', 'platform_subdomain', 'business_site_dead']) AS host_class), r AS (SELECT i AS run_id FROM generate_series(0, 59) t(i))
SELECT r.run_id, h.host_class, count(x.obs_id) AS n FROM r CROSS JOIN h LEFT JOIN (SELECT s.* FROM seen s JOIN attached a USING (attachment_id) WHERE a.status = 'attached') x ON x.run_id = r.run_id AND x.host_class = h.host_class GROUP BY 1, 2""")
def report_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.host_counts(spark.range(60).withColumnRenamed("id", "run_id"), _seen(spark, sf_dir), _attached(spark, sf_dir))


@query(f"""WITH {_RUNS}, {_SEARCHES} SELECT run_id, count(verdict) AS checked, count(*) FILTER (verdict = 'unchanged') AS unchanged, count(*) FILTER (verdict IN ('new', 'both')) AS with_new, count(*) FILTER (verdict IN ('gone', 'both')) AS with_gone,
  coalesce(sum(new_ids), 0)::BIGINT AS new_ids, coalesce(sum(gone_ids), 0)::BIGINT AS gone_ids, count(*) FILTER (verdict IN ('new', 'gone', 'both', 'saturated')) AS changed_tiles FROM runs r LEFT JOIN searches USING (run_id) WHERE kind = 'change_check' GROUP BY 1""")
def report_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.change_counts(_runs(spark, sf_dir), _searches(spark, sf_dir))


@query(f"""WITH {_FIRMS}, {_SEEN}, {_ATTACHED}, l AS (SELECT business_id, place_id, max({{'t': observed_at, 'i': obs_id, 'w': had_website, 'h': host_class}}) AS o FROM seen GROUP BY 1, 2)
SELECT coalesce(f.merged_into, f.id) AS id, row_number() OVER (PARTITION BY coalesce(f.merged_into, f.id) ORDER BY CASE a.status WHEN 'attached' THEN 1 WHEN 'tentative' THEN 2 ELSE 3 END, CASE WHEN a.status = 'attached' THEN o.t END DESC NULLS LAST,
  CASE WHEN a.status = 'tentative' THEN score END DESC NULLS LAST, decided_at DESC NULLS LAST, attachment_id)::INT AS place, attachment_id, place_id, a.status, score, o.w AS had_website, o.h AS host_class, o.t AS observed_at
FROM attached a LEFT JOIN l USING (business_id, place_id) JOIN firms f ON f.id = a.business_id""")
def listing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.checked_listings(_attached(spark, sf_dir), _seen(spark, sf_dir), firms(spark, sf_dir))


@query(f"""WITH {_FIRMS}, {_SEEN} SELECT coalesce(merged_into, id) AS id, row_number() OVER (PARTITION BY coalesce(merged_into, id) ORDER BY observed_at DESC, obs_id DESC)::INT AS place, obs_id, place_id, observed_at, had_website, host_class, run_id FROM seen JOIN firms ON id = business_id""")
def listing_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.observed_history(_seen(spark, sf_dir), firms(spark, sf_dir))


@query(f"""WITH {_FIRMS}, p AS (SELECT o_orderkey AS pair_id, o_custkey AS left_id, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) AS right_id, o_orderkey * 31 % 101 AS score, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS skipped_at FROM orders WHERE o_orderstatus <> 'P'),
j AS (SELECT p.*, coalesce(a.merged_into, a.id) AS l, coalesce(b.merged_into, b.id) AS r FROM p JOIN firms a ON a.id = left_id JOIN firms b ON b.id = right_id WHERE score >= 80),
t AS (SELECT *, row_number() OVER (ORDER BY skipped_at NULLS FIRST, score DESC, pair_id)::INT AS place FROM j WHERE l <> r ORDER BY place LIMIT 40)
SELECT place, pair_id, score, skipped_at IS NOT NULL AS skipped, side, business_id, key, name, cluster_key FROM (SELECT *, 'left' AS side, l AS business_id FROM t UNION ALL SELECT *, 'right', r FROM t) x LEFT JOIN (SELECT id, key, name, cluster_key FROM firms) f ON f.id = business_id""")
def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").count()
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    decision = F.when(F.col("o_orderstatus") == "P", "merged").otherwise("pending")
    pairs = o.select(k.alias("pair_id"), c.alias("left_id"), ((c * 7 + k) % n).alias("right_id"), (k * 31 % 101).alias("score"), decision.alias("decision"), F.when(k % 5 == 0, F.col("o_orderdate")).alias("skipped_at"))
    return reports.top_pairs(pairs, firms(spark, sf_dir), 40)
