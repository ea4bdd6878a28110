"""Keys, ingest, read-model, planning and metering queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinewright.core import read
from spinewright.functions import keys
from spinewright.operators import ingest, meter, report, reserve, sweep
from spinewright.plans.resolve_queries import _BIZ, businesses

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def day(c: str):  # noqa: ANN201
    return F.date_format(c, "yyyy-MM-dd")


# keys


@query("""WITH t AS (SELECT p_name AS raw FROM part UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer), w AS (SELECT raw, list_filter(string_split_regex(lower(strip_accents(raw)), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ('el','la','los','las','de','del','y','and','the','of')) AS k FROM t)
SELECT raw, nullif(regexp_replace(array_to_string(k, ' '), '(?:(?:^| )(?:llc|inc|co|ltd|corp|lp|llp|pllc|plc|incorporated|company|corporation))+$', ''), '') AS norm, coalesce(regexp_matches(k[-1], '^[0-9]+$'), false) AS had_store_number FROM w""")
def name_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("raw")).union(read(spark, sf_dir, "supplier").select("s_name")).union(read(spark, sf_dir, "customer").select("c_name")).distinct()
    return names.withColumn("k", keys.name_parts(F.col("raw"))).select("raw", "k.norm", "k.had_store_number")


@query("""SELECT DISTINCT p_size, p_type, p_size::VARCHAR AS street_num, upper(regexp_replace(p_type, '[^A-Za-z0-9]+', ' ', 'g')) || ' ST' AS street_norm, (p_size % 9)::VARCHAR AS unit FROM part""")
def address_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_size", "p_type").distinct()
    raw = F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", F.lit("Street, Suite"), (F.col("p_size") % 9).cast("string"))
    return p.withColumn("a", keys.address_parts(raw)).select("p_size", "p_type", "a.street_num", "a.street_norm", "a.unit")


@query("""SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN 'none' WHEN h = '' THEN 'other' WHEN regexp_matches(h, '(^|\\.)(business\\.site|g\\.page)$') THEN 'business_site_dead' WHEN regexp_matches(h, '(^|\\.)(facebook\\.com|instagram\\.com|linktr\\.ee|beacons\\.ai)$') THEN 'social' ELSE 'other' END AS host_class, nullif(h, '') AS host
FROM (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') AS h FROM pages)""")
def host_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", keys.host_class(F.col("url")).alias("host_class"), keys.host(F.col("url")).alias("host"))


@query("""SELECT c_custkey, CASE WHEN ok THEN '+1' || d END AS e164, ok AND substr(d, 1, 3) NOT IN ('800','833','844','855','866','877','888') AS blockable FROM (SELECT *, regexp_matches(d, '^[2-9][0-9]{2}[2-9][0-9]{6}$') AND substr(d, 4, 3) <> '555' AS ok FROM (SELECT c_custkey, (200 + c_custkey % 700)::VARCHAR || lpad((c_custkey * 7919 % 10000000)::VARCHAR, 7, '0') AS d FROM customer))""")
def phone_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.concat(F.lit("(1) "), (200 + k % 700).cast("string"), F.lit("-"), F.lpad((k * 7919 % 10000000).cast("string"), 7, "0"))
    return read(spark, sf_dir, "customer").withColumn("p", keys.phone(raw)).select("c_custkey", "p.e164", "p.blockable")


@query("""SELECT h % 4 AS partition, count(*) AS names, min(h) AS least, max(h) AS largest FROM (SELECT DISTINCT p_name, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS h FROM part) GROUP BY 1""")
def fnv_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").select("p_name").distinct().withColumn("h", keys.fnv1a32(F.col("p_name")))
    return names.groupBy((F.col("h") % 4).alias("partition")).agg(F.count("*").alias("names"), F.min("h").alias("least"), F.max("h").alias("largest"))


# ingest


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS payload_hash, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN 'inserted' ELSE 'unchanged' END AS action FROM documents""")
def payload_hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("payload_hash"))
    first = d.groupBy("payload_hash").agg(F.min("doc_id").alias("first_id"))
    return d.join(first, "payload_hash").select("doc_id", "payload_hash", F.when(F.col("doc_id") == F.col("first_id"), "inserted").otherwise("unchanged").alias("action"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, strftime(max(o_orderdate), '%Y-%m-%d') AS o_orderdate, count(*) - 1 AS duplicates FROM orders GROUP BY 1""")
def source_dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return ingest.latest_per_key(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderdate"]).withColumn("o_orderdate", day("o_orderdate"))


_SNAPSHOTS = """a AS (SELECT o_orderkey, 'O|' || o_orderpriority AS h FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'), b AS (SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS h FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a first run saw them, all open and before 2000, and as a second run does, from 1996 on."""
    o = read(spark, sf_dir, "orders")
    old = o.where("o_orderdate < timestamp_ntz'2000-01-01'").select("o_orderkey", F.concat_ws("|", F.lit("O"), "o_orderpriority").alias("h"))
    return old, o.where("o_orderdate >= timestamp_ntz'1996-01-01'").select("o_orderkey", F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("h"))


@query(f"""WITH {_SNAPSHOTS} SELECT action, count(*) AS rows FROM (SELECT CASE WHEN a.o_orderkey IS NULL THEN 'inserted' WHEN b.o_orderkey IS NULL THEN 'gone' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS action FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) GROUP BY 1""")
def ingest_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return ingest.upsert_actions(old, new, "o_orderkey", "h").groupBy("action").agg(F.count("*").alias("rows"))


@query(f"""WITH {_SNAPSHOTS} SELECT h, count(*) AS rows FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)) GROUP BY 1""")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.upserted(*_snapshots(spark, sf_dir), "o_orderkey").groupBy("h").agg(F.count("*").alias("rows"))


@query(f"""WITH {_SNAPSHOTS} SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS kind, '{{"h":"' || a.h || '"}}' AS before, '{{"h":"' || b.h || '"}}' AS after FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.h IS DISTINCT FROM b.h""")
def change_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.change_events(*_snapshots(spark, sf_dir), "o_orderkey", ["h"])


@query("""SELECT coalesce(r, 'valid') AS reason, count(*) AS rows FROM (SELECT CASE WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'negative_balance' WHEN NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE'), false) THEN 'segment' WHEN NOT coalesce(length(c_name) > 0, false) THEN 'no_name' END AS r FROM customer) GROUP BY 1""")
def named_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("negative_balance", F.col("c_acctbal") >= 0), ("segment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")), ("no_name", F.length("c_name") > 0)]
    return ingest.validated(read(spark, sf_dir, "customer"), rules).groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("rows"))


@query("""SELECT c_mktsegment AS segment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS r FROM customer) WHERE r <= 10""")
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.stratified_sample(read(spark, sf_dir, "customer"), F.col("c_mktsegment"), "c_custkey", 10).select(F.col("group").alias("segment"), "c_custkey")


@query("""SELECT l_orderkey, strftime(max(l_shipdate), '%Y-%m-%d') AS closed_on, arg_min(l_linenumber, (-epoch_us(l_shipdate), l_linenumber)) AS l_linenumber FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1""")
def closure_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    return ingest.latest_per_key(closed, ["l_orderkey"], [F.col("l_shipdate"), -F.col("l_linenumber")], ["l_shipdate", "l_linenumber"]).select("l_orderkey", day("l_shipdate").alias("closed_on"), "l_linenumber")


# read models


@query("""SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'closed' ELSE 'active' END AS status FROM customer WHERE contains(lower(c_name), '1') AND c_mktsegment IS NOT NULL AND c_acctbal >= 0 ORDER BY c_name, c_custkey LIMIT 50 OFFSET 25""")
def search_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("status", F.when(F.col("c_acctbal") < 0, "closed").otherwise("active"))
    found = c.where(F.expr("contains(collate(c_name, 'UNICODE_CI_AI'), '1')") & F.col("c_mktsegment").isNotNull() & (F.col("status") == "active"))
    return found.orderBy("c_name", "c_custkey").offset(25).limit(50).select("c_custkey", "c_name", "c_mktsegment", "status")


@query("""SELECT n_name, t.event_type, coalesce(n, 0) AS events, coalesce(v, 0) AS micros FROM nation, (SELECT DISTINCT event_type FROM events) t LEFT JOIN (SELECT user_id % 25 AS k, event_type, count(*) AS n, sum(floor(value * 1000000 + 0.5)::BIGINT)::BIGINT AS v FROM events GROUP BY 1, 2) e ON e.k = n_nationkey AND e.event_type = t.event_type""")
def static_dim_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("n_nationkey", (F.col("user_id") % 25).cast("int"))
    kinds = F.explode(F.array(*[F.lit(k) for k in ("view", "signup", "error", "click", "purchase")])).alias("event_type")
    dim = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", kinds)
    return report.zero_filled(e, dim, ["n_nationkey", "event_type"], {"events": F.count("*"), "micros": F.sum(meter.micros(F.col("value")))}).drop("n_nationkey")


@query("""SELECT user_id, count(*) AS types, bool_or(event_type = 'error') AS any_error, arg_max(event_type, (ts, event_id)) AS last_type, max(event_id) AS last_event, sum(n)::BIGINT AS events FROM (SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))
    return last.groupBy("user_id").agg(F.count("*").alias("types"), F.bool_or(F.col("event_type") == "error").alias("any_error"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("event_id").alias("last_event"), F.sum("n").alias("events"))


_RANKS = {"purchase": 3, "signup": 2, "click": 1}


@query("""SELECT CASE r WHEN 3 THEN 'purchase' WHEN 2 THEN 'signup' WHEN 1 THEN 'click' ELSE 'other' END AS best, count(*) AS keys FROM (SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS r FROM events GROUP BY 1) GROUP BY 1""")
def best_outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.best_rank_counts(read(spark, sf_dir, "events"), "user_id", "event_type", _RANKS)


@query("""SELECT user_id, arg_max(event_type, (CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE -1 END, event_type)) AS event_type FROM events GROUP BY 1""")
def monotone_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ranked_upsert(read(spark, sf_dir, "events"), ["user_id"], "event_type", _RANKS)


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, (sum(floor(o_totalprice * 1000000 + 0.5)::BIGINT) FILTER (o_orderstatus = 'F'))::BIGINT AS finished_micros, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def filtered_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("micros", meter.micros(F.col("o_totalprice")))
    return o.groupBy("o_orderpriority").agg(F.expr("count(*) filter (where o_orderstatus = 'F')").alias("finished"), F.expr("count(*) filter (where o_orderstatus = 'O')").alias("open"), F.expr("sum(micros) filter (where o_orderstatus = 'F')").alias("finished_micros"), F.countDistinct("o_custkey").alias("customers"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS lines, sum(floor(l_extendedprice * 1000000 + 0.5)::BIGINT)::BIGINT AS micros FROM lineitem GROUP BY 1, 2""")
def spend_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.sum(meter.micros(F.col("l_extendedprice"))).alias("micros"))


@query("""SELECT o_orderkey, o_orderstatus, coalesce(m, 0) AS micros, coalesce(n, 0) AS lines FROM orders LEFT JOIN (SELECT l_orderkey, sum(floor(l_extendedprice * 1000000 + 0.5)::BIGINT)::BIGINT AS m, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def spend_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(meter.micros(F.col("l_extendedprice"))).alias("micros"), F.count("*").alias("lines"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(spent, "o_orderkey", "left").na.fill(0, ["micros", "lines"])


@query("""SELECT c_custkey, CASE WHEN cap <= 0 THEN CASE WHEN u > 0 THEN 100 ELSE 0 END ELSE u * 100 // cap END AS pct FROM (SELECT c_custkey, floor(c_acctbal * 1000000 + 0.5)::BIGINT * 20 AS cap, coalesce(u, 0) AS u FROM customer LEFT JOIN (SELECT o_custkey, sum(floor(o_totalprice * 1000000 + 0.5)::BIGINT)::BIGINT AS u FROM orders GROUP BY 1) ON o_custkey = c_custkey)""")
def pct_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(meter.micros(F.col("o_totalprice"))).alias("used"))
    c = read(spark, sf_dir, "customer").join(used, "c_custkey", "left").withColumns({"used": F.coalesce("used", F.lit(0)), "cap": meter.micros(F.col("c_acctbal")) * 20})
    return c.select("c_custkey", report.pct_used(F.col("used"), F.col("cap")).alias("pct"))


@query("""SELECT CASE WHEN c IS NULL THEN 'null' WHEN c = 1.0 THEN '=1.0' ELSE '0.' || least(9, floor(c * 10)::INT) || '-' || CASE WHEN least(9, floor(c * 10)::INT) = 9 THEN '1.0' ELSE '0.' || (floor(c * 10)::INT + 1) END END AS band, count(*) AS rows FROM (SELECT l_discount * 10 AS c FROM lineitem) GROUP BY 1""")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(report.band(F.col("l_discount") * 10).alias("band")).agg(F.count("*").alias("rows"))


@query("""SELECT p_type, count(*) AS rows FROM part WHERE p_type NOT IN (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 5) GROUP BY 1""")
def unmapped_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("rows"))
    mapped = n.orderBy(F.desc("rows"), "p_type").limit(5).select("p_type")
    return n.join(F.broadcast(mapped), "p_type", "left_anti")  # five rows


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return read(spark, sf_dir, "customer").join(open_, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'construction' WHEN p_size >= 5 AND p_size < 20 THEN 'retail' WHEN p_size >= 25 AND p_size < 45 THEN 'food' END AS cluster FROM part""")
def range_naics_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = [("construction", 0, 10), ("retail", 5, 20), ("food", 25, 45)]
    return read(spark, sf_dir, "part").select("p_partkey", report.first_range(F.col("p_size"), ranges).alias("cluster"))


@query(f"""WITH {_BIZ} SELECT a.id AS left_id, b.id AS right_id FROM biz a JOIN biz b ON a.id < b.id AND abs(a.lat - b.lat) <= 0.00135 AND abs(a.lng - b.lng) <= 0.0015""")
def proximity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.proximity_pairs(businesses(spark, sf_dir).select("id", "lat", "lng"), 0.00135, 0.0015)


@query("""SELECT p_partkey, i - 1 AS place, w[i] AS word FROM (SELECT p_partkey, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))""")
def ordinality_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "word")).withColumn("place", F.col("place").cast("long"))


@query("""SELECT event_type, count(*) AS events, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, max(json_extract_string(props, '$.k')::BIGINT) AS largest FROM events GROUP BY 1""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("k"), F.max(k).alias("largest"))


def _weeks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events")
    week = lambda a, b: e.where(f"ts >= timestamp_ntz'{a}' and ts < timestamp_ntz'{b}'").select("event_type", "user_id")
    return week("2024-01-01", "2024-01-08"), week("2024-01-08", "2024-01-15")


_WEEKS = """b AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08'), a AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15')"""


@query(f"""WITH {_WEEKS}, j AS (SELECT coalesce(b.event_type, a.event_type) AS event_type, b.user_id AS bu, a.user_id AS au FROM b FULL JOIN a USING (event_type, user_id)), n AS (SELECT event_type, count(*) FILTER (bu IS NULL) AS added, count(*) FILTER (au IS NULL) AS gone, count(bu) AS was FROM j GROUP BY 1)
SELECT event_type, added, gone, CASE WHEN was = 0 THEN 'baseline' WHEN added > 0 AND gone > 0 THEN 'both' WHEN added > 0 THEN 'new' WHEN gone > 0 THEN 'gone' ELSE 'unchanged' END AS verdict FROM n""")
def set_diff_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.set_verdicts(*_weeks(spark, sf_dir), "event_type", "user_id")


@query(f"""WITH {_WEEKS} SELECT event_type, round(count(b.user_id)::DOUBLE / greatest(1, count(*)), 6) AS overlap FROM a LEFT JOIN b USING (event_type, user_id) GROUP BY 1""")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent, child = (x.distinct() for x in _weeks(spark, sf_dir))
    return child.join(parent.withColumn("p", F.lit(1)), ["event_type", "user_id"], "left").groupBy("event_type").agg(F.round(F.count("p") / F.greatest(F.lit(1), F.count("*")), 6).alias("overlap"))


_LOCAL = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago')"


@query(f"""SELECT strftime(date_trunc('month', {_LOCAL}), '%Y-%m-%d') AS period, event_type, count(*) AS events FROM events GROUP BY 1, 2""")
def period_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(report.period_start(F.col("ts")).cast("string").alias("period"), "event_type").agg(F.count("*").alias("events"))


@query(f"""SELECT (({_LOCAL}::DATE - DATE '1970-01-05') // 7)::BIGINT AS week, (({_LOCAL}::DATE - DATE '1970-01-05') // 7 % 4)::BIGINT AS partition, count(*) AS events FROM events GROUP BY 1, 2""")
def week_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = report.week_index(F.col("ts"))
    return read(spark, sf_dir, "events").groupBy(w.alias("week"), (w % 4).alias("partition")).agg(F.count("*").alias("events"))


@query("""SELECT week(o_orderdate)::BIGINT AS iso_week, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday, count(*) AS orders FROM orders GROUP BY 1, 2""")
def iso_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.weekofyear("o_orderdate").cast("long").alias("iso_week"), F.date_trunc("week", "o_orderdate").cast("date").cast("string").alias("monday")).agg(F.count("*").alias("orders"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended FROM s GROUP BY 1, 2""")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sessions(read(spark, sf_dir, "events"), "user_id", "ts", 30)


# metering


@query("""WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(floor(value * 1000000 + 0.5)::BIGINT)::BIGINT AS s FROM events WHERE event_type = 'purchase' GROUP BY 1), r AS (SELECT *, sum(s) OVER (PARTITION BY day[1:7] ORDER BY day)::BIGINT AS t FROM d) SELECT day[1:7] AS period, min(day) AS day, min(t) AS total FROM r WHERE t * 100 >= 50000000000 * 80::BIGINT GROUP BY 1""")
def cum_spend_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.date_format("ts", "yyyy-MM").alias("period"), day("ts").alias("day"), meter.micros(F.col("value")).alias("spent_micros"))
    return meter.first_alerts(e, "period", "day", "spent_micros", 50_000_000_000)


@query("""SELECT user_id, count(*) AS requests, sum(m)::BIGINT AS micros FROM (SELECT user_id, json_extract_string(props, '$.k') AS request, arg_min(floor(value * 1000000 + 0.5)::BIGINT, (ts, event_id)) AS m FROM events GROUP BY 1, 2) GROUP BY 1""")
def ledger_settle_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumns({"request": F.concat_ws("/", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")), "micros": meter.micros(F.col("value"))})
    return meter.settled(e, "request", [F.col("ts"), F.col("event_id")], ["user_id", "micros"]).groupBy("user_id").agg(F.count("*").alias("requests"), F.sum("micros").alias("micros"))


@query("""WITH p AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period FROM orders), c AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, max(floor(o_totalprice * 1000000 + 0.5)::BIGINT) AS cap FROM orders WHERE o_orderpriority = '1-URGENT' AND month(o_orderdate) IN (3, 9) GROUP BY 1)
SELECT period, coalesce(last_value(cap IGNORE NULLS) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING), 50000000) AS cap FROM p LEFT JOIN c USING (period)""")
def cap_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("period", F.date_format("o_orderdate", "yyyy-MM"))
    caps = o.where((F.col("o_orderpriority") == "1-URGENT") & F.month("o_orderdate").isin(3, 9)).groupBy("period").agg(F.max(meter.micros(F.col("o_totalprice"))).alias("cap"))
    return meter.carried_caps(o, caps, "period", "cap", 50_000_000)


@query("""WITH RECURSIVE o AS (SELECT o_custkey, floor(o_totalprice * 1000000 + 0.5)::BIGINT AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
w AS (SELECT o_custkey, r, CASE WHEN m <= 500000000000 THEN m ELSE 0 END AS held, m <= 500000000000 AS ok FROM o WHERE r = 1
  UNION ALL SELECT o.o_custkey, o.r, CASE WHEN w.held + m <= 500000000000 THEN w.held + m ELSE w.held END, w.held + m <= 500000000000 FROM w JOIN o ON o.o_custkey = w.o_custkey AND o.r = w.r + 1)
SELECT o_custkey, count(*) AS asked, count(*) FILTER (ok) AS accepted, max(held)::BIGINT AS held FROM w GROUP BY 1""")
def reserve_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", meter.micros(F.col("o_totalprice")).alias("micros"))
    granted = reserve.reserved(o, "o_custkey", ["o_orderdate", "o_orderkey"], "micros", 500_000_000_000)
    return granted.groupBy("o_custkey").agg(F.count("*").alias("asked"), F.count_if("accepted").alias("accepted"), F.max("held").alias("held"))


# planning


@query("""WITH c AS (SELECT n_nationkey, n_regionkey, (SELECT CASE WHEN count(*) >= 4 THEN count(*) END FROM supplier WHERE s_nationkey = n_nationkey) AS measured, (SELECT count(*) FROM customer JOIN nation m ON c_nationkey = m.n_nationkey WHERE m.n_regionkey = n.n_regionkey) AS total FROM nation n)
SELECT n_nationkey, coalesce(measured, floor(greatest(0, total - coalesce(sum(measured) OVER w, 0))::DOUBLE / (count(*) FILTER (measured IS NULL) OVER w) + 0.5)::BIGINT)::BIGINT AS expected, 8::BIGINT AS low, 72::BIGINT AS high FROM c WINDOW w AS (PARTITION BY n_regionkey)""")
def estimate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    seen = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("m")).where("m >= 4")
    total = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("total"))
    cells = n.join(seen, "n_nationkey", "left").join(total, "n_regionkey", "left").na.fill(0, ["total"]).withColumnRenamed("m", "measured")
    low, high = sweep.request_range(F.lit(8))
    return sweep.apportioned(cells, "n_regionkey", "total", "measured").select("n_nationkey", "expected", low.alias("low"), high.alias("high"))


_ROOT = (25.0, -100.0, 29.0, -96.0)


@query(f"""WITH RECURSIVE {_BIZ}, t AS (SELECT 'r' AS path, 25.0::DOUBLE AS s, -100.0::DOUBLE AS w, 29.0::DOUBLE AS n, -96.0::DOUBLE AS e, 0 AS d
UNION ALL SELECT path || q, CASE WHEN q >= 2 THEN (s + n) / 2 ELSE s END, CASE WHEN q % 2 = 1 THEN (w + e) / 2 ELSE w END, CASE WHEN q >= 2 THEN n ELSE (s + n) / 2 END, CASE WHEN q % 2 = 1 THEN e ELSE (w + e) / 2 END, d + 1
FROM t, range(4) r(q) WHERE d < 4 AND (SELECT count(*) FROM biz WHERE lat >= s AND lat < n AND lng >= w AND lng < e) >= 60)
SELECT path, count(*) AS points FROM t JOIN biz ON lat >= s AND lat < n AND lng >= w AND lng < e GROUP BY 1""")
def quadtree_subdivide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.subdivided(businesses(spark, sf_dir), _ROOT, 60, 4)


@query("""WITH p AS (SELECT DISTINCT 'r' || (p_size % 4) || CASE WHEN p_size > 12 THEN (p_size % 3)::VARCHAR ELSE '' END || CASE WHEN p_size > 30 THEN (p_size % 2)::VARCHAR ELSE '' END AS path FROM part) SELECT path FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.path <> a.path AND starts_with(a.path, b.path))""")
def stored_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    path = F.concat(F.lit("r"), (size % 4).cast("string"), F.when(size > 12, (size % 3).cast("string")).otherwise(""), F.when(size > 30, (size % 2).cast("string")).otherwise(""))
    return sweep.shallowest(read(spark, sf_dir, "part").select(path.alias("path")).distinct())


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS version FROM conversations""")
def version_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.versioned(read(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"]).select("conv_id", "turn", "role", "version")


@query("""WITH v AS (SELECT o_custkey, year(o_orderdate) AS y, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1, 2) SELECT a.o_custkey, a.y::BIGINT AS y, array_to_string(list_sort(list_filter(a.p, lambda x: NOT list_contains(coalesce(b.p, []), x))), ',') AS added, array_to_string(list_sort(list_filter(coalesce(b.p, []), lambda x: NOT list_contains(a.p, x))), ',') AS removed FROM v a LEFT JOIN v b ON a.o_custkey = b.o_custkey AND b.y = a.y - 1""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("y")).agg(F.collect_set("o_orderpriority").alias("p"))  # five values
    before = v.select("o_custkey", (F.col("y") + 1).alias("y"), F.col("p").alias("b"))
    j = v.join(before, ["o_custkey", "y"], "left").withColumn("b", F.coalesce("b", F.expr("cast(array() as array<string>)")))
    return j.select("o_custkey", "y", F.concat_ws(",", F.array_sort(F.array_except("p", "b"))).alias("added"), F.concat_ws(",", F.array_sort(F.array_except("b", "p"))).alias("removed"))


@query("""SELECT * FROM (SELECT 'pair' AS kind, o_orderkey AS id, floor(o_totalprice * 100 + 0.5)::BIGINT AS score FROM orders WHERE o_orderstatus = 'O' ORDER BY score DESC, id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'listing' AS kind, p_partkey AS id, floor(p_retailprice * 100 + 0.5)::BIGINT AS score FROM part ORDER BY score DESC, id LIMIT 1)""")
def queue_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lambda df, kind, k, v: df.select(F.lit(kind).alias("kind"), F.col(k).alias("id"), F.floor(F.col(v) * 100 + 0.5).cast("long").alias("score")).orderBy(F.desc("score"), "id").limit(1)
    return top(read(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), "pair", "o_orderkey", "o_totalprice").unionByName(top(read(spark, sf_dir, "part"), "listing", "p_partkey", "p_retailprice"))


@query("""SELECT n_name, r_name, CASE WHEN s.n >= 3 THEN 'own' ELSE 'built_in' END AS origin, coalesce(s.n, 0) AS suppliers, o.c AS customers FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) o ON c_nationkey = n_nationkey""")
def star_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = lambda t, k, name: read(spark, sf_dir, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count("*").alias(name))
    j = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).join(per("supplier", "s_nationkey", "suppliers"), "n_nationkey", "left").join(per("customer", "c_nationkey", "customers"), "n_nationkey", "left")
    return j.select("n_name", "r_name", F.when(F.col("suppliers") >= 3, "own").otherwise("built_in").alias("origin"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), "customers")


@query("""SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines, coalesce(l_partkey, -1) AS top_part FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, (-l_extendedprice, l_linenumber)) AS l_partkey FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def lateral_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.min_by("l_partkey", F.struct(-F.col("l_extendedprice"), "l_linenumber")).alias("top_part"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(top, "o_orderkey", "left").na.fill(0, ["lines"]).na.fill(-1, ["top_part"])


@query("""SELECT user_id, count(DISTINCT event_id) AS touching FROM (SELECT user_id, event_id FROM events WHERE event_type = 'click' UNION SELECT user_id, event_id FROM events WHERE value > 50) GROUP BY 1""")
def or_join_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    either = e.where("event_type = 'click'").select("user_id", "event_id").union(e.where("value > 50").select("user_id", "event_id")).distinct()
    return either.groupBy("user_id").agg(F.count("*").alias("touching"))


@query("""SELECT event_type, count(*) FILTER (ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-20') AS live, count(*) FILTER (ts + INTERVAL 10 DAY <= TIMESTAMP '2024-01-20') AS expired FROM events GROUP BY 1""")
def ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = F.col("ts") + F.expr("interval 10 days") > F.expr("timestamp_ntz'2024-01-20'")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(live).alias("live"), F.count_if(~live).alias("expired"))


@query("""SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def ordered_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("r_name").agg(F.expr("listagg(n_name, ',') within group (order by n_name)").alias("nations"), F.count("*").alias("n"))
