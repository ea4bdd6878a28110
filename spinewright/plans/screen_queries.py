"""Screen-level read queries, hard cases of the keys, and the writers' effects, each with its SQL.

Customers play the businesses: every 17th is merged into the one before it, those in debt are closed, every sixth is
without a cluster. Orders are their source records, suppliers are sources, line items searches and ledger entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinewright.core import read
from spinewright.functions import keys
from spinewright.operators import meter, queue, report, resolve, screens, sweep
from spinewright.plans.resolve_queries import _BIZ, _BLOCKS, businesses

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_FIRMS = """firms AS MATERIALIZED (SELECT c_custkey AS id, 'K' || c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 6 > 0 THEN c_mktsegment END AS cluster_key,
  CASE WHEN c_custkey % 17 = 0 THEN c_custkey - 1 END AS merged_into, CASE WHEN c_acctbal < 0 THEN 'x' END AS closed_at,
  CASE WHEN c_custkey % 17 = 0 THEN 'merged_away' WHEN c_acctbal < 0 THEN 'closed' ELSE 'active' END AS status FROM customer)"""


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("id"), F.concat(F.lit("K"), k.cast("string")).alias("key"), F.col("c_name").alias("name"), F.when(k % 6 > 0, F.col("c_mktsegment")).alias("cluster_key"),
        F.when(k % 17 == 0, k - 1).alias("merged_into"), F.when(F.col("c_acctbal") < 0, F.lit("x")).alias("closed_at"),
    )


# hard cases of the keys: the expected values were worked out by hand from the rules

_HARD_NAMES = [
    ("Phở Bắc Café", "pho bac cafe"), ("L'Été  Ñandú", "l ete nandu"), ("Straße & Söhne", "strasse sohne"), ("Łódź Bakery", "lodz bakery"), ("ẞtern Œuvre", "sstern oeuvre"),
    ("Acme, L.L.C.", "acme"), ("Acme Inc dba Bobs", "acme bobs"), ("The House of Tacos", "house tacos"), ("Nguyễn Thị Ánh", "nguyen thi anh"), ("Ångström Å", "angstrom a"),
    ("Taqueria Jalisco", "taqueria jalisco"), ("Taqueria 5", "taqueria 5"), ("Taqueria El Rey Azul", "rey azul"), ("", None), ("The", None), ("Joes Grill 956 555 1234", "joes grill"), ("Ａcme", "cme"), ("Ώρα", None),
]


def _cases(rows: list[tuple], names: str, table: str, key: str) -> str:
    """Hard cases dealt over a table's rows by their key, with what is expected of them."""
    text = lambda v: "NULL" if v is None else f"{v}" if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT {key} AS id, {names} FROM {table} JOIN (VALUES {', '.join('(' + ', '.join(map(text, (i, *r))) + ')' for i, r in enumerate(rows))}) AS t(i, {names}) ON {key} % {len(rows)} = i"


def _dealt(rows: DataFrame, key: str, cases: list[str]) -> DataFrame:
    return rows.select(F.col(key).alias("id"), F.element_at(F.array(*map(F.lit, cases)), (F.col(key) % len(cases) + 1).cast("int")).alias("raw"))


@query(_cases(_HARD_NAMES, "raw, norm", "part", "p_partkey"))
def name_norm_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(read(spark, sf_dir, "part"), "p_partkey", [r for r, _ in _HARD_NAMES]).select("id", "raw", keys.name_norm(F.col("raw")).alias("norm"))


_UNITS = [("", 2166136261), ("abc", 440920331), ("a", 3826002220), ("\U0001f600", 3409036472)]


@query(_cases([(r, n, n % 4) for r, n in _UNITS], "raw, hash, partition", "customer", "c_custkey"))
def fnv_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = keys.fnv1a32(F.col("raw"))
    return _dealt(read(spark, sf_dir, "customer"), "c_custkey", [r for r, _ in _UNITS]).select("id", "raw", h.alias("hash"), (h % 4).alias("partition"))


_SIDE = "name_norm string, phone string, blockable boolean, street_num string, street_norm string, unit string, postal string, lat double, lng double, location_match_type string, cluster_key string, chain boolean"
#: Pairs with their scores: hard cases of lifts, holds, caps, units and distance.
_PAIRS = [
    (1, ("joes grill", "+19562345678", True, "12", "MAIN ST", None, "78501", 26.2, -98.2, "overture", "food", False), ("joes grill", "+19562345678", True, "12", "MAIN ST", None, "78501", 26.2, -98.2, "overture", "food", False), 100, "merge"),
    (2, ("joes grill", "+19562345678", True, "12", "MAIN ST", None, "78501", 26.2, -98.2, "overture", "food", True), ("joes grill", "+19562345678", True, "12", "MAIN ST", None, "78501", 26.2, -98.2, "overture", "food", False), 94, "review"),
    (3, ("joes grill", None, False, "12", "MAIN ST", "A", "78501", 26.2, -98.2, "overture", "food", False), ("joes grill", None, False, "12", "MAIN ST", "B", "78501", 26.2, -98.2, "overture", "food", False), 80, "review"),
    (4, ("joes grill", None, False, "12", "MAIN ST", None, "78501", 26.2, -98.2, "overture", "food", False), ("joes grill", None, False, "12", "MAIN ST", None, "78501", 27.2, -98.2, "overture", "food", False), 0, "distinct"),
    (5, ("alpha beta", None, False, None, None, None, "78501", None, None, None, "food", False), ("gamma delta", None, False, None, None, None, "78501", None, None, None, "retail", False), 0, "ignore"),
    (6, ("joes grill", "+19562345678", True, None, None, None, "78501", None, None, None, None, False), ("joes grill", "+19562345678", True, None, None, None, "78501", None, None, None, None, False), 94, "review"),
]


@query(_cases([(p[0], p[3], p[4]) for p in _PAIRS], "kind, score, band", "part", "p_partkey").replace("p_partkey AS id", "p_partkey AS pair"))
def pair_score_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [x.split()[0] for x in _SIDE.split(", ")]
    sides = F.broadcast(spark.createDataFrame([(i, at, *p[1 + at]) for i, p in enumerate(_PAIRS) for at in (0, 1)], f"case long, at long, {_SIDE}"))  # twelve rows
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair"), (F.col("p_partkey") % len(_PAIRS)).alias("case"))
    rows = parts.join(sides, "case").select((2 * F.col("pair") + F.col("at")).alias("id"), *names)
    scored = resolve.score(resolve.sides(parts.select((2 * F.col("pair")).alias("left_id"), (2 * F.col("pair") + 1).alias("right_id")), rows))
    return scored.select(F.floor(F.col("left_id") / 2).cast("long").alias("pair"), "score", "band").withColumn("kind", F.col("pair") % len(_PAIRS) + 1)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '+1956' || (2000000 + c_custkey)::VARCHAR END AS e164, c_custkey % 4 IN (1, 2) AS blockable FROM customer WHERE c_custkey % 4 < 3
UNION ALL SELECT c_custkey, '+1800' || (2000000 + c_custkey)::VARCHAR, false FROM customer WHERE c_custkey % 4 = 3""")
def pick_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    local, free, bad = F.concat(F.lit("956"), (2_000_000 + k).cast("string")), F.concat(F.lit("1-800-"), (2_000_000 + k).cast("string")), F.lit("12")
    phones = F.when(k % 4 == 0, F.array(bad)).when(k % 4 == 1, F.array(free, local)).when(k % 4 == 2, F.array(bad, local, free)).otherwise(F.array(bad, free))
    picked = keys.picked_phone(phones)
    return read(spark, sf_dir, "customer").select("c_custkey", picked["e164"].alias("e164"), F.coalesce(picked["blockable"], F.lit(False)).alias("blockable"))


@query("""SELECT p_partkey, p_partkey || '-' || p_size AS external_id, CASE WHEN p_size < 1000 THEN lpad(p_size::VARCHAR, 3, '0') END AS county, p_size::VARCHAR AS bare, upper(trim(regexp_replace('  ' || p_name || ' x ', '\\s+', ' ', 'g'))) AS city,
  (lpad(p_size::VARCHAR, 3, '0') >= '010' AND lpad(p_size::VARCHAR, 3, '0') < '020') OR (lpad(p_size::VARCHAR, 3, '0') >= '040' AND lpad(p_size::VARCHAR, 3, '0') < '045') AS wanted FROM part""")
def permit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    padded = keys.county_padded(size)
    return read(spark, sf_dir, "part").select(
        "p_partkey", keys.external_id(F.col("p_partkey").cast("string"), size).alias("external_id"), padded.alias("county"), keys.county_bare(padded).alias("bare"),
        keys.folded(F.concat(F.lit("  "), "p_name", F.lit(" x "))).alias("city"), keys.in_code_ranges(padded, [("010", "020"), ("040", "045")]).alias("wanted"),
    )


@query("""SELECT c_custkey, sha256('{"c_mktsegment":' || coalesce('"' || s || '"', 'null') || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS payload_hash FROM (SELECT *, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS s FROM customer)""")
def canonical_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return c.select("c_custkey", keys.payload_hash("c_nationkey", "c_name", "c_mktsegment").alias("payload_hash"))


@query("""SELECT event_id, strftime(a, '%Y-%m-%d') AS next_start, strftime(a AT TIME ZONE 'America/Chicago' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS reset, strftime(s AT TIME ZONE 'America/Chicago' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS started
FROM (SELECT event_id, date_trunc('month', l)::TIMESTAMP AS s, (date_trunc('month', l) + INTERVAL 1 MONTH)::TIMESTAMP AS a FROM (SELECT event_id, (ts + INTERVAL 40 DAY) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago' AS l FROM events))""")
def period_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.expr("ts + interval 40 day")  # windows on both sides of the clock change of March
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf_dir, "events").select("event_id", report.next_period_start(later).cast("string").alias("next_start"), text(report.period_reset(later)).alias("reset"), text(report.period_window(later)["start"]).alias("started"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN strftime(make_timestamp(c_custkey * 86401000000), '%Y-%m-%dT%H:%M:%SZ') END AS source_version FROM customer""")
def dataset_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("at", F.when(F.col("c_acctbal") >= 0, F.col("c_custkey") * 86_401).otherwise(-1))
    return report.source_version(c, "at").select("c_custkey", "source_version")


# lists and details


@query(f"""WITH {_FIRMS}, f AS (SELECT * FROM firms WHERE contains(lower(name), '1') AND cluster_key IS NOT NULL AND status = 'active' AND id NOT IN (31, 41))
SELECT id, key, name, cluster_key, status, (SELECT count(*) FROM f) AS total FROM f ORDER BY name, id LIMIT 40 OFFSET 20""")
def business_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screens.listed(firms(spark, sf_dir), "1", state="active", excluded="31,41").where("cluster_key is not null")
    return screens.page(found, ["name", "id"], 40, 20).select("id", "key", "name", "cluster_key", "status", "total")


@query(f"""WITH {_FIRMS} SELECT 'none' AS filter, count(*) FILTER (cluster_key IS NULL) AS n FROM firms UNION ALL SELECT 'BUILDING', count(*) FILTER (cluster_key = 'BUILDING') FROM firms
UNION ALL SELECT status, count(*) FROM firms GROUP BY 1 UNION ALL SELECT 'accent', count(*) FILTER (c_custkey % 5 < 3) FROM customer UNION ALL SELECT 'sign', count(*) FILTER (c_custkey % 5 = 3) FROM customer""")
def business_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = firms(spark, sf_dir)
    hard = _dealt(read(spark, sf_dir, "customer"), "c_custkey", ["Café Olé", "CAFE OLE", "Bar", "100% cotton", "100 cotton"]).withColumnRenamed("raw", "name")
    hard = hard.withColumn("key", F.when(F.col("name") == "Bar", "CAFÉ").otherwise(F.concat(F.lit("A"), F.col("id").cast("string"))))
    hard = hard.withColumns({c: F.lit(None).cast("string") for c in ("cluster_key", "merged_into", "closed_at")})
    counted = [("none", screens.listed(f, cluster="none")), ("BUILDING", screens.listed(f, cluster="BUILDING")), *[(s, screens.listed(f, state=s)) for s in ("active", "closed", "merged_away")], ("accent", screens.listed(hard, "café")), ("sign", screens.listed(hard, "0%"))]
    out = None
    for name, rows in counted:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("filter"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 30 ORDER BY n DESC, p_name""")
def statewide_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.grouped_having(read(spark, sf_dir, "part"), "p_name", 30)


_DETAIL = """s AS (SELECT o_custkey AS business_id, o_orderpriority AS source, max(o_orderkey) AS seen_run FROM orders GROUP BY 1, 2), r AS (SELECT o_orderpriority AS source, max(o_orderkey) AS last_run FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
d AS (SELECT business_id, '[' || string_agg('{"source":"' || s.source || '","seen_run":' || seen_run || '}', ',' ORDER BY s.source) || ']' AS sources, count(*) AS n_sources, bool_or(coalesce(last_run > seen_run, false)) AS stale FROM s LEFT JOIN r USING (source) GROUP BY 1)"""


@query(f"""WITH {_FIRMS}, {_DETAIL}, m AS (SELECT merged_into AS id, count(*) AS absorbed, string_agg('K' || id, ',') AS aliases FROM firms WHERE merged_into IS NOT NULL GROUP BY 1)
SELECT f.id, status, coalesce(sources, '[]') AS sources, coalesce(n_sources, 0) AS n_sources, coalesce(absorbed, 0) AS absorbed, coalesce(aliases, '') AS aliases, coalesce(stale, false) AS stale FROM firms f LEFT JOIN d ON d.business_id = f.id LEFT JOIN m ON m.id = f.id""")
def business_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, f = read(spark, sf_dir, "orders"), firms(spark, sf_dir)
    sources = o.groupBy(F.col("o_custkey").alias("business_id"), F.col("o_orderpriority").alias("source")).agg(F.max("o_orderkey").alias("seen_run"))
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("source"), (F.col("o_orderstatus") == "F").alias("complete"))
    gone = f.where("merged_into is not null")
    merges = gone.select(F.col("merged_into").alias("winner"), F.col("id").alias("loser"), F.lit(False).alias("undone"))
    return screens.detailed(f, sources, merges, gone.select(F.col("merged_into").alias("business_id"), F.col("key").alias("alias")), runs)


@query(f"""WITH {_FIRMS}, l AS (SELECT cluster_key, count(*) AS n FROM firms WHERE merged_into IS NULL AND cluster_key IS NOT NULL GROUP BY 1)
SELECT f.id, CASE WHEN f.cluster_key = 'BUILDING' THEN 777 ELSE n END AS badge FROM firms f LEFT JOIN l USING (cluster_key)""")
def chain_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    statewide = spark.createDataFrame([("BUILDING", 777), ("BUILDING", 7)], "name_norm string, n long")
    return screens.chain_badges(firms(spark, sf_dir).withColumnRenamed("cluster_key", "chain_key"), statewide)


@query(f"""WITH {_FIRMS} SELECT key, name AS display_name, cluster_key, closed_at, id FROM firms WHERE merged_into IS NULL""")
def public_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.exported(firms(spark, sf_dir).withColumnRenamed("name", "display_name").withColumn("phone_private", F.lit("secret")))


# reviews

_TIES = """a AS (SELECT o_orderkey AS place_id, o_custkey AS business_id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey + (o_orderkey % 2) END AS tied_with FROM orders WHERE o_orderstatus = 'P')"""


@query(f"""WITH {_FIRMS}, {_TIES}, r AS (SELECT a.*, coalesce(b.merged_into, b.id) AS own, coalesce(t.merged_into, t.id) AS other FROM a LEFT JOIN firms b ON b.id = business_id LEFT JOIN firms t ON t.id = tied_with)
SELECT place_id, business_id, f.id AS tied_id, f.name AS tied_name FROM r LEFT JOIN firms f ON f.id = CASE WHEN other IS DISTINCT FROM own THEN other END""")
def tie_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    tied = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey") + F.col("o_orderkey") % 2)
    return screens.tie_partners(o.select(F.col("o_orderkey").alias("place_id"), F.col("o_custkey").alias("business_id"), tied.alias("tied_with")), firms(spark, sf_dir))


@query("""SELECT CASE k WHEN 0 THEN 'pair' ELSE 'listing' END AS kind, ref, score, skipped FROM (SELECT 0 AS k, p_partkey AS ref, p_size::BIGINT AS score, p_partkey % 9 = 0 AS skipped FROM part UNION ALL SELECT 1, s_suppkey, (s_suppkey % 60)::BIGINT, s_suppkey % 7 = 0 FROM supplier) ORDER BY skipped, score DESC, k, ref""")
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), F.col("p_size").cast("long").alias("score"), (F.col("p_partkey") % 9 == 0).alias("skipped"))
    listings = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref"), (F.col("s_suppkey") % 60).cast("long").alias("score"), (F.col("s_suppkey") % 7 == 0).alias("skipped"))
    return screens.review_queue(pairs, listings)


@query(f"""WITH {_FIRMS}, p AS (SELECT o_orderpriority AS band, o_custkey AS l, o_custkey + (o_orderkey % 2) AS r FROM orders WHERE o_orderstatus <> 'F')
SELECT band, count(*) AS remaining FROM p JOIN firms a ON a.id = l JOIN firms b ON b.id = r WHERE coalesce(a.merged_into, a.id) <> coalesce(b.merged_into, b.id) GROUP BY 1""")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    pairs = o.select(F.col("o_orderpriority").alias("band"), F.col("o_custkey").alias("left_id"), (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("right_id"), F.when(F.col("o_orderstatus") == "F", "merged").alias("decision"))
    return screens.review_remaining(pairs, firms(spark, sf_dir))


# runs and sources


@query("""WITH l AS (SELECT l_orderkey AS run_id, count(*) AS searches, count(*) FILTER (l_linestatus = 'F') AS done, sum(l_quantity::BIGINT)::BIGINT AS results, count(*) FILTER (l_quantity >= 45) AS saturated, count(*) FILTER (l_returnflag = 'A') AS attached,
  count(*) FILTER (l_returnflag = 'R') AS tentative, count(*) FILTER (l_returnflag = 'N') AS unmatched, sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::BIGINT AS micros, count(DISTINCT l_partkey) AS requests FROM lineitem GROUP BY 1)
SELECT o_orderkey AS run_id, o_orderstatus AS status, coalesce(searches, 0) AS searches, coalesce(done, 0) AS done, coalesce(results, 0) AS results, coalesce(saturated, 0) AS saturated, coalesce(attached, 0) AS attached, coalesce(tentative, 0) AS tentative,
  coalesce(unmatched, 0) AS unmatched, coalesce(micros, 0) AS micros, coalesce(requests, 0) AS requests FROM orders LEFT JOIN l ON run_id = o_orderkey""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "run_id")
    searches = li.select("run_id", F.when(F.col("l_linestatus") == "F", "done").otherwise("open").alias("status"), F.col("l_quantity").cast("long").alias("results"), (F.col("l_quantity") >= 45).alias("saturated"))
    outcome = F.when(F.col("l_returnflag") == "A", "attached").when(F.col("l_returnflag") == "R", "tentative").otherwise("unmatched")
    ledger = li.select("run_id", F.col("l_partkey").alias("request_id"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("micros"))
    return screens.run_report(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status")), searches, li.select("run_id", outcome.alias("outcome")), ledger)


@query("""WITH r AS (SELECT o_orderpriority AS source, count(*) AS runs, max(o_orderdate) FILTER (o_orderstatus = 'F') AS last_complete, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY 1),
t AS (SELECT o_orderpriority AS source, count(*) AS held, count(*) FILTER (l_shipdate <= TIMESTAMP '1998-01-01') AS expired, min(l_shipdate) AS oldest FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority < '3' GROUP BY 1)
SELECT source, coalesce(runs, 0) AS runs, strftime(last_complete, '%Y-%m-%d') AS last_complete, CASE last_status WHEN 'F' THEN 'complete' ELSE 'open' END AS last_status, coalesce(held, 0) AS held, coalesce(expired, 0) AS expired, strftime(CASE WHEN oldest <= TIMESTAMP '1998-01-01' THEN oldest END, '%Y-%m-%d') AS oldest_expired FROM r LEFT JOIN t USING (source)""")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("open").alias("status"), F.col("o_orderdate").alias("finished"))
    kept = li.join(o.where("o_orderpriority < '3'"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("source"), F.col("l_shipdate").alias("expires_at"))
    out = screens.source_states(o.select(F.col("o_orderpriority").alias("source")).distinct(), runs, kept, F.expr("timestamp_ntz'1998-01-01'"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("last_complete", "oldest_expired")})


@query(f"""WITH {_FIRMS}, a AS (SELECT DISTINCT o_orderkey AS place_id, o_custkey AS business_id FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT l_orderkey AS place_id, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_returnflag = 'N')) AS s, max(l_shipdate) AS seen FROM lineitem GROUP BY 1)
SELECT coalesce(merged_into, id) AS id, count(*) AS places, count(*) FILTER (coalesce(s = 'N', false)) AS operational, strftime(max(seen), '%Y-%m-%d') AS last_seen FROM a JOIN firms ON id = business_id LEFT JOIN o USING (place_id) GROUP BY 1""")
def place_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    attached = o.select(F.col("o_orderkey").alias("place_id"), F.col("o_custkey").alias("business_id"), F.when(F.col("o_orderstatus") == "F", "attached").otherwise("tentative").alias("status"))
    seen = li.select(F.col("l_orderkey").alias("place_id"), F.when(F.col("l_returnflag") == "N", "operational").otherwise("closed").alias("status"), F.col("l_shipdate").alias("seen"), F.col("l_linenumber").alias("obs_id"))
    return screens.place_signals(attached, seen, firms(spark, sf_dir)).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd"))


_OBSERVED = """x AS (SELECT DISTINCT l_orderkey AS place_id, l_shipdate AS t, l_linenumber * 1000 + l_suppkey % 1000 AS obs, CASE WHEN l_returnflag <> 'N' THEN l_linestatus = 'F' END AS site,
  ['own', 'social', 'directory', 'platform_subdomain', 'none'][1 + l_suppkey % 5] AS class, l_partkey AS k FROM lineitem)"""


@query(f"""WITH {_FIRMS}, {_OBSERVED}, o AS (SELECT o_orderkey AS place_id, o_custkey AS business_id FROM orders WHERE o_orderstatus <> 'O'),
m AS (SELECT place_id, max({{'t': t, 'obs': obs, 'known': coalesce(site::INT, -1), 'class': class, 'site': site}}) AS v FROM x GROUP BY 1),
j AS (SELECT coalesce(merged_into, id) AS id, v.t AS t, v.obs AS obs, v.site AS site, v.class AS class FROM o JOIN m USING (place_id) JOIN firms ON id = business_id)
SELECT id, bool_or(site) AS had_website, arg_max(class, (coalesce(site, true)::INT, t, obs)) AS host_class, strftime(max(t), '%Y-%m-%d') AS observed_at, count(*) AS listings FROM j GROUP BY 1""")
def website_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    attached = o.select(F.col("o_orderkey").alias("place_id"), F.col("o_custkey").alias("business_id"), F.when(F.col("o_orderstatus") == "O", "tentative").otherwise("attached").alias("status"))
    classes = F.array(*map(F.lit, ("own", "social", "directory", "platform_subdomain", "none")))
    observed = li.select(
        F.col("l_orderkey").alias("place_id"), F.col("l_shipdate").alias("observed_at"), (F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 1000).alias("obs_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_linestatus") == "F").alias("had_website"), F.element_at(classes, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("host_class"),
    )
    observed = observed.join(attached.select("place_id", "business_id"), "place_id")
    return screens.website_signals(attached, observed, firms(spark, sf_dir)).withColumn("observed_at", F.date_format("observed_at", "yyyy-MM-dd"))


# money

_REQUESTS = """q AS (SELECT o_orderkey AS request_id, o_custkey AS period, floor(o_totalprice * 100 + 0.5)::BIGINT AS micros, o_orderdate AS expires_at,
  CASE WHEN o_orderkey % 5 = 0 THEN 'settled' WHEN o_orderkey % 5 = 1 THEN 'released' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'expired' ELSE 'open' END AS state FROM orders)"""


def _reservations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reservations in their states, and the ledger; a third of the settled requests had been released before, and are late."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("period"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("micros"), F.col("o_orderdate").alias("expires_at"))
    ledger = o.where("request_id % 5 = 0").select("request_id", (F.col("micros") + F.when(F.col("request_id") % 2 == 0, 7).otherwise(-7)).alias("micros"))
    released = o.where("request_id % 5 = 1 or request_id % 15 = 0").select("request_id")
    return meter.open_reservations(o, ledger, released, F.expr("timestamp_ntz'1998-01-01'")), ledger


@query(f"""WITH {_REQUESTS} SELECT period, sum(CASE WHEN state = 'open' THEN micros ELSE 0 END)::BIGINT AS reserved, coalesce(sum(CASE WHEN state = 'settled' THEN micros + CASE WHEN request_id % 2 = 0 THEN 7 ELSE -7 END END), 0)::BIGINT AS spent,
  count(*) FILTER (state = 'settled' AND request_id % 2 = 0) AS overruns FROM q GROUP BY 1""")
def reservation_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meter.period_balance(*_reservations(spark, sf_dir), "period")


@query(f"""WITH {_REQUESTS} SELECT request_id, 7::BIGINT AS over FROM q WHERE state = 'settled' AND request_id % 2 = 0""")
def overrun_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meter.overrun_events(*_reservations(spark, sf_dir))


@query("""WITH u AS (SELECT ['ts_essentials', 'ts_pro', 'ts_enterprise', 'pd_essentials'][1 + o_custkey % 4] AS unit, count(*) AS requests FROM orders GROUP BY 1), b AS (SELECT * FROM (VALUES ('ts_essentials', 0, NULL), ('ts_pro', 32000, 5000), ('ts_enterprise', 35000, 1000), ('pd_essentials', 5000, 10000)) AS t(unit, price, free)),
j AS (SELECT unit, requests, CASE WHEN free IS NOT NULL THEN greatest(0, free - CASE unit WHEN 'ts_pro' THEN 4990 WHEN 'ts_enterprise' THEN 2000 ELSE 0 END) END AS free_left, price FROM u JOIN b USING (unit))
SELECT unit, requests, free_left::BIGINT AS free_left, CASE WHEN free_left IS NULL THEN 0 ELSE greatest(0, requests - free_left) * price END::BIGINT AS micros FROM j""")
def price_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("ts_essentials", "ts_pro", "ts_enterprise", "pd_essentials"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    usage = read(spark, sf_dir, "orders").groupBy(unit.alias("unit")).agg(F.count("*").alias("requests"))
    return meter.priced_by_unit(usage, spark.createDataFrame([("ts_pro", 4990), ("ts_enterprise", 2000)], "unit string, used long"))


@query("""WITH c AS (SELECT n_name AS k, 1 + n_nationkey % 5 AS types, n_nationkey % 3 AS known, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) % 4 = 2 AS mine FROM nation),
l AS (SELECT 'full' AS line, types AS low, types * 9 AS high FROM c UNION ALL SELECT 'partition', types, types * 9 FROM c WHERE mine UNION ALL SELECT 'check', known, known * 3 FROM c WHERE known > 0),
s AS (SELECT line, count(*) AS cells, sum(low)::BIGINT AS requests_low, sum(high)::BIGINT AS requests_high FROM l GROUP BY 1)
SELECT *, greatest(0, requests_low - 10) * 35000 AS micros_low, greatest(0, requests_high - 10) * 35000 AS micros_high FROM s""")
def run_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return screens.run_cost_lines(read(spark, sf_dir, "nation").select(F.col("n_name").alias("cell_key"), (1 + n % 5).alias("types"), (n % 3).alias("known")), used=990, week=6)


@query("""WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS org, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey AS run_id, CASE WHEN r.run_id IS NULL THEN 'complete' WHEN n = 1 THEN 'admitted' ELSE 'refused' END AS state, CASE WHEN n = 1 THEN 2 * floor(o_totalprice * 100 + 0.5)::BIGINT END AS ceiling FROM orders LEFT JOIN r ON r.run_id = o_orderkey""")
def run_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("org"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("queued").alias("status"), F.col("o_orderdate").alias("queued_at"), F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("heartbeat"))
    estimates = o.select(F.col("o_orderkey").alias("run_id"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("micros"))
    return screens.admission(sweep.admitted(runs, F.lit("1990-01-01").cast("timestamp")), estimates)


# sources of a merge, its effects and their undoing


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS business_id, o_orderkey % 2 = 0 AS place, o_custkey || ' Main' AS street FROM orders)
SELECT business_id, id, CASE WHEN place THEN 'place' ELSE 'permit' END AS source, CASE WHEN place THEN 'P' ELSE 'O' END || id AS name, CASE WHEN place THEN '+1' || id END AS phone, street, '78501' AS postal, CASE WHEN place THEN 26.5 WHEN id % 3 = 1 THEN 26.25 END::DOUBLE AS lat, CASE WHEN place THEN -98.5 WHEN id % 3 = 1 THEN -98.25 END::DOUBLE AS lng,
  CASE WHEN place THEN 'place' WHEN id % 3 = 1 THEN 'census_exact' END AS match_type FROM r""")
def source_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, street = F.col("o_orderkey").cast("string"), F.concat(F.col("o_custkey").cast("string"), F.lit(" Main"))
    place = F.to_json(F.struct(F.concat(F.lit("P"), k).alias("name"), F.concat(F.lit("+1"), k).alias("phone"), street.alias("street"), F.lit("78501").alias("postal"), F.lit(26.5).alias("lat"), F.lit(-98.5).alias("lng")))
    permit = F.to_json(F.struct(F.concat(F.lit("O"), k).alias("outlet_name"), street.alias("outlet_address"), F.lit("78501").alias("outlet_zip_code")))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("business_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "place").otherwise("permit").alias("source"), F.when(F.col("o_orderkey") % 2 == 0, place).otherwise(permit).alias("payload"), street.alias("street"))
    # the geocodes of two thirds of the records were made of an older address
    geocodes = o.select(F.col("id").alias("record_id"), F.sha2(F.concat(F.when(F.col("id") % 3 == 1, F.col("street")).otherwise(F.lit("old")), F.lit("|78501")), 256).alias("input_hash"), F.lit(26.25).alias("lat"), F.lit(-98.25).alias("lng"), F.lit("census_exact").alias("match_type"))
    return screens.source_views(o.drop("street"), geocodes)


_MERGES = "m AS (SELECT c_custkey AS merge_id, c_custkey - 1 AS winner, c_custkey AS loser FROM customer WHERE c_custkey % 17 IN (5, 6) AND c_custkey > 17)"


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two merges in a row: 5 into 4 and 6 into 5 of every 17."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").where((k % 17).isin(5, 6) & (k > 17)).select(k.alias("merge_id"), (k - 1).alias("winner"), k.alias("loser"))


@query(f"""WITH {_FIRMS}, w AS (SELECT c_custkey AS merge_id, c_custkey - 2 AS winner, c_custkey - 1 AS loser FROM customer WHERE c_custkey % 17 = 0 AND c_custkey > 0),
x AS (SELECT f.id, w.winner AS merged_into FROM firms f JOIN w ON w.loser = coalesce(f.merged_into, f.id))
SELECT 'parent' AS kind, id AS of, merged_into::VARCHAR AS value FROM x UNION ALL SELECT 'alias', winner, 'K' || loser FROM w
UNION ALL SELECT 'audit', merge_id, '{{"id":' || loser || ',"key":"K' || loser || '","merged_into":null}}' FROM w""")
def merge_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the roots of every 17th business are merged in turn, so what is under them moves too
    f = firms(spark, sf_dir)
    merges = f.where("id % 17 = 0 and id > 0").select(F.col("id").alias("merge_id"), (F.col("id") - 2).alias("winner"), (F.col("id") - 1).alias("loser"))
    moved, aliases, audit = screens.merge_effects(f, merges)
    text = lambda df, kind, of, value: df.select(F.lit(kind).alias("kind"), F.col(of).alias("of"), F.col(value).cast("string").alias("value"))
    return text(moved, "parent", "id", "merged_into").unionByName(text(aliases, "alias", "business_id", "alias")).unionByName(text(audit, "audit", "merge_id", "before"))


@query(f"""WITH {_MERGES} SELECT c_custkey AS id, CASE WHEN c_custkey > 17 AND c_custkey % 17 = 6 THEN CASE WHEN c_custkey % 2 = 0 THEN c_custkey - 1 ELSE c_custkey - 2 END WHEN c_custkey > 17 AND c_custkey % 17 = 5 AND c_custkey % 2 = 0 THEN c_custkey - 1 END AS merged_into FROM customer""")
def merge_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the merges of odd fives are undone: what was under them follows them
    m = _merges(spark, sf_dir)
    return queue.subtree_restored(firms(spark, sf_dir), m, m.where("merge_id % 17 = 5 and merge_id % 2 = 1").select("merge_id"))


# scopes

_SCOPED = (_BIZ + _BLOCKS).replace("7, '0') AS phone", "7, '0') || '/' || (p_partkey % 3) AS phone").replace("p_brand AS postal,", "p_brand || '/' || (p_partkey % 3) AS postal,").replace("cluster_key FROM part)", "cluster_key FROM part WHERE p_partkey % 13 > 0)")


@query(f"WITH {_SCOPED} SELECT left_id, right_id, CASE r WHEN 1 THEN 'phone' WHEN 2 THEN 'address' ELSE 'trigram' END AS block FROM cand")
def tenant_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return resolve.candidates(businesses(spark, sf_dir).withColumns({"org_id": k % 3, "merged_into": F.when(k % 13 == 0, k - 1)}))
