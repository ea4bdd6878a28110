"""Queries over stored snapshots and fixture cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinewright.core import read, scratch
from spinewright.operators import ingest, snapshots
from spinewright.sources import seeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_BATCHES = """a AS (SELECT o_orderkey, o_orderpriority AS payload FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS payload FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey IS NOT NULL AS first, b.o_orderkey IS NOT NULL AS again, a.payload AS was, b.payload AS now FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"""


def _store(spark: SparkSession, sf_dir: str) -> str:
    """Two batches of orders and a replay of the first, in a store of 32 buckets."""
    path, o = scratch(spark, "store"), read(spark, sf_dir, "orders")
    changed = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority"))
    batch = lambda rows, payload, day: rows.select("o_orderkey", payload.alias("payload"), F.md5(payload).alias("payload_hash"), F.lit(day).alias("fetched_at"), F.lit(day).alias("last_seen_at"))
    first = batch(o.where("o_orderdate < timestamp_ntz'1997-01-01'"), F.col("o_orderpriority"), "2024-01-01")
    second = batch(o.where("o_orderdate >= timestamp_ntz'1995-01-01'"), changed, "2024-02-01")
    rule = snapshots.hash_gated(["payload"], ["last_seen_at"])
    for number, rows in ((1, first), (2, second), (1, first)):
        snapshots.upsert_into(path, rows, ["o_orderkey"], number, rule, 32)
    return path


@query(f"""WITH {_BATCHES} SELECT o_orderkey, CASE WHEN again THEN now ELSE was END AS payload, md5(CASE WHEN again THEN now ELSE was END) AS payload_hash,
CASE WHEN first THEN '2024-01-01' ELSE '2024-02-01' END AS fetched_at, CASE WHEN again THEN '2024-02-01' ELSE '2024-01-01' END AS last_seen_at FROM j""")
def stored_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot(spark, _store(spark, sf_dir))


@query(f"""WITH {_BATCHES} SELECT 1::BIGINT AS batch, count(*) AS inserted, 0::BIGINT AS changed, 0::BIGINT AS unchanged FROM a
UNION ALL SELECT 2, count(*) FILTER (NOT first), count(*) FILTER (first AND was <> now), count(*) FILTER (first AND was = now) FROM j WHERE again""")
def stored_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.tallies(spark, _store(spark, sf_dir)).withColumn("batch", F.col("batch").cast("long"))


_KINDS = "['attached', 'tentative', 'rejected', 'unmatched']"


@query(f"""WITH a AS (SELECT event_id, {_KINDS}[1 + event_id % 4] AS status, CASE WHEN event_id % 10 = 0 THEN 'confirmed' ELSE 'score' END AS reason, event_id % 101 AS score FROM events WHERE event_id % 3 < 2),
b AS (SELECT event_id, {_KINDS}[1 + event_id // 4 % 4] AS status, 'score' AS reason, event_id % 97 AS score FROM events WHERE event_id % 3 > 0)
SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN keep THEN a.status ELSE b.status END AS status, CASE WHEN keep THEN a.reason ELSE b.reason END AS reason, CASE WHEN keep THEN a.score ELSE b.score END AS score, CASE WHEN whole THEN 1 ELSE 2 END AS run
FROM (SELECT *, whole OR coalesce(a.status = 'attached' AND b.status <> 'attached', false) AS keep FROM (SELECT a, b, b.event_id IS NULL OR coalesce(a.status = 'rejected' OR a.reason = 'confirmed', false) AS whole FROM a FULL JOIN b ON a.event_id = b.event_id))""")
def stored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, e, k = scratch(spark, "store"), read(spark, sf_dir, "events"), F.col("event_id")
    kinds = F.array(*map(F.lit, ("attached", "tentative", "rejected", "unmatched")))
    batch = lambda rows, kind, reason, score, run: rows.select("event_id", F.element_at(kinds, (kind + 1).cast("int")).alias("status"), reason.alias("reason"), score.alias("score"), F.lit(run).alias("run"))
    first = batch(e.where("event_id % 3 < 2"), k % 4, F.when(k % 10 == 0, "confirmed").otherwise("score"), k % 101, 1)
    second = batch(e.where("event_id % 3 > 0"), F.floor(k / 4) % 4, F.lit("score"), k % 97, 2)
    for number, rows in ((1, first), (2, second)):
        snapshots.upsert_into(path, rows, ["event_id"], number, snapshots.decisions_kept(), 16)
    return snapshots.snapshot(spark, path)


def _cut_rules() -> list[tuple[str, str, int, bool]]:
    """Nineteen rules that overlap: multiples of small numbers, brands, sizes, and all the rest."""
    rules = [(f"multiple_{i}", f"p_partkey % {i} = 0", i % 5 + 2, True) for i in range(2, 12)]
    rules += [(f"size_{i}", f"p_size BETWEEN {5 * i} AND {5 * i + 6}", 4, True) for i in range(7)]
    return [*rules, ("never", "p_size < 0", 3, False), ("rest", "p_partkey >= 0", 125, True)]


def _cut_sql() -> str:
    ctes, names = [], []
    for i, (group, where, n, _) in enumerate(_cut_rules()):
        earlier = " UNION ALL ".join(f"SELECT p_partkey FROM {x}" for x in names) or "SELECT NULL::BIGINT WHERE false"
        ctes.append(f"g{i} AS MATERIALIZED (SELECT '{group}' AS grp, p_partkey FROM (SELECT * FROM p WHERE {where} ORDER BY d, p_partkey LIMIT {3 * n + 10}) WHERE NOT banned AND p_partkey NOT IN ({earlier}) ORDER BY d, p_partkey LIMIT {n})")
        names.append(f"g{i}")
    return f"WITH p AS MATERIALIZED (SELECT p_partkey, p_size, md5(p_partkey::VARCHAR) AS d, p_brand LIKE '%1' AS banned FROM part), {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT * FROM {x}" for x in names)


@query(_cut_sql())
def fixture_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules: list[tuple[str, Column, int, bool]] = [(g, F.expr(w), n, required) for g, w, n, required in _cut_rules()]
    return ingest.cut_sample(read(spark, sf_dir, "part"), rules, "p_partkey", F.col("p_brand").like("%1")).select(F.col("group").alias("grp"), "p_partkey")


def _seed_folder(spark: SparkSession, sf_dir: str, nations: int) -> str:
    """Seed files of the first ``nations`` nations as counties, regions as clusters and their suppliers as cities."""
    path, n = scratch(spark, "seeds"), read(spark, sf_dir, "nation").where(F.col("n_nationkey") < nations)
    fips = F.lpad(F.col("n_nationkey").cast("string"), 5, "4")
    s = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    cluster, r = F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))), read(spark, sf_dir, "region")
    k = F.col("r_regionkey")
    rows = {
        "counties": ("counties", n.select(fips.alias("fips"), fips.alias("countyFips"), F.lit("1").alias("comptrollerCode"), F.col("n_name").alias("name"), (F.col("n_regionkey") == 1).alias("isRgv"), F.col("n_regionkey").alias("outletCount"))),
        "clusters": ("clusters", r.select(cluster.alias("key"), F.col("r_name").alias("displayName"), k.cast("int").alias("sortOrder"), F.array(F.struct((k * 10).alias("lo"), (k * 10 + 5).alias("hi"))).alias("naicsRanges"), F.slice(F.array(F.lit("bar"), F.lit("cafe"), F.lit("spa")), 1, (k % 3 + 1).cast("int")).alias("placesTypes"))),
        "cities": ("cities", s.select(fips.alias("countyFips"), F.col("s_name").alias("name"), F.array("s_name").alias("nameVariants"), F.col("s_suppkey").alias("outletCount"))),
        "outlet-counts": ("outletCounts", n.crossJoin(F.broadcast(r)).select(F.lit("county").alias("scope"), fips.alias("countyFips"), cluster.alias("clusterKey"), (F.col("n_nationkey") * 10 + k).alias("outlets")).unionByName(r.select(F.lit("state").alias("scope"), F.lit(None).cast("string").alias("countyFips"), cluster.alias("clusterKey"), k.alias("outlets")))),
        "geo-presets": ("geoPresets", s.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(fips.alias("countyFips"), F.col("s_name").alias("name")))).alias("cities")).select(F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("key"), F.lit("P").alias("displayName"), F.lit("cities").alias("kind"), "cities", F.lit(None).cast("array<string>").alias("counties"))
                        .unionByName(n.agg(F.sort_array(F.collect_list(fips)).alias("counties")).select(F.lit("all").alias("key"), F.lit("All").alias("displayName"), F.lit("counties").alias("kind"), F.lit(None).cast("array<struct<countyFips string, name string>>").alias("cities"), "counties"))),
        "overture-categories": ("categories", read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("rows")).select(F.col("p_brand").alias("basicCategory"), F.lit("asia").alias("clusterKey"), "rows")),
    }
    for name, (array, df) in rows.items():  # a seed file is one small object
        head = [F.lit("2026-09-22").alias("measuredAt"), F.lit("made").alias("source")] if name == "outlet-counts" else []
        one = df.agg(F.collect_list(F.struct(*df.columns)).alias(array)).select(*head, array)
        one.select(F.to_json(F.struct(*one.columns)).alias("value")).coalesce(1).write.text(f"{path}/{name}.json")
    return path


@query("""WITH n AS (SELECT * FROM nation WHERE n_nationkey < 20), s AS (SELECT count(*) AS c, count(DISTINCT n_regionkey) AS p, count(*) FILTER (n_nationkey < 10) AS c1, count(DISTINCT n_regionkey) FILTER (n_nationkey < 10) AS p1 FROM supplier JOIN n ON s_nationkey = n_nationkey),
t AS (SELECT count(*) * 5 AS county, count(*) FILTER (n_nationkey < 10) * 5 AS county1 FROM n), k AS (SELECT sum(1 + 1 + r_regionkey % 3)::BIGINT AS terms FROM region), m AS (SELECT count(DISTINCT p_brand) AS c FROM part)
SELECT 'counties' AS "table", 10 AS inserted, 10 AS updated UNION ALL SELECT 'industry_clusters', 0, 5 UNION ALL SELECT 'industry_terms', 0, terms FROM k UNION ALL SELECT 'cities', c - c1, c1 FROM s
UNION ALL SELECT 'outlet_counts', county - county1, county1 + 5 FROM t UNION ALL SELECT 'geo_presets', p - p1, p1 + 1 FROM s UNION ALL SELECT 'overture_category_map', 0, c FROM m""")
def seed_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _ = seeds.loaded(None, seeds.tables(spark, _seed_folder(spark, sf_dir, 10)))
    return seeds.loaded(stored, seeds.tables(spark, _seed_folder(spark, sf_dir, 20)))[1]


@query("""SELECT 'p' || n_regionkey AS key, (row_number() OVER (PARTITION BY n_regionkey ORDER BY lpad(n_nationkey::VARCHAR, 5, '4'), s_name) - 1)::INT AS place, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'all', (row_number() OVER (ORDER BY lpad(n_nationkey::VARCHAR, 5, '4')) - 1)::INT, n_name FROM nation""")
def seed_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _ = seeds.loaded(None, seeds.tables(spark, _seed_folder(spark, sf_dir, 25)))
    ids = F.from_json("payload", "cityIds array<string>, countyIds array<string>")
    listed = t["geo_presets"].select("key", F.posexplode(F.coalesce(ids["cityIds"], ids["countyIds"])).alias("place", "id"))
    return listed.join(t["cities"].select("id", "name").unionByName(t["counties"].select("id", "name")), "id").select("key", "place", "name")
