"""Entity-resolution queries over ``part`` seen as businesses, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spinewright.core import materialize, read
from spinewright.functions import keys
from spinewright.operators import resolve


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    bn = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    rows = p.select(
        k.alias("id"), F.lower("p_name").alias("name_norm"), F.concat(F.lit("+1956"), F.lpad((k % 400).cast("string"), 7, "0")).alias("phone"), (k % 7 != 0).alias("blockable"),
        F.col("p_size").cast("string").alias("street_num"), F.lower("p_type").alias("street_norm"), F.when(k % 3 == 0, F.concat(F.lit("Ste. #"), (k % 5).cast("string"))).when(k % 3 == 1, F.concat(F.lit("Suite "), (k % 5).cast("string"))).alias("unit"), F.col("p_brand").alias("postal"),
        (25.8 + bn * F.lit(0.03) + F.col("p_size") * F.lit(0.0002) + (k % 10) * F.lit(0.0001)).alias("lat"), (-99.3 + bn * F.lit(0.05) + (k % 7) * F.lit(0.0001)).alias("lng"),
        F.when(k % 11 == 0, "census_non_exact").otherwise("overture").alias("location_match_type"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("cluster_key"),
    )
    members = F.count("*").over(Window.partitionBy("name_norm", "postal", "street_norm"))
    return rows.withColumn("chain", members >= 3)


# The businesses, their blocks, candidates, score and components as common table expressions.
_BIZ = """
biz AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY name_norm, postal, street_norm) >= 3 AS chain FROM (
  SELECT p_partkey AS id, lower(p_name) AS name_norm, '+1956' || lpad((p_partkey % 400)::VARCHAR, 7, '0') AS phone, p_partkey % 7 <> 0 AS blockable,
    p_size::VARCHAR AS street_num, lower(p_type) AS street_norm, CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 5 END AS unit, p_brand AS postal,
    25.8::DOUBLE + regexp_extract(p_brand, '[0-9]+')::INT * 0.03::DOUBLE + p_size * 0.0002::DOUBLE + (p_partkey % 10) * 0.0001::DOUBLE AS lat,
    -99.3::DOUBLE + regexp_extract(p_brand, '[0-9]+')::INT * 0.05::DOUBLE + (p_partkey % 7) * 0.0001::DOUBLE AS lng,
    CASE WHEN p_partkey % 11 = 0 THEN 'census_non_exact' ELSE 'overture' END AS kind, split_part(p_name, ' ', 2) AS cluster_key FROM part)),
names AS (SELECT DISTINCT name_norm AS n FROM biz),
grams AS MATERIALIZED (SELECT n, list_distinct(flatten(list_transform(list_filter(string_split_regex(n, '[^a-z0-9]+'), lambda w: w <> ''),
    lambda w: list_transform(generate_series(1, len(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM names),
sims AS MATERIALIZED (SELECT a.n AS a, b.n AS b, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 6) AS sim FROM grams a, grams b)"""
_BLOCKS = """,
phones AS (SELECT phone, count(*) AS size FROM biz WHERE blockable GROUP BY 1 HAVING count(*) >= 2),
phone_pairs AS (SELECT a.id AS left_id, b.id AS right_id, 'phone:' || a.phone AS block_key, size FROM biz a JOIN biz b ON a.phone = b.phone AND a.id < b.id AND a.blockable AND b.blockable JOIN phones p ON p.phone = a.phone WHERE size * (size - 1) // 2 <= 500),
addresses AS (SELECT postal, street_num, count(*) AS size FROM biz GROUP BY 1, 2 HAVING count(*) >= 2),
address_pairs AS (SELECT a.id AS left_id, b.id AS right_id, 'address:' || a.postal || '|' || a.street_num AS block_key, size, sim AS similarity FROM biz a JOIN biz b ON a.postal = b.postal AND a.street_num = b.street_num AND a.id < b.id
  JOIN addresses d ON d.postal = a.postal AND d.street_num = a.street_num JOIN sims s ON s.a = a.name_norm AND s.b = b.name_norm WHERE size * (size - 1) // 2 <= 500 AND sim >= 0.3),
near AS MATERIALIZED (SELECT * FROM (SELECT a.id, b.id AS other_id, sim AS similarity, row_number() OVER (PARTITION BY a.id ORDER BY sim DESC, b.id) AS rank FROM biz a JOIN biz b ON a.postal = b.postal AND a.id <> b.id JOIN sims s ON s.a = a.name_norm AND s.b = b.name_norm WHERE sim >= 0.45) WHERE rank <= 5),
cand AS MATERIALIZED (SELECT left_id, right_id, min(r) AS r FROM (SELECT left_id, right_id, 1 AS r FROM phone_pairs UNION ALL SELECT left_id, right_id, 2 FROM address_pairs UNION ALL SELECT least(id, other_id), greatest(id, other_id), 3 FROM near) GROUP BY 1, 2)"""
_SCORES = """,
j AS MATERIALIZED (SELECT c.*, a.name_norm AS an, b.name_norm AS bn, sim, a.phone = b.phone AND a.blockable AND b.blockable AS sp, a.postal = b.postal AS po, a.postal = b.postal AND a.street_num = b.street_num AS num,
    a.postal = b.postal AND a.street_num = b.street_num AND a.street_norm = b.street_norm AND coalesce(a.unit = b.unit, true) AS full_address, a.kind <> 'census_non_exact' AND b.kind <> 'census_non_exact' AS promotable, a.cluster_key = b.cluster_key AS sc, a.chain OR b.chain AS chained,
    2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) AS m
  FROM cand c JOIN biz a ON a.id = left_id JOIN biz b ON b.id = right_id JOIN sims s ON s.a = a.name_norm AND s.b = b.name_norm),
s1 AS (SELECT *, CASE WHEN promotable THEN m END AS near_m FROM j),
s2 AS (SELECT *, greatest(0, least(100, floor(45 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (sim - 0.4::DOUBLE) / 0.6::DOUBLE)) + 0.5)::BIGINT + CASE WHEN sp THEN 30 ELSE 0 END + CASE WHEN full_address THEN 30 WHEN num THEN 15 WHEN po THEN 5 ELSE 0 END
      + CASE WHEN near_m <= 100 THEN 15 WHEN near_m <= 500 THEN 10 WHEN near_m <= 2000 THEN 4 ELSE 0 END + CASE WHEN sc THEN 5 ELSE -10 END)) AS base,
    (sim >= 0.85)::INT + sp::INT + full_address::INT + coalesce(near_m <= 100, false)::INT AS own, sp AND po AND sim >= 0.6 AS lift, sp AND po AND sim >= 0.3 AND sim < 0.6 AS hold FROM s1),
s3 AS (SELECT *, CASE WHEN lift THEN greatest(base, 95) WHEN hold THEN least(94, greatest(80, base)) ELSE base END AS lifted, CASE WHEN lift THEN greatest(own, 2) ELSE own END AS signals FROM s2),
s4 AS (SELECT *, CASE WHEN m > 25000 THEN 0 WHEN chained OR signals < 2 OR NOT coalesce(near_m <= 500, false) THEN least(lifted, 94) ELSE lifted END AS score FROM s3),
scored AS MATERIALIZED (SELECT left_id, right_id, CASE r WHEN 1 THEN 'phone' WHEN 2 THEN 'address' ELSE 'trigram' END AS block, sim AS name_similarity, signals::BIGINT AS signals, score::BIGINT AS score,
    CASE WHEN m > 25000 THEN 'distinct' WHEN score >= 95 THEN 'merge' WHEN score >= 80 THEN 'review' ELSE 'ignore' END AS band FROM s4)"""
_ROOTS = """,
e AS (SELECT left_id AS a, right_id AS b FROM scored WHERE score >= 80 UNION SELECT right_id, left_id FROM scored WHERE score >= 80),
reach AS (SELECT DISTINCT a AS id, a AS x FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.x),
roots AS (SELECT id, min(x) AS root FROM reach GROUP BY id)"""


def block_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.phone_pairs(businesses(spark, sf_dir))


def block_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.address_pairs(businesses(spark, sf_dir))


def block_trigram_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.nearest_names(businesses(spark, sf_dir))


def block_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = businesses(spark, sf_dir)
    phone = F.when(F.col("blockable"), F.concat(F.lit("phone:"), "phone"))
    return resolve.skipped_blocks(b, F.concat(F.lit("postal:"), "postal")).unionByName(resolve.skipped_blocks(b, phone))


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.candidates(businesses(spark, sf_dir))


def distance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = businesses(spark, sf_dir)
    return resolve.gated(resolve.candidates(b), b)


def pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scored(businesses(spark, sf_dir))


def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_score(spark, sf_dir).groupBy("band").agg(F.count("*").alias("pairs"), F.sum("score").alias("total_score"))


def chain_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.chains(businesses(spark, sf_dir))


def merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merged(materialize(pair_score(spark, sf_dir)), resolve.REVIEW)


def tidy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = materialize(pair_score(spark, sf_dir))
    return resolve.tidied(pairs, materialize(resolve.merged(pairs, resolve.REVIEW)), resolve.REVIEW)


def unmerge_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undo the weakest of the merged pairs, those with the least score, and rebuild."""
    pairs = materialize(pair_score(spark, sf_dir))
    least = pairs.where(F.col("score") >= resolve.REVIEW).agg(F.min("score").alias("score"))
    return resolve.unmerged(pairs, pairs.join(F.broadcast(least), "score"), resolve.REVIEW)  # one row


def survivorship_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").withColumn("returned", F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")))
    order = [-F.col("l_discount"), F.col("l_orderkey"), F.col("l_linenumber")]
    return resolve.survivors(li, "l_partkey", ["l_suppkey", "returned", "l_linestatus"], order)


def similarity_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = businesses(spark, sf_dir).select("name_norm").distinct()
    g = n.withColumn("g", keys.trigrams(F.col("name_norm")))
    return g.select("name_norm", F.size("g").cast("long").alias("grams"), F.round(keys.gram_similarity(F.col("g"), keys.trigrams(F.split_part("name_norm", F.lit(" "), F.lit(1)))), 6).alias("first_word"))


def match_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spinewright.operators.sweep import decided

    s = pair_score(spark, sf_dir)
    both = s.select(F.col("left_id").alias("probe"), F.col("right_id").alias("other"), "score").unionByName(s.select(F.col("right_id").alias("probe"), F.col("left_id").alias("other"), "score"))
    return decided(both, "probe", "score", "other", 90, 80)


_W, _R = f"WITH {_BIZ}{_BLOCKS}", f"WITH RECURSIVE {_BIZ}{_BLOCKS}{_SCORES}{_ROOTS}"
_S = f"WITH {_BIZ}{_BLOCKS}{_SCORES}"
QUERIES = {f.__name__: f for f in (block_phone, block_address, block_trigram_top5, block_skipped, candidate_union, distance_gate, pair_score, band_counts, chain_detect, merge_components, tidy_pairs, unmerge_rebuild, survivorship_pick, similarity_golden, match_decide)}
ORACLES = {
    "block_phone": f"{_W} SELECT left_id, right_id, block_key, size FROM phone_pairs",
    "block_address": f"{_W} SELECT left_id, right_id, block_key, size, similarity FROM address_pairs",
    "block_trigram_top5": f"{_W} SELECT id, other_id, similarity, rank FROM near",
    "block_skipped": f"WITH {_BIZ} SELECT * FROM (SELECT 'postal:' || postal AS block_key, count(*) AS size, count(*) * (count(*) - 1) // 2 AS pairs FROM biz GROUP BY 1 UNION ALL SELECT 'phone:' || phone, count(*), count(*) * (count(*) - 1) // 2 FROM biz WHERE blockable GROUP BY 1) WHERE pairs > 500",
    "candidate_union": f"{_W} SELECT left_id, right_id, CASE r WHEN 1 THEN 'phone' WHEN 2 THEN 'address' ELSE 'trigram' END AS block FROM cand",
    "distance_gate": f"{_S} SELECT left_id, right_id, floor(m + 0.5)::BIGINT AS metres FROM s1 WHERE floor(m + 0.5) > 25000",
    "pair_score": f"{_S} SELECT * FROM scored",
    "band_counts": f"{_S} SELECT band, count(*) AS pairs, sum(score)::BIGINT AS total_score FROM scored GROUP BY band",
    "chain_detect": f"WITH {_BIZ} SELECT name_norm, postal, street_norm, count(*) AS members FROM biz GROUP BY ALL HAVING count(*) >= 3",
    "merge_components": f"{_R} SELECT id, root FROM roots",
    "tidy_pairs": f"""{_R}, p AS (SELECT s.*, coalesce(l.root, left_id) AS left_root, coalesce(r.root, right_id) AS right_root FROM scored s LEFT JOIN roots l ON l.id = left_id LEFT JOIN roots r ON r.id = right_id WHERE score < 80)
        SELECT p.left_id, p.right_id, left_root, right_root, CASE WHEN left_root = right_root THEN 'merged' WHEN d.left_id IS NOT NULL THEN 'distinct' ELSE 'pending' END AS state
        FROM p LEFT JOIN (SELECT left_id, right_id FROM scored WHERE band = 'distinct') d ON d.left_id = least(left_root, right_root) AND d.right_id = greatest(left_root, right_root)""",
    "unmerge_rebuild": _R.replace("WHERE score >= 80", "WHERE score >= 80 AND score > (SELECT min(score) FROM scored WHERE score >= 80)") + " SELECT id, root FROM roots",
    "survivorship_pick": """SELECT l_partkey, arg_min(l_suppkey, (-l_discount, l_orderkey, l_linenumber)) AS l_suppkey, arg_min(l_extendedprice, (-l_discount, l_orderkey, l_linenumber)) FILTER (l_returnflag = 'R') AS returned,
        arg_min(l_linestatus, (-l_discount, l_orderkey, l_linenumber)) AS l_linestatus FROM lineitem GROUP BY 1""",
    "similarity_golden": f"""WITH {_BIZ} , f AS (SELECT n, g, list_distinct(list_transform(generate_series(1, len(split_part(n, ' ', 1)) + 1), lambda i: substr('  ' || split_part(n, ' ', 1) || ' ', i, 3))) AS h FROM grams)
        SELECT n AS name_norm, len(g) AS grams, round(len(list_intersect(g, h))::DOUBLE / len(list_distinct(list_concat(g, h))), 6) AS first_word FROM f""",
    "match_decide": f"""{_S}, b AS (SELECT left_id AS probe, right_id AS other, score FROM scored UNION ALL SELECT right_id, left_id, score FROM scored), w AS (SELECT *, row_number() OVER o AS r, lead(score) OVER o AS second, lead(other) OVER o AS next FROM b WINDOW o AS (PARTITION BY probe ORDER BY score DESC, other))
        SELECT probe, other AS best, score, CASE WHEN second >= 90 THEN next END AS tied, CASE WHEN score >= 90 AND coalesce(second < 90, true) THEN 'attached' WHEN score >= 80 THEN 'tentative' ELSE 'unmatched' END AS outcome FROM w WHERE r = 1""",
}
