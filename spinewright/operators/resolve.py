"""Entity resolution: blocks, gate, score, merge, tidy, survivorship. Businesses are rows with the columns of
``BUSINESS``; candidate pairs have ``left_id < right_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinewright.core import materialize, sized_join
from spinewright.functions import keys
from spinewright.operators.graph import connected_components

BUSINESS = ("id", "name_norm", "phone", "blockable", "street_num", "street_norm", "unit", "postal", "lat", "lng", "location_match_type", "cluster_key", "chain")
PAIR_CAP = 500
ADDRESS_SIMILARITY, NAME_SIMILARITY, TOP = 0.3, 0.45, 5
GATE_M = 25_000
MERGE, REVIEW = 95, 80
#: Businesses up to which a side of pairs is broadcast: some 400 bytes each, far more than their files show.
SIDE_ROWS = 100_000


def live(rows: DataFrame) -> DataFrame:
    """The rows that may be paired, with their ``scope``: merged-away ones (``merged_into``) are left out, and only rows of one
    ``org_id`` meet, where the table has these columns."""
    alive = rows.where(F.col("merged_into").isNull()) if "merged_into" in rows.columns else rows
    scope = F.coalesce(F.col("org_id").cast("string"), F.lit("")) if "org_id" in rows.columns else F.lit("")
    return alive if "scope" in rows.columns else alive.withColumn("scope", scope)


def block_sizes(rows: DataFrame, key: Column) -> DataFrame:
    """``scope, block_key, size, pairs`` of blocks of two or more, known before any pair is formed."""
    counted = live(rows).where(key.isNotNull()).groupBy("scope", key.alias("block_key")).agg(F.count("*").alias("size"))
    return counted.where("size >= 2").withColumn("pairs", F.expr("size * (size - 1) div 2"))


def skipped_blocks(rows: DataFrame, key: Column, cap: int = PAIR_CAP) -> DataFrame:
    """Blocks refused whole for more than ``cap`` pairs, as a report."""
    return block_sizes(rows, key).where(F.col("pairs") > cap).select("block_key", "size", "pairs")


def block_pairs(rows: DataFrame, key: Column, cap: int = PAIR_CAP) -> DataFrame:
    """Pairs within blocks of at most ``cap`` pairs. Oversized blocks are dropped before the self join, so no key
    of the join can be hot."""
    rows = live(rows)
    accepted = block_sizes(rows, key).where(F.col("pairs") <= cap).select("scope", "block_key", "size")
    # trigrams once a row, not once a pair; unused ones are pruned
    inside = rows.withColumns({"block_key": key, "grams": keys.trigrams(F.col("name_norm"))}).join(accepted, ["scope", "block_key"])
    a, b = inside.alias("a"), inside.alias("b")
    return a.join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.block_key") == F.col("b.block_key")) & (F.col("a.id") < F.col("b.id"))).select(
        F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.col("a.block_key").alias("block_key"), F.col("a.size").alias("size"),
        F.col("a.grams").alias("left_grams"), F.col("b.grams").alias("right_grams"),
    )


def phone_pairs(rows: DataFrame, cap: int = PAIR_CAP) -> DataFrame:
    key = F.when(F.col("blockable") & F.col("phone").isNotNull(), F.concat(F.lit("phone:"), F.col("phone")))
    return block_pairs(rows, key, cap).select("left_id", "right_id", "block_key", "size")


def address_pairs(rows: DataFrame, cap: int = PAIR_CAP) -> DataFrame:
    key = F.concat(F.lit("address:"), F.col("postal"), F.lit("|"), F.col("street_num"))
    similar = keys.gram_similarity(F.col("left_grams"), F.col("right_grams"))
    return block_pairs(rows, key, cap).withColumn("similarity", F.round(similar, 6)).where(F.col("similarity") >= ADDRESS_SIMILARITY).select("left_id", "right_id", "block_key", "size", "similarity")


def similar_names(rows: DataFrame, threshold: float = NAME_SIMILARITY) -> DataFrame:
    """``postal, a, b, similarity`` of distinct names of a postal area, each with itself too.

    A prefix-filtered inverted index: of a name's n trigrams only the n - ceil(t n) + 1 rarest are indexed, as two
    names that are similar enough must share one of those. Rare grams keep the index's groups small.
    """
    names = materialize(rows.where("postal is not null and name_norm is not null").select("postal", F.col("name_norm").alias("name")).distinct().withColumn("grams", keys.trigrams(F.col("name"))))
    grams = names.select("postal", "name", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("postal", "name").orderBy("often", "gram"))
    prefix = grams.join(often, "gram").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1).select("postal", "gram", "name")
    pairs = prefix.join(prefix.withColumnRenamed("name", "other"), ["postal", "gram"]).select("postal", F.col("name").alias("a"), F.col("other").alias("b")).distinct()
    left, right = names.select("postal", F.col("name").alias("a"), F.col("grams").alias("ga")), names.select("postal", F.col("name").alias("b"), F.col("grams").alias("gb"))
    scored = pairs.join(left, ["postal", "a"]).join(right, ["postal", "b"]).withColumn("similarity", F.round(keys.gram_similarity(F.col("ga"), F.col("gb")), 6))
    return scored.where(F.col("similarity") >= threshold).select("postal", "a", "b", "similarity")


def nearest_names(rows: DataFrame, top: int = TOP, threshold: float = NAME_SIMILARITY) -> DataFrame:
    """``id, other_id, similarity, rank``: the ``top`` most similar businesses of the same postal area.

    Businesses that share a name share their neighbours, so each name keeps its ``top + 1`` first ids and each
    name's list its ``top + 1`` best: linear in the businesses, however many bear one name.
    """
    rows = live(rows).withColumn("postal", F.concat(F.col("scope"), F.lit("|"), F.col("postal")))
    named = rows.where("postal is not null and name_norm is not null").select("id", "postal", F.col("name_norm").alias("name"))
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("postal", "name").orderBy("id"))).where(F.col("r") <= top + 1)
    order = Window.partitionBy("postal", "a").orderBy(F.desc("similarity"), "other_id")
    best = similar_names(rows, threshold).join(first.select("postal", F.col("name").alias("b"), F.col("id").alias("other_id")), ["postal", "b"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1)
    lists = best.groupBy("postal", "a").agg(F.array_sort(F.collect_list(F.struct("r", "other_id", "similarity"))).alias("list"))  # top + 1 at most
    own = named.join(lists.withColumnRenamed("a", "name"), ["postal", "name"])
    others = F.slice(F.filter("list", lambda x: x["other_id"] != F.col("id")), 1, top)
    return own.select("id", F.posexplode(others).alias("p", "x")).select("id", F.col("x.other_id").alias("other_id"), F.col("x.similarity").alias("similarity"), (F.col("p") + 1).cast("long").alias("rank"))


def candidates(rows: DataFrame, cap: int = PAIR_CAP, stored: bool = False) -> DataFrame:
    """``left_id, right_id, block``: the union of the three blocks of live rows of one scope; the first that names a pair keeps it."""
    rows = live(rows).select("id", "scope", "name_norm", "phone", "blockable", "street_num", "postal")
    # the arms share one narrow table, as what makes the rows may be costly, unless the rows are a stored table
    rows = rows if stored else materialize(rows)
    near = nearest_names(rows).select(F.least("id", "other_id").alias("left_id"), F.greatest("id", "other_id").alias("right_id"), F.lit(3).alias("rank")).distinct()
    union = phone_pairs(rows, cap).select("left_id", "right_id", F.lit(1).alias("rank")).unionByName(address_pairs(rows, cap).select("left_id", "right_id", F.lit(2).alias("rank"))).unionByName(near)
    first = union.groupBy("left_id", "right_id").agg(F.min("rank").alias("rank"))
    return first.select("left_id", "right_id", F.element_at(F.array(F.lit("phone"), F.lit("address"), F.lit("trigram")), F.col("rank")).alias("block"))


def sides(pairs: DataFrame, rows: DataFrame, others: DataFrame | None = None, left: Sequence[str] = (), right: Sequence[str] = ()) -> DataFrame:
    """Each pair with both businesses, as ``l_*`` and ``r_*``, and what :func:`score` compares of them: their names' trigrams as
    numbers and their units, made once a row and not once a pair. The right ones come from ``others`` if given; ``left`` and
    ``right`` are more columns of a side."""

    def side(p: str, of: DataFrame, more: Sequence[str]) -> DataFrame:
        made = [keys.gram_codes(keys.trigrams(F.col("name_norm"))).alias(f"{p}_grams"), keys.unit_identity(F.col("unit")).alias(f"{p}_unit_key")]
        return of.select(*[F.col(c).alias(f"{p}_{c}") for c in (*BUSINESS, *more)], *made)

    others = rows if others is None else others
    l, r = side("l", rows, left), side("r", others, right)  # noqa: E741
    near = sized_join(pairs, l, F.col("left_id") == F.col("l_id"), limit=SIDE_ROWS, rows=rows.count())
    return sized_join(near, r, F.col("right_id") == F.col("r_id"), limit=SIDE_ROWS, rows=others.count())


def distance() -> Column:
    return keys.distance_m(F.col("l_lat"), F.col("l_lng"), F.col("r_lat"), F.col("r_lng"))


def gated(pairs: DataFrame, rows: DataFrame, metres: int = GATE_M) -> DataFrame:
    """Pairs that lie too far apart to be one business."""
    far = sides(pairs, rows).withColumn("metres", keys.half_up(distance()))
    return far.where(F.col("metres") > metres).select("left_id", "right_id", "metres")


def score(joined: DataFrame) -> DataFrame:
    """Adds ``name_similarity``, ``signals``, ``score`` and ``band`` to pairs with both sides: whole numbers only."""
    c, same = F.col, lambda x: F.coalesce(F.col(f"l_{x}") == F.col(f"r_{x}"), F.lit(False))
    sim = F.round(F.coalesce(keys.gram_similarity(c("l_grams"), c("r_grams")), F.lit(0.0)), 6)
    df = joined.withColumns({"name_similarity": sim, "metres": distance()})
    number = same("street_num") & same("postal") & (c("l_street_num") != "")
    located = c("metres").isNotNull()
    promotable = located & (c("l_location_match_type") != "census_non_exact") & (c("r_location_match_type") != "census_non_exact")
    df = df.withColumns({
        "same_phone": same("phone") & c("l_blockable") & c("r_blockable"), "same_address": number & same("street_norm") & (c("l_street_norm") != "") & ~keys.units_conflict(c("l_unit_key"), c("r_unit_key")),
        "close": F.when(promotable, c("metres")),
    })
    name = keys.half_up(45 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c("name_similarity") - 0.4) / 0.6)))
    place = F.when(c("same_address"), 30).when(number, 15).when(same("postal"), 5).otherwise(0)
    near = F.when(c("close") <= 100, 15).when(c("close") <= 500, 10).when(c("close") <= 2000, 4).otherwise(0)
    cluster = F.when(c("l_cluster_key").isNull() | c("r_cluster_key").isNull(), 0).when(same("cluster_key"), 5).otherwise(-10)
    base = F.greatest(F.lit(0), F.least(F.lit(100), name + F.when(c("same_phone"), 30).otherwise(0) + place + near + cluster))
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    signals = yes(c("name_similarity") >= 0.85) + yes(c("same_phone")) + yes(c("same_address")) + yes(c("close") <= 100)
    both = c("same_phone") & same("postal")
    df = df.withColumns({"base": base, "lift": both & (c("name_similarity") >= 0.6), "hold": both & (c("name_similarity") >= 0.3) & (c("name_similarity") < 0.6), "own_signals": signals})
    lifted = F.when(c("lift"), F.greatest("base", F.lit(95))).when(c("hold"), F.least(F.lit(94), F.greatest(F.lit(80), "base"))).otherwise(c("base"))
    n = F.when(c("lift"), F.greatest("own_signals", F.lit(2))).otherwise(c("own_signals"))
    capped = F.coalesce(c("l_chain"), F.lit(False)) | F.coalesce(c("r_chain"), F.lit(False)) | (n < 2) | ~F.coalesce(c("close") <= 500, F.lit(False))
    final = F.when(located & (c("metres") > GATE_M), 0).when(capped, F.least(lifted, F.lit(94))).otherwise(lifted).cast("long")
    band = F.when(located & (c("metres") > GATE_M), "distinct").when(c("score") >= MERGE, "merge").when(c("score") >= REVIEW, "review").otherwise("ignore")
    return df.withColumns({"score": final, "signals": n.cast("long")}).withColumn("band", band)


def scored(rows: DataFrame, cap: int = PAIR_CAP) -> DataFrame:
    rows = materialize(live(rows).select(*BUSINESS, "scope"))
    return score(sides(candidates(rows, cap, stored=True), rows)).select("left_id", "right_id", "block", "name_similarity", "signals", "score", "band")


def chains(rows: DataFrame, least: int = 3) -> DataFrame:
    """Names that ``least`` or more businesses of one place and street share: ``name_norm, postal, street_norm, members``."""
    return live(rows).groupBy("scope", "name_norm", "postal", "street_norm").agg(F.count("*").alias("members")).where(F.col("members") >= least).drop("scope")


def merged(pairs: DataFrame, least: int) -> DataFrame:
    """``id, root`` of the businesses that pairs of ``least`` or more join; the root is the smallest id."""
    return connected_components(pairs.where(F.col("score") >= least), "left_id", "right_id").select(F.col("node").alias("id"), "root")


def unmerged(pairs: DataFrame, undone: DataFrame, least: int) -> DataFrame:
    """Components rebuilt without the undone pairs, which are ruled distinct from then on."""
    return merged(pairs.join(undone.select("left_id", "right_id"), ["left_id", "right_id"], "left_anti"), least)


def tidied(pairs: DataFrame, roots: DataFrame, least: int) -> DataFrame:
    """What becomes of the pairs under ``least``: merged if both now have one root, distinct if their roots' pair has
    been ruled apart, else pending."""
    root = lambda p: roots.select(F.col("id").alias(f"{p}_of"), F.col("root").alias(f"{p}_root0"))
    j = pairs.where(F.col("score") < least).join(root("l"), F.col("left_id") == F.col("l_of"), "left").join(root("r"), F.col("right_id") == F.col("r_of"), "left")
    j = j.withColumns({"left_root": F.coalesce("l_root0", "left_id"), "right_root": F.coalesce("r_root0", "right_id")})
    apart = pairs.where("band = 'distinct'").select(F.col("left_id").alias("x"), F.col("right_id").alias("y"))
    j = j.join(apart, (F.least("left_root", "right_root") == F.col("x")) & (F.greatest("left_root", "right_root") == F.col("y")), "left")
    state = F.when(F.col("left_root") == F.col("right_root"), "merged").when(F.col("x").isNotNull(), "distinct").otherwise("pending")
    return j.select("left_id", "right_id", "left_root", "right_root", state.alias("state"))


def survivors(rows: DataFrame, key: str, fields: list[str], order: list[Column]) -> DataFrame:
    """For each ``key`` the first value that is not null of each field, by ``order``; fields are picked one by one."""
    return rows.groupBy(key).agg(*[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))).alias(f) for f in fields])
