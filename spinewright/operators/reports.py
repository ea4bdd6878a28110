"""The tables of a run's report, for all runs at once, and the check of a business's listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The billing units and host classes that a report always shows, in order; the states of a run that has ended.
UNITS = ("ts_enterprise", "ts_essentials")
HOST_CLASSES = ("none", "other", "social", "directory", "platform_subdomain", "business_site_dead")
ENDED = ("complete", "failed", "stopped")
_RANKS = ("unmatched", "tentative", "attached")
#: Rows of one task. The rows are a few bytes each in a shuffle, so sizes alone would put millions into one task.
TASK_ROWS = 250_000


def _static(runs: DataFrame, name: str, values: tuple[str, ...]) -> DataFrame:
    """A row for each run and value, with the value's place."""
    return runs.select("run_id", F.posexplode(F.array(*map(F.lit, values))).alias("ord", name))


def _tasks(*tables: DataFrame) -> int:
    """How many tasks the tables' rows fill, so that one takes as much memory at any size."""
    return 1 + sum(t.count() for t in tables) // TASK_ROWS


def _filled(rows: DataFrame, counts: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    return rows.join(counts, on, "left").na.fill(0, columns)


def requests_by_unit(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """``run_id, unit, requests, free, micros``: both units of every run. ``ledger``: ``run_id, unit, units, micros``."""
    sums = ledger.groupBy("run_id", "unit").agg(F.sum("units").alias("requests"), F.sum(F.when(F.col("micros") == 0, F.col("units")).otherwise(0)).alias("free"), F.sum("micros").alias("micros"))
    return _filled(_static(runs, "unit", UNITS), sums, ["run_id", "unit"], ["requests", "free", "micros"]).drop("ord")


def tile_counts(runs: DataFrame, searches: DataFrame) -> DataFrame:
    """``run_id, total, searched, saturated, subdivided, truncated``."""
    counts = searches.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("searched"), *[F.count_if(c).alias(c) for c in ("saturated", "subdivided", "truncated")])
    return _filled(runs.select("run_id"), counts, ["run_id"], ["total", "searched", "saturated", "subdivided", "truncated"])


def unfinished_tiles(runs: DataFrame, searches: DataFrame) -> DataFrame:
    """``run_id, tile_key, kind, why``: tiles that were truncated, and those of ended runs that were never searched."""
    j = searches.join(runs.select("run_id", F.col("status").alias("run_status")), "run_id")
    left = F.col("run_status").isin(*ENDED) & F.col("status").isin("planned", "searching")
    kinds = F.filter(F.array(F.when(F.col("truncated"), "truncated"), F.when(left, "unsearched")), lambda k: k.isNotNull())
    return j.select("run_id", "tile_key", F.explode(kinds).alias("kind"), "why").withColumn("why", F.when(F.col("kind") == "truncated", F.col("why")))


def outcome_counts(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``run_id, found, attached, tentative, unmatched``, each place at its best outcome. ``outcomes``: ``run_id, place_id, outcome``."""
    rank = F.coalesce(*[F.when(F.col("outcome") == o, i) for i, o in enumerate(_RANKS, 1)], F.lit(0))
    told = outcomes.repartition(_tasks(outcomes), "run_id", "place_id")  # few rows share a key, as in outcomes_by_cluster
    best = told.groupBy("run_id", "place_id").agg(F.max(rank).alias("rank"))
    counts = best.groupBy("run_id").agg(F.count_if(F.col("rank") >= 1).alias("found"), *[F.count_if(F.col("rank") == i).alias(o) for i, o in enumerate(_RANKS, 1)])
    return _filled(runs.select("run_id"), counts, ["run_id"], ["found", *_RANKS]).select("run_id", "found", "attached", "tentative", "unmatched")


def outcomes_by_cluster(runs: DataFrame, outcomes: DataFrame, clusters: DataFrame) -> DataFrame:
    """``run_id, cluster_key, display_name, place, found, attached, tentative, unmatched``: the clusters that a run's version names
    (``cluster_keys``), in the order of ``sort_order``, key and place; places of outside count nowhere.

    A run has few outcomes of a cluster, so those of one key are brought together before they are counted: counting before
    the shuffle would hold nearly every row and spare none. A key that has many is counted as its rows are read."""
    key, tasks = ["run_id", "cluster_key"], _tasks(outcomes, runs)
    named = runs.select("run_id", F.posexplode("cluster_keys").alias("pos", "cluster_key")).repartition(tasks, *key)
    rank = F.coalesce(*[F.when(F.col("outcome") == o, i) for i, o in enumerate(_RANKS, 1)], F.lit(0)).alias("rank")
    told = outcomes.where("outcome <> 'outside'").select(*key, rank).repartition(tasks, *key)  # a number is a narrower row
    counts = told.groupBy(*key).agg(F.count("*").alias("found"), *[F.count_if(F.col("rank") == i).alias(o) for i, o in enumerate(_RANKS, 1)])
    filled = _filled(named, counts, key, ["found", *_RANKS]).join(clusters, "cluster_key", "left").repartition(tasks, "run_id")
    w = Window.partitionBy("run_id").orderBy(F.col("sort_order").asc_nulls_last(), F.col("cluster_key").asc_nulls_last(), "pos")
    placed = filled.withColumn("place", F.row_number().over(w))
    return placed.select("run_id", "cluster_key", "display_name", "place", "found", "attached", "tentative", "unmatched")


def host_counts(runs: DataFrame, observations: DataFrame, attachments: DataFrame) -> DataFrame:
    """``run_id, host_class, n``: a run's observations by class of website, of listings that are attached now."""
    live = attachments.where("status = 'attached'").select("attachment_id")
    counts = observations.join(live, "attachment_id").groupBy("run_id", "host_class").agg(F.count("*").alias("n"))
    return _filled(_static(runs, "host_class", HOST_CLASSES), counts, ["run_id", "host_class"], ["n"]).drop("ord")


def change_counts(runs: DataFrame, searches: DataFrame) -> DataFrame:
    """``run_id, checked, unchanged, with_new, with_gone, new_ids, gone_ids, changed_tiles`` of the runs that are change checks."""
    verdict = lambda *of: F.count_if(F.coalesce(F.col("verdict").isin(*of), F.lit(False)))
    counts = searches.groupBy("run_id").agg(
        F.count("verdict").alias("checked"), verdict("unchanged").alias("unchanged"), verdict("new", "both").alias("with_new"), verdict("gone", "both").alias("with_gone"),
        F.sum(F.coalesce("new_ids", F.lit(0))).alias("new_ids"), F.sum(F.coalesce("gone_ids", F.lit(0))).alias("gone_ids"), verdict("new", "gone", "both", "saturated").alias("changed_tiles"),
    )
    return _filled(runs.where("kind = 'change_check'").select("run_id"), counts, ["run_id"], counts.columns[1:])


def family(businesses: DataFrame) -> DataFrame:
    """``business_id, id``: every business with the live root whose page shows it; merges are flat, so that is one hop."""
    return businesses.select(F.col("id").alias("business_id"), F.coalesce("merged_into", "id").alias("id"))


def _latest(observations: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("had_website", "host_class", "observed_at", "run_id"), F.struct("observed_at", "obs_id"))
    return observations.groupBy("business_id", "place_id").agg(best.alias("o"))


def checked_listings(attachments: DataFrame, observations: DataFrame, businesses: DataFrame) -> DataFrame:
    """``id, place, attachment_id, place_id, status, score, had_website, host_class, observed_at``: the listings on a business's page,
    those of businesses merged into it included, with the last observation of each. Attached ones come first, last seen
    before others, then tentative ones by score, then the rest by the time of their decision."""
    j = attachments.join(_latest(observations), ["business_id", "place_id"], "left").join(family(businesses), "business_id")
    last: Column = F.col("o.observed_at")
    order = [
        F.when(F.col("status") == "attached", 1).when(F.col("status") == "tentative", 2).otherwise(3), F.when(F.col("status") == "attached", last).desc_nulls_last(),
        F.when(F.col("status") == "tentative", F.col("score")).desc_nulls_last(), F.col("decided_at").desc_nulls_last(), F.col("attachment_id"),
    ]
    placed = j.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*order)))  # a page's listings
    return placed.select("id", "place", "attachment_id", "place_id", "status", "score", "o.had_website", "o.host_class", "o.observed_at")


def observed_history(observations: DataFrame, businesses: DataFrame) -> DataFrame:
    """``id, place, obs_id, place_id, observed_at, had_website, host_class, run_id``: all that was seen of a business's listings, last first."""
    w = Window.partitionBy("id").orderBy(F.col("observed_at").desc(), F.col("obs_id").desc())
    return observations.join(family(businesses), "business_id").withColumn("place", F.row_number().over(w)).select("id", "place", "obs_id", "place_id", "observed_at", "had_website", "host_class", "run_id")


def top_pairs(pairs: DataFrame, businesses: DataFrame, n: int = 1, floor: int = 80) -> DataFrame:
    """``place, pair_id, score, skipped, side, business_id`` and the side's ``key, name, cluster_key`` of the ``n`` pairs that are next for review:
    pending ones of ``floor`` or more whose sides are still two live roots; skipped ones sink, then score and id decide.

    ``pairs``: ``pair_id, left_id, right_id, score, decision, skipped_at``; ``businesses``: ``id, merged_into, key, name, cluster_key``."""
    root = lambda c, name: family(businesses).select(F.col("business_id").alias(c), F.col("id").alias(name))
    open_ = pairs.where(F.coalesce(F.col("decision") == "pending", F.lit(False)) & (F.col("score") >= floor))
    j = open_.join(root("left_id", "l"), "left_id").join(root("right_id", "r"), "right_id").where("l <> r")
    top = j.orderBy(F.col("skipped_at").asc_nulls_first(), F.col("score").desc(), "pair_id").limit(n)  # a report of n pairs
    order = Window.orderBy(F.col("skipped_at").asc_nulls_first(), F.col("score").desc(), "pair_id")  # n rows
    placed = top.withColumn("place", F.row_number().over(order))
    both = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("l").alias("business_id")), F.struct(F.lit("right").alias("side"), F.col("r").alias("business_id"))))
    sides = placed.select("place", "pair_id", "score", F.col("skipped_at").isNotNull().alias("skipped"), both.alias("x")).select("place", "pair_id", "score", "skipped", "x.*")
    return sides.join(businesses.select(F.col("id").alias("business_id"), "key", "name", "cluster_key"), "business_id", "left")
