"""Merging: reversible merges, survivorship by source, closures, and upserts that keep decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The durable sources.
PERMIT, CLOSURE, PLACES, GEOCODER = "tx_comptroller", "tx_comptroller_closures", "overture", "census_geocoder"
DURABLE = (PERMIT, CLOSURE, PLACES, GEOCODER)


def flagged_chains(rows: DataFrame, statewide: DataFrame, least: int = 3) -> DataFrame:
    """``id, chain_key, change`` of every business that is or was a chain's. ``rows``: ``id, name_norm, override, merged_into,
    chain_key``; ``statewide``: ``name_norm, n``. A name is a chain's with ``least`` live members, or, for rows without
    an override, with as many statewide. ``change``: flagged, cleared or unchanged."""
    keyed = rows.where("name_norm is not null and merged_into is null").select("id", F.coalesce("override", "name_norm").alias("ck"), F.col("override").isNull().alias("plain"))
    own = keyed.groupBy("ck").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    known = statewide.where(F.col("n") >= least).select(F.col("name_norm").alias("ck"), F.lit(True).alias("known")).distinct()
    live = keyed.join(own, "ck", "left").join(known, "ck", "left").where(F.col("members").isNotNull() | (F.col("plain") & F.col("known"))).select("id", F.col("ck").alias("new_key"))
    j = rows.select("id", "chain_key").join(live, "id", "left").where("chain_key is not null or new_key is not null")
    change = F.when(F.col("new_key").isNull(), "cleared").when(F.col("chain_key").eqNullSafe(F.col("new_key")), "unchanged").otherwise("flagged")
    return j.select("id", F.col("new_key").alias("chain_key"), change.alias("change"))


def winners(roots: DataFrame, businesses: DataFrame) -> DataFrame:
    """``id, winner``: the cluster's oldest member by ``created_at``, then by id, into which the others merge."""
    best = roots.join(businesses.select("id", "created_at"), "id").groupBy("root").agg(F.min(F.struct("created_at", "id"))["id"].alias("winner"))
    return roots.join(best, "root").select("id", "winner")


def undoable(merges: DataFrame) -> DataFrame:
    """Adds ``undoable`` to ``merge_id, winner, loser, undone``: a live merge that no later live merge into its winner follows."""
    last = merges.where("not undone").groupBy("winner").agg(F.max("merge_id").alias("last"))
    return merges.join(last, "winner", "left").withColumn("undoable", ~F.col("undone") & (F.col("merge_id") == F.col("last"))).drop("last")


def _first(value: Column, tiers: list[Column]) -> Column:
    """The value of the first record by tier, falling confidence and id; a record in no tier doesn't count."""
    tier = F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tiers)])
    return F.min_by(value, F.when(tier.isNotNull(), F.struct(tier.alias("t"), F.coalesce(-F.col("confidence"), F.lit(float("inf"))).alias("c"), F.col("id").alias("i"))))


def survived(records: DataFrame, key: str) -> DataFrame:
    """Each ``key``'s fields by the rules of their sources, with the record each came from, in one aggregation.

    ``records``: ``key, id, source, confidence, legal_name, display_name, phone, blockable, street, street_num, street_norm, unit,
    postal, city, lat, lng, match_type, closed_at, basic_category, cluster_key, operating_status``. The legal name is the permit's; the display name that of a
    place, or the permit's where the key has no place at all; phone, address and location prefer places; a closing
    date is the closures' latest. Sources that aren't durable are left out.
    """
    c = F.col
    of, has = lambda s: c("source") == s, lambda f: c(f).isNotNull()
    addressed, located = has("street") | has("postal"), has("lat") & has("lng")
    parts = ("street", "street_num", "street_norm", "unit", "postal", "city")
    permit_name = F.coalesce("display_name", "legal_name")
    rows = records.where(c("source").isin(*DURABLE))
    derived = {f: _first(c(f), [of(PLACES) & has(f), has(f)]) for f in ("basic_category", "cluster_key", "confidence", "operating_status")}
    picked = rows.groupBy(key).agg(
        _first(F.struct("legal_name", "id"), [of(PERMIT) & has("legal_name")]).alias("legal"), _first(F.struct("display_name", "id"), [of(PLACES) & has("display_name")]).alias("shown"),
        _first(F.struct(permit_name.alias("display_name"), "id"), [of(PERMIT) & permit_name.isNotNull()]).alias("fallback"), F.bool_or(of(PLACES)).alias("has_place"),
        _first(F.struct("phone", "blockable", "id"), [of(PLACES) & has("phone"), has("phone")]).alias("call"), _first(F.struct(*parts, "id"), [of(PLACES) & addressed, of(PERMIT) & addressed]).alias("at"),
        _first(F.struct("lat", "lng", "match_type", "id"), [of(PLACES) & located, *[of(GEOCODER) & (c("match_type") == k) & located for k in ("census_exact", "census_non_exact")]]).alias("pin"),
        F.min_by(F.struct("closed_at", "id"), F.when(of(CLOSURE) & has("closed_at"), F.struct((-F.unix_micros(c("closed_at").cast("timestamp"))).alias("d"), "id"))).alias("closed"),
        *[v.alias(f) for f, v in derived.items()],
    )
    name = F.coalesce("shown", F.when(~c("has_place"), c("fallback")))
    return picked.withColumn("name", name).select(
        key, "legal.legal_name", c("legal.id").alias("legal_name_source"), "name.display_name", c("name.id").alias("display_name_source"), "call.phone", F.coalesce("call.blockable", F.lit(False)).alias("blockable"), c("call.id").alias("phone_source"),
        *[f"at.{p}" for p in parts], c("at.id").alias("address_source"), "pin.lat", "pin.lng", "pin.match_type", c("pin.id").alias("location_source"), "closed.closed_at", c("closed.id").alias("closed_at_source"), *derived,
    )


def rederived(stored: DataFrame, computed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The computed rows that differ from the stored ones in any field, nulls being values: what a rerun has to write."""
    old = stored.select(F.col(key).alias("_key"), F.struct(*fields).alias("_old"))
    j = computed.join(old, F.col(key) == F.col("_key"), "left")
    return j.where(~F.struct(*fields).eqNullSafe(F.col("_old"))).select(key, *fields)


def closures_applied(businesses: DataFrame, closures: DataFrame) -> DataFrame:
    """``id, closed_at, source_id`` of the live roots whose closing date changes. ``businesses``: ``id, merged_into, closed_at``;
    ``closures``: ``business_id, closed_at, source_id``. Per root the latest date counts, of equal dates the smallest source."""
    roots = businesses.select(F.col("id").alias("business_id"), F.coalesce("merged_into", "id").alias("root"))
    best = F.min_by(F.struct("closed_at", "source_id"), F.struct((-F.unix_micros(F.col("closed_at").cast("timestamp"))).alias("d"), "source_id"))
    latest = closures.where("closed_at is not null").join(roots, "business_id").groupBy("root").agg(best.alias("b")).select(F.col("root").alias("id"), "b.closed_at", "b.source_id")
    return latest.join(businesses.select("id", F.col("closed_at").alias("was")), "id").where(~F.col("was").eqNullSafe(F.col("closed_at"))).select("id", "closed_at", "source_id")


def attachments_kept(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The next attachments (``key, status, reason, score, run``): a rejected or confirmed row is frozen, an attached one is never
    moved down but is seen by the new run, everything else takes the new match whole."""
    fields = ("status", "reason", "score", "run")
    o = old.select(*key, F.struct(*fields).alias("o"))
    n = new.select(*key, F.struct(*fields).alias("n"))
    frozen = (F.col("o.status") == "rejected") | (F.col("o.reason") == "confirmed")
    keeps = (F.col("o.status") == "attached") & (F.col("n.status") != "attached")
    seen = F.struct(F.col("o.status").alias("status"), F.col("o.reason").alias("reason"), F.col("o.score").alias("score"), F.col("n.run").alias("run"))
    row = F.when(F.col("n").isNull() | frozen, F.col("o")).when(keeps, seen).otherwise(F.col("n"))
    return o.join(n, key, "full").select(*key, row.alias("r")).select(*key, "r.*")


def own_or_built_in(rows: DataFrame, key: list[str], tenant: str, keep: list[str], org: str = "org_id") -> DataFrame:
    """The rows a tenant sees of a reference table: its own before the built-in one (null tenant) of the same key."""
    mine = rows.where(F.col(org).isNull() | (F.col(org) == tenant))
    best = F.max_by(F.struct(org, *keep), F.struct(F.col(org).isNotNull().alias("own"), *keep))
    return mine.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def version_conflicts(saved: DataFrame, key: str, version: str, order: list[str]) -> DataFrame:
    """Saves of a version that exists already: all but the first by ``order`` are refused."""
    w = Window.partitionBy(key, version).orderBy(*order)
    return saved.withColumn("refused", F.row_number().over(w) > 1)
