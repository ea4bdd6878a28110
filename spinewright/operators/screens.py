"""What the screens read: lists with totals, details with their sources, review queues, run reports, exports.

Every function takes the tables it needs and gives one table; lists of a row's own parts are ordered JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinewright.functions import keys

#: Columns of a business that may leave the house.
PUBLIC = ("id", "key", "display_name", "legal_name", "street", "city", "postal", "phone", "cluster_key", "lat", "lng", "closed_at")


def status(merged_into: Column, closed_at: Column) -> Column:
    """A business is merged away, else closed, else active."""
    return F.when(merged_into.isNotNull(), "merged_away").when(closed_at.isNotNull(), "closed").otherwise("active")


def listed(rows: DataFrame, text: str | None = None, cluster: str = "any", state: str = "any", excluded: str = "") -> DataFrame:
    """The businesses (``id, key, name, cluster_key, merged_into, closed_at``) a list's filters leave, with ``status``.

    ``text`` is looked for in the name whatever its accents and case, ``%`` and ``_`` being plain signs, or is the whole key in
    upper case. ``cluster`` is any, none or a key; ``state`` any, active, closed or merged_away; ``excluded`` a comma list of ids.
    """
    out = rows.withColumn("status", status(F.col("merged_into"), F.col("closed_at")))
    if text is not None:
        inside = F.contains(keys.fold(F.lower("name")), F.lit(keys.plain(text.lower())))
        out = out.where(F.coalesce(inside, F.lit(False)) | (F.col("key") == text.strip().upper()))
    if cluster != "any":
        out = out.where(F.col("cluster_key").isNull() if cluster == "none" else F.col("cluster_key") == cluster)
    if state != "any":
        out = out.where(F.col("status") == state)
    if excluded:
        out = out.where(~F.array_contains(F.split(F.lit(excluded), ","), F.col("id").cast("string")))
    return out


def page(found: DataFrame, order: list[str], size: int, offset: int) -> DataFrame:
    """A page of ``found`` with the ``total`` of all its rows; the page is what is limited, the total is not."""
    total = found.agg(F.count("*").alias("total"))
    rows = found.orderBy(*order).offset(offset).limit(size)
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").drop("one")  # one row


def grouped_having(rows: DataFrame, key: str, least: int) -> DataFrame:
    """``key, n`` of keys with ``least`` rows or more, most frequent first, ties by key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), key)


def json_list(fields: list[str], order: list[str]) -> Column:
    """An aggregate: the group's rows as an ordered JSON list of objects. For groups of a bounded size, such as a
    business's own sources."""
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("item"))))
    return F.to_json(F.transform(ordered, lambda x: x["item"]), {"ignoreNullFields": "false"})


def detailed(businesses: DataFrame, sources: DataFrame, merges: DataFrame, aliases: DataFrame, runs: DataFrame) -> DataFrame:
    """``id, status, sources, n_sources, absorbed, aliases, stale`` of each business.

    ``sources``: ``business_id, source, seen_run``; ``merges``: ``winner, loser, undone``; ``aliases``: ``business_id, alias``;
    ``runs``: ``run_id, source, complete``. A business is stale if one of its sources has a complete run later than the one
    that last saw it."""
    latest = runs.where("complete").groupBy("source").agg(F.max("run_id").alias("last_run"))
    seen = sources.join(latest, "source", "left").withColumn("old", F.coalesce(F.col("last_run") > F.col("seen_run"), F.lit(False)))
    of = seen.groupBy("business_id").agg(json_list(["source", "seen_run"], ["source", "seen_run"]).alias("sources"), F.count("*").alias("n_sources"), F.bool_or("old").alias("stale"))
    absorbed = merges.where("not undone").groupBy(F.col("winner").alias("business_id")).agg(F.count("*").alias("absorbed"))
    named = aliases.groupBy("business_id").agg(F.array_join(F.sort_array(F.collect_set("alias")), ",").alias("aliases"))
    j = businesses.withColumnRenamed("id", "business_id").join(of, "business_id", "left").join(absorbed, "business_id", "left").join(named, "business_id", "left")
    return j.select(
        F.col("business_id").alias("id"), status(F.col("merged_into"), F.col("closed_at")).alias("status"), F.coalesce("sources", F.lit("[]")).alias("sources"),
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("absorbed", F.lit(0)).alias("absorbed"), F.coalesce("aliases", F.lit("")).alias("aliases"), F.coalesce("stale", F.lit(False)).alias("stale"),
    )


def chain_badges(businesses: DataFrame, statewide: DataFrame) -> DataFrame:
    """``id, badge``: how many share a chain's name, statewide where known, else among live businesses; null outside chains."""
    own = businesses.where("merged_into is null and chain_key is not null").groupBy("chain_key").agg(F.count("*").alias("local"))
    known = statewide.groupBy(F.col("name_norm").alias("chain_key")).agg(F.max("n").alias("n"))
    return businesses.select("id", "chain_key").join(own, "chain_key", "left").join(known, "chain_key", "left").select("id", F.when(F.col("chain_key").isNotNull(), F.coalesce("n", "local")).alias("badge"))


def tie_partners(attachments: DataFrame, businesses: DataFrame) -> DataFrame:
    """``place_id, business_id, tied_id, tied_name``: the live root of the business an attachment ties with, none if it is its own."""
    root = lambda c, name: businesses.select(F.col("id").alias(c), F.coalesce("merged_into", "id").alias(name))
    j = attachments.join(root("business_id", "own"), "business_id", "left").join(root("tied_with", "other"), "tied_with", "left")
    j = j.withColumn("other", F.when(~F.col("other").eqNullSafe(F.col("own")), F.col("other")))
    names = businesses.select(F.col("id").alias("other"), F.col("name").alias("tied_name"))
    return j.join(names, "other", "left").select("place_id", "business_id", F.col("other").alias("tied_id"), "tied_name")


def review_queue(pairs: DataFrame, listings: DataFrame) -> DataFrame:
    """Both kinds of open reviews in one order, ``kind, ref, score, skipped, place``: rows not skipped first, then by falling
    score, pairs before listings, then by reference. ``pairs`` and ``listings``: ``ref, score, skipped``."""
    both = pairs.select(F.lit(0).alias("k"), "ref", "score", "skipped").unionByName(listings.select(F.lit(1).alias("k"), "ref", "score", "skipped"))
    return both.orderBy("skipped", F.desc("score"), "k", "ref").select(F.when(F.col("k") == 0, "pair").otherwise("listing").alias("kind"), "ref", "score", "skipped")


def review_remaining(pairs: DataFrame, businesses: DataFrame) -> DataFrame:
    """``band, remaining``: open pairs whose sides have different live roots."""
    root = lambda c, name: businesses.select(F.col("id").alias(c), F.coalesce("merged_into", "id").alias(name))
    j = pairs.where("decision is null").join(root("left_id", "a"), "left_id").join(root("right_id", "b"), "right_id")
    return j.where("a <> b").groupBy("band").agg(F.count("*").alias("remaining"))


def run_report(runs: DataFrame, searches: DataFrame, outcomes: DataFrame, ledger: DataFrame) -> DataFrame:
    """A row for each run: its searches, results and saturated tiles, outcomes by status, and what it cost."""
    s = searches.groupBy("run_id").agg(F.count("*").alias("searches"), F.count_if(F.col("status") == "done").alias("done"), F.sum("results").alias("results"), F.count_if("saturated").alias("saturated"))
    o = outcomes.groupBy("run_id").agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("attached", "tentative", "unmatched")])
    cost = ledger.groupBy("run_id").agg(F.sum("micros").alias("micros"), F.countDistinct("request_id").alias("requests"))
    j = runs.join(s, "run_id", "left").join(o, "run_id", "left").join(cost, "run_id", "left")
    return j.na.fill(0, ["searches", "done", "results", "saturated", "attached", "tentative", "unmatched", "micros", "requests"])


def source_states(sources: DataFrame, runs: DataFrame, transient: DataFrame, now: Column) -> DataFrame:
    """``source, runs, last_complete, last_status, held, expired, oldest_expired`` of every source."""
    of = runs.groupBy("source").agg(F.count("*").alias("runs"), F.max(F.when(F.col("status") == "complete", F.col("finished"))).alias("last_complete"), F.max_by("status", F.struct("finished", "run_id")).alias("last_status"))
    kept = transient.groupBy("source").agg(F.count("*").alias("held"), F.count_if(F.col("expires_at") <= now).alias("expired"), F.min(F.when(F.col("expires_at") <= now, F.col("expires_at"))).alias("oldest_expired"))
    return sources.join(of, "source", "left").join(kept, "source", "left").na.fill(0, ["runs", "held", "expired"])


def place_signals(attachments: DataFrame, observations: DataFrame, businesses: DataFrame) -> DataFrame:
    """``id, places, operational, last_seen``: for each live root the attached places of all businesses under it, by the latest
    observation of each place."""
    root = businesses.select(F.col("id").alias("business_id"), F.coalesce("merged_into", "id").alias("root"))
    last = observations.groupBy("place_id").agg(F.max(F.struct("seen", "obs_id", "status")).alias("o")).select("place_id", F.col("o.status").alias("place_status"), "o.seen")
    j = attachments.where("status = 'attached'").select("place_id", "business_id").join(root, "business_id").select("root", "place_id").distinct().join(last, "place_id", "left")
    return j.groupBy(F.col("root").alias("id")).agg(F.count("*").alias("places"), F.count_if(F.coalesce(F.col("place_status") == "operational", F.lit(False))).alias("operational"), F.max("seen").alias("last_seen"))


def website_signals(attachments: DataFrame, observations: DataFrame, businesses: DataFrame) -> DataFrame:
    """``id, had_website, host_class, observed_at, listings``: for each live root, what the listings attached to it and to the
    businesses under it say of its website, by the last observation of each listing.

    ``attachments``: ``business_id, place_id, status``; ``observations``: ``obs_id, business_id, place_id, had_website, host_class,
    observed_at``. Of several listings the class is that of one with a website (or of which that is unknown), then of the last seen, then of the
    largest observation. A listing that was never observed doesn't count."""
    seen = F.struct("observed_at", "obs_id", F.coalesce(F.col("had_website").cast("int"), F.lit(-1)).alias("site"), "host_class", "had_website")
    last = observations.groupBy("business_id", "place_id").agg(F.max(seen).alias("o"))
    attached = attachments.where("status = 'attached'").join(last, ["business_id", "place_id"])
    root = businesses.select(F.col("id").alias("business_id"), F.coalesce("merged_into", "id").alias("id"))
    telling = F.struct(F.coalesce("o.had_website", F.lit(True)).alias("w"), F.col("o.observed_at").alias("t"), F.col("o.obs_id").alias("i"))
    return attached.join(root, "business_id").groupBy("id").agg(F.bool_or("o.had_website").alias("had_website"), F.max_by("o.host_class", telling).alias("host_class"), F.max("o.observed_at").alias("observed_at"), F.count("*").alias("listings"))


def exported(rows: DataFrame) -> DataFrame:
    """The public columns of live businesses; a column that isn't on the list never leaves, whatever it is called."""
    return rows.where("merged_into is null").select(*[c for c in PUBLIC if c in rows.columns])


def source_views(records: DataFrame, geocodes: DataFrame) -> DataFrame:
    """Source records as one typed table for survivorship: ``business_id, id, source, name, phone, street, postal, lat, lng, match_type``.

    ``records``: ``business_id, id, source, payload`` (JSON). A geocode (``record_id, input_hash, lat, lng, match_type``) counts only
    while its input is still the record's address: a stale one is dropped, the record stays."""
    get = lambda path: F.get_json_object("payload", f"$.{path}")
    typed = records.select(
        "business_id", "id", "source", F.when(F.col("source") == "permit", get("outlet_name")).otherwise(get("name")).alias("name"),
        F.when(F.col("source") == "place", get("phone")).alias("phone"), F.coalesce(get("street"), get("outlet_address")).alias("street"), F.coalesce(get("postal"), get("outlet_zip_code")).alias("postal"),
        F.when(F.col("source") == "place", get("lat").cast("double")).alias("own_lat"), F.when(F.col("source") == "place", get("lng").cast("double")).alias("own_lng"),
    ).withColumn("input_hash", F.sha2(F.concat_ws("|", F.coalesce("street", F.lit("")), F.coalesce("postal", F.lit(""))), 256))
    fresh = geocodes.select(F.col("record_id").alias("id"), "input_hash", F.col("lat").alias("geo_lat"), F.col("lng").alias("geo_lng"), F.col("match_type").alias("geo_type"))
    j = typed.join(fresh, ["id", "input_hash"], "left")
    located = F.col("own_lat").isNotNull()
    return j.select(
        "business_id", "id", "source", "name", "phone", "street", "postal", F.coalesce("own_lat", "geo_lat").alias("lat"), F.coalesce("own_lng", "geo_lng").alias("lng"),
        F.when(located, "place").otherwise(F.col("geo_type")).alias("match_type"),
    )


def merge_effects(businesses: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What merges (``merge_id, winner, loser``, losers once each) write: parents, aliases and audit rows.

    ``id, merged_into``: the loser and all that was under it point at the winner, in one hop; ``business_id, alias``: the loser's key
    becomes an alias of the winner; ``merge_id, winner, loser, before``: the loser's row as it was, in JSON."""
    into = merges.select(F.col("loser").alias("was"), F.col("winner").alias("now"))
    moved = businesses.select("id", F.coalesce("merged_into", "id").alias("was")).join(into, "was").select("id", F.col("now").alias("merged_into"))
    keyed = businesses.select(F.col("id").alias("loser"), "key", F.to_json(F.struct("id", "key", "merged_into"), {"ignoreNullFields": "false"}).alias("before"))
    j = merges.join(keyed, "loser")
    return moved, j.select(F.col("winner").alias("business_id"), F.col("key").alias("alias")), j.select("merge_id", "winner", "loser", "before")


def run_cost_lines(cells: DataFrame, used: int, price: int = 35_000, free: int = 1_000, partitions: int = 4, week: int = 0) -> DataFrame:
    """``line, cells, requests_low, requests_high, micros_low, micros_high``: a full run, one of this week's partition and a change
    check, by one estimator. ``cells``: ``cell_key, types, known`` (tiles that a change check lists again)."""
    mine = F.pmod(keys.fnv1a32(F.col("cell_key")), F.lit(partitions)) == week % partitions
    left = max(0, free - used)
    lines = cells.select("types", "known", F.explode(F.array(
        F.struct(F.lit("full").alias("line"), F.lit(True).alias("counts")), F.struct(F.lit("partition").alias("line"), mine.alias("counts")), F.struct(F.lit("check").alias("line"), (F.col("known") > 0).alias("counts")),
    )).alias("x")).where("x.counts")
    low, high = F.when(F.col("x.line") == "check", F.col("known")).otherwise(F.col("types")), F.when(F.col("x.line") == "check", F.col("known") * 3).otherwise(F.col("types") * 9)
    sums = lines.groupBy("x.line").agg(F.count("*").alias("cells"), F.sum(low).alias("requests_low"), F.sum(high).alias("requests_high"))
    cost = lambda c: (F.greatest(F.lit(0), F.col(c) - left) * price).cast("long")
    return sums.select("line", "cells", "requests_low", "requests_high", cost("requests_low").alias("micros_low"), cost("requests_high").alias("micros_high"))


def admission(runs: DataFrame, estimates: DataFrame) -> DataFrame:
    """``run_id, state, ceiling``: admitted runs may cost twice their estimate at most. ``runs``: the result of
    :func:`~spinewright.operators.sweep.admitted`; ``estimates``: ``run_id, micros``."""
    return runs.join(estimates.select("run_id", F.col("micros").alias("estimate")), "run_id", "left").select("run_id", "state", F.when(F.col("state") == "admitted", 2 * F.col("estimate")).alias("ceiling"))


