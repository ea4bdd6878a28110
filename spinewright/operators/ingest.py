"""Ingest: rejects with names, boundary dedup, hash-gated upserts, change tallies, events, samples, closures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinewright.core import materialize


def validated(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``reject_reason``: the first rule that fails (a null counts as failing), null for a valid row."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])
    return rows.withColumn("reject_reason", reason)


def latest_per_key(rows: DataFrame, key: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """One row a key: the largest by ``order``; and ``duplicates``, how many more there were. One aggregation, no sort."""
    best = F.max_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return rows.groupBy(*key).agg(best.alias("best"), (F.count("*") - 1).alias("duplicates")).select(*key, *[F.col(f"best.{k}").alias(k) for k in keep], "duplicates")


def upsert_actions(old: DataFrame, new: DataFrame, key: str, hash_col: str) -> DataFrame:
    """``key, action``: inserted, changed, unchanged or gone, by key and payload hash."""
    o, n = old.select(F.col(key).alias("o_key"), F.col(hash_col).alias("o_hash")), new.select(F.col(key).alias("n_key"), F.col(hash_col).alias("n_hash"))
    action = F.when(F.col("o_key").isNull(), "inserted").when(F.col("n_key").isNull(), "gone").when(F.col("o_hash").eqNullSafe(F.col("n_hash")), "unchanged").otherwise("changed")
    return o.join(n, F.col("o_key") == F.col("n_key"), "full").select(F.coalesce("n_key", "o_key").alias(key), action.alias("action"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The next snapshot: new rows, and the old ones whose key didn't come again."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def ranked_upsert(rows: DataFrame, key: list[str], value: str, ranks: dict[str, int]) -> DataFrame:
    """The value of the highest rank a key has seen: an upsert that only goes up."""
    rank = F.coalesce(*[F.when(F.col(value) == v, r) for v, r in ranks.items()], F.lit(-1))
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(rank.alias("r"), value)).alias(value))


def change_events(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Append-only events of what differs: ``key, kind, before, after`` with the fields as JSON."""
    side = lambda df, p: df.select(F.col(key).alias(f"{p}_key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(p))
    j = side(old, "before").join(side(new, "after"), F.col("before_key") == F.col("after_key"), "full")
    kind = F.when(F.col("before_key").isNull(), "insert").when(F.col("after_key").isNull(), "delete").otherwise("update")
    return j.where(~F.col("before").eqNullSafe(F.col("after"))).select(F.coalesce("after_key", "before_key").alias(key), kind.alias("kind"), "before", "after")


def stratified_sample(rows: DataFrame, group: Column, id_col: str, each: int) -> DataFrame:
    """``each`` rows of every group in the order of the id's MD5: the same rows at every run."""
    order = Window.partitionBy("group").orderBy("digest", id_col)
    return rows.withColumns({"group": group, "digest": F.md5(F.col(id_col).cast("string").cast("binary"))}).withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)


#: Hexadecimal digits of an MD5 by which rows are counted before they are ranked: 4,096 bins.
BIN_DIGITS = 3


def _ranked(rows: DataFrame, rules: list[tuple[str, Column, int]], most: list[int], id_col: str) -> DataFrame:
    """``rule, row, digest, place``: of each rule's rows the first ``most`` in the order of the id's MD5."""
    w = Window.partitionBy("rule").orderBy("digest", F.col(f"row.{id_col}"))
    limit = F.element_at(F.array(*map(F.lit, most)), F.col("rule") + 1)
    return _leading(rows, rules, most, id_col).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def _leading(rows: DataFrame, rules: list[tuple[str, Column, int]], most: list[int], id_col: str) -> DataFrame:
    """``rule, row, digest`` of the rows that can be among the first ``most`` of a rule, all rules in two scans. The first counts
    rows by the digest's bin, the second takes those up to the bin that holds a rule's last row: ``most`` and a 4,096th
    of the rule's rows or so, so few are sorted. A row comes up once for each rule it meets."""
    met = F.filter(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(i)) for i, (_, p, _) in enumerate(rules)]), lambda i: i.isNotNull())
    digest = F.md5(F.col(id_col).cast("string").cast("binary"))
    limit = F.element_at(F.array(*map(F.lit, most)), F.col("rule") + 1)
    counts = rows.select(F.substring(digest, 1, BIN_DIGITS).alias("bin"), F.explode(met).alias("rule")).groupBy("rule", "bin").agg(F.count("*").alias("n"))
    so_far = counts.withColumn("so_far", F.sum("n").over(Window.partitionBy("rule").orderBy("bin")))  # a row a bin
    last = {r["rule"]: r["last"] for r in so_far.where(F.col("so_far") >= limit).groupBy("rule").agg(F.min("bin").alias("last")).collect()}  # a row a rule
    lasts = F.array(*[F.lit(last.get(i, "f" * BIN_DIGITS)) for i in range(len(rules))])
    near = F.filter(met, lambda i: F.substring("digest", 1, BIN_DIGITS) <= F.element_at(lasts, i + 1))
    return rows.withColumn("digest", digest).select(F.struct(*rows.columns).alias("row"), "digest", F.explode(near).alias("rule"))


def _assigned(ranked: DataFrame, id_col: str, names: list[str], take: list[int]) -> DataFrame:
    """Whole rows with their ``group``: each rule in turn takes the first ``take`` of its rows that no earlier one has taken.
    The driver holds rules and ids of ``ranked``, which its limits bound."""
    ranked = materialize(ranked)
    taken, chosen, left = set(), [], dict(enumerate(take))
    for r in sorted(ranked.select("rule", F.col(f"row.{id_col}").alias("i"), "place").collect(), key=lambda r: (r["rule"], r["place"])):
        if left[r["rule"]] and r["i"] not in taken:
            taken.add(r["i"])
            chosen.append((r["rule"], r["place"], names[r["rule"]]))
            left[r["rule"]] -= 1
    table = ranked.sparkSession.createDataFrame(chosen, "rule int, place int, group string")
    return ranked.join(F.broadcast(table), ["rule", "place"]).select("row.*", "group", "digest")


def ruled_sample(rows: DataFrame, rules: list[tuple[str, Column, int]], id_col: str) -> DataFrame:
    """A sample by rules ``(group, predicate, n)``: of each group's rows the first 3 n + 10 in the order of the id's MD5, rows
    that an earlier group has taken left out. Ids are unique."""
    take = [3 * n + 10 for _, _, n in rules]
    # an earlier group takes as many rows at most as it may, so one among the first of both sums is left
    most = [sum(take[: i + 1]) for i in range(len(take))]
    return _assigned(_ranked(rows, rules, most, id_col), id_col, [g for g, _, _ in rules], take)


def cut_sample(rows: DataFrame, rules: list[tuple[str, Column, int, bool]], id_col: str, banned: Column | None = None) -> DataFrame:
    """A fixture's rows by rules ``(group, predicate, n, required)``: of the first 3 n + 10 rows that meet a rule, in the order of
    the id's MD5, the first n that aren't ``banned`` and that no earlier group has taken. A required group without a row is an
    error. Ids are unique."""
    plain = [(g, p, n) for g, p, n, _ in rules]
    ranked = materialize(_ranked(rows, plain, [3 * n + 10 for _, _, n in plain], id_col))
    free = ranked if banned is None else ranked.join(rows.where(banned).select(F.col(id_col).alias("banned_id")), F.col(f"row.{id_col}") == F.col("banned_id"), "left_anti")
    out = materialize(_assigned(free, id_col, [g for g, _, _ in plain], [n for _, _, n in plain]))
    found = {r["group"] for r in out.select("group").distinct().collect()}  # a row a rule
    if missing := [g for g, _, _, required in rules if required and g not in found]:
        raise ValueError(f"groups without a row: {missing}")
    return out


def mapped(rows: DataFrame, raw: str, table: DataFrame, variant: str, value: str, rank: str) -> DataFrame:
    """Adds ``value``: what a lookup table says of a folded key, the variant of the smallest rank first; the folded key itself if
    it isn't in the table."""
    from spinewright.functions.keys import folded

    first = table.groupBy(folded(F.col(variant)).alias("key")).agg(F.min_by(value, F.struct(rank, value)).alias("found"))
    j = rows.withColumn("key", folded(F.col(raw))).join(first, "key", "left")
    return j.withColumn(value, F.coalesce("found", "key")).drop("key", "found")


def skip_reason(name: Column, country: Column, region: Column, well_formed: Column) -> Column:
    """Why a place isn't admitted, first reason first: malformed, not_texas, no_name; null if it is. A null region isn't Texas."""
    texas = F.coalesce((country == "US") & (region == "TX"), F.lit(False))
    return F.when(~F.coalesce(well_formed, F.lit(False)), "malformed").when(~texas, "not_texas").when(F.coalesce(F.trim(name), F.lit("")) == "", "no_name")


def anonymised(places: DataFrame, kind: str, city: str, south: float, west: float, north: float, east: float, page: str = "page", place: str = "place") -> DataFrame:
    """Listings with synthetic values for all that was present: ``id, name, address, lat, lng, phone, website`` in and out.

    The number follows from page and place, coordinates from a hash of the id (inside the box by a twentieth),
    foreign addresses stay foreign and a website keeps its host class; null stays null."""
    from spinewright.functions.keys import fnv1a32, half_up, host_class
    from spinewright.operators.sweep import out_of_area

    number = F.lpad(((F.col(page) - 1) * 20 + F.col(place) + 1).cast("string"), 3, "0")
    kept = lambda c, v: F.when(F.col(c).isNotNull(), v).alias(c)
    tail = F.lower(F.trim(F.element_at(F.split(F.trim(F.col("address")), ","), -1)))
    home = F.concat(number, F.lit(f" Synthetic St, {city}, TX 78500"), F.when(tail.isin("usa", "united states"), ", USA").otherwise(""))
    inside = lambda lo, hi, axis: half_up((lo + (0.05 + 0.9 * fnv1a32(F.concat("id", F.lit(axis))) / 2**32) * (hi - lo)) * 10_000) / 10_000
    hosts = {"business_site_dead": ("synthetic-", ".business.site"), "social": ("www.facebook.com/synthetic-", ""), "directory": ("www.yelp.com/biz/synthetic-", ""), "platform_subdomain": ("synthetic-", ".wixsite.com/site")}
    site = F.coalesce(*[F.when(host_class(F.col("website")) == k, F.concat(F.lit(f"https://{a}"), number, F.lit(b))) for k, (a, b) in hosts.items()], F.concat(F.lit("https://synthetic-"), number, F.lit(".example")))
    return places.select(
        "id", kept("name", F.concat(F.lit(f"Synthetic {kind} "), number)), kept("address", F.when(out_of_area(F.col("address")), F.concat(number, F.lit(" Calle Sintetica, Synthetic, Mexico"))).otherwise(home)),
        kept("lat", inside(south, north, ":lat")), kept("lng", inside(west, east, ":lng")), kept("phone", F.concat(F.lit("(956) 555-01"), F.substring(number, 2, 2))), kept("website", site),
    )


def statewide_names(rows: DataFrame, raw: str, n: str) -> DataFrame:
    """Counts of raw names added up by their key: ``name_norm, n``."""
    from spinewright.functions.keys import name_norm

    # a condition on the key itself would be pushed below the caller's own aggregate and work out a key for each of its input rows
    counted = rows.select(name_norm(F.col(raw)).alias("name_norm"), n).groupBy("name_norm").agg(F.sum(n).alias("n"), F.count("name_norm").alias("named"))
    return counted.where("named > 0").drop("named")


def outlet_counts(permits: DataFrame, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """Permits (``county, naics``) per county and cluster, of which the first half-open code range counts: ``county, cluster, outlets``."""
    from spinewright.operators.report import first_range

    found = permits.withColumn("cluster", first_range(F.col("naics").cast("int"), ranges)).where("cluster is not null")
    return found.groupBy("county", "cluster").agg(F.count("*").alias("outlets"))


def first_keys(rows: DataFrame, identity: str, size: int = 6, attempt: int = 0) -> DataFrame:
    """``rows`` with the ``key`` that their ``identity`` tries at an attempt, before :func:`public_keys` tells apart those that meet."""
    from spinewright.functions.keys import public_key

    text = F.col(identity).cast("string") if attempt == 0 else F.concat(F.col(identity).cast("string"), F.lit(f"/{attempt}"))
    return rows.withColumn("key", public_key(text, size=size))


def public_keys(rows: DataFrame, identity: str, taken: DataFrame | None = None, size: int = 6, rounds: int = 20) -> DataFrame:
    """``rows`` with a ``key`` of their own that follows from ``identity`` (unique), so that a replayed task makes the same one.

    Of rows that would share a key the one with the smallest identity has it; the others, and those whose key is ``taken``
    (``key``), try the next key of their identity. A round settles nearly all, as long as ``32 ** size`` is far above the
    number of rows; settled rows leave the rounds."""
    names, settled = rows.columns, []
    used = taken.select("key").distinct() if taken is not None else None
    open_ = rows
    for attempt in range(rounds):
        tried = first_keys(open_, identity, size, attempt)
        first = tried.groupBy("key").agg(F.min(identity).alias("first"))
        if used is not None:
            first = first.join(used, "key", "left_anti")
        judged = materialize(tried.join(first.select("key", F.col("first").alias(identity), F.lit(True).alias("has")), ["key", identity], "left"))
        settled.append(judged.where("has").select(*names, "key"))
        open_ = judged.where("has is null").select(*names)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        mine = judged.where("has").select("key")
        used = mine if used is None else used.unionByName(mine)
    raise ValueError(f"keys of {size} digits are too short: rows are without one after {rounds} rounds")
