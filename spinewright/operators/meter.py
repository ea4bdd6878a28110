"""Metering in whole micro-dollars: prices, idempotent settling, running spend, caps and reservations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def micros(amount: Column) -> Column:
    return F.floor(amount * 1_000_000 + 0.5).cast("long")


def priced(requests: Column, free: Column, unit_micros: Column) -> Column:
    """What requests beyond the free allowance cost; a null allowance is unlimited."""
    return F.when(free.isNull(), 0).otherwise(F.greatest(F.lit(0), requests - F.greatest(F.lit(0), free)) * unit_micros)


def settled(ledger: DataFrame, request: str, order: list[Column], keep: list[str]) -> DataFrame:
    """One entry a request, however often it was settled: the first by ``order``."""
    first = F.min_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return ledger.groupBy(request).agg(first.alias("e")).select(request, *[F.col(f"e.{k}").alias(k) for k in keep])


def first_alerts(rows: DataFrame, period: str, day: str, amount: str, cap: int, percent: int = 80) -> DataFrame:
    """For each period the first day on which the running spend reaches ``percent`` of ``cap``. Days are summed
    before they are ordered, so a period's window holds its days only."""
    days = rows.groupBy(period, day).agg(F.sum(amount).alias("spent"))
    running = days.withColumn("total", F.sum("spent").over(Window.partitionBy(period).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)))
    over = running.where(F.col("total") * 100 >= cap * percent)
    return over.groupBy(period).agg(F.min(day).alias(day), F.min("total").alias("total"))


def carried_caps(periods: DataFrame, caps: DataFrame, period: str, cap: str, default: int) -> DataFrame:
    """Each period's cap: its own, else the last one set before, else ``default``."""
    j = periods.select(period).distinct().join(caps, period, "left")
    last = F.last(cap, ignorenulls=True).over(Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0))  # a row a period
    return j.select(period, F.coalesce(last, F.lit(default).cast("long")).alias(cap))


def open_reservations(requests: DataFrame, settled_ids: DataFrame, released: DataFrame, now: Column) -> DataFrame:
    """Adds ``state`` to reservations ``request_id, expires_at, ...``: settled if the ledger has the request (also when it was
    released before), else released, else expired once ``expires_at`` has passed, else open. Only open ones hold money, so
    a lease that ran out frees its hold by itself."""
    s = settled_ids.select("request_id").distinct().withColumn("is_settled", F.lit(True))
    r = released.select("request_id").distinct().withColumn("is_released", F.lit(True))
    state = F.when(F.col("is_settled"), "settled").when(F.col("is_released"), "released").when(F.col("expires_at") < now, "expired").otherwise("open")
    return requests.join(s, "request_id", "left").join(r, "request_id", "left").withColumn("state", state).drop("is_settled", "is_released")


def period_balance(reservations: DataFrame, ledger: DataFrame, period: str) -> DataFrame:
    """``period, reserved, spent, overruns`` of reservations with their ``state`` (:func:`open_reservations`) and ``micros``: open
    ones are reserved, ledger entries spent; an entry above its reservation is an overrun."""
    held = reservations.groupBy(period).agg(F.sum(F.when(F.col("state") == "open", F.col("micros")).otherwise(0)).alias("reserved"))
    j = ledger.select("request_id", F.col("micros").alias("charged")).join(reservations.select("request_id", period, "micros"), "request_id")
    spent = j.groupBy(period).agg(F.sum("charged").alias("spent"), F.count_if(F.col("charged") > F.col("micros")).alias("overruns"))
    return held.join(spent, period, "left").na.fill(0, ["spent", "overruns"])


def overrun_events(reservations: DataFrame, ledger: DataFrame) -> DataFrame:
    """``request_id, over``: an event for each ledger entry above its reservation."""
    j = ledger.select("request_id", F.col("micros").alias("charged")).join(reservations.select("request_id", "micros"), "request_id")
    return j.where("charged > micros").select("request_id", (F.col("charged") - F.col("micros")).alias("over"))


def price_book(spark: SparkSession) -> DataFrame:
    """``unit, price, free`` of each billing unit."""
    return spark.createDataFrame([(k, p, f) for k, (p, f) in PRICES.items()], "unit string, price long, free long")


def priced_by_unit(usage: DataFrame, used_before: DataFrame) -> DataFrame:
    """``unit, requests, free_left, micros`` of ``usage`` (unit, requests) with what each unit has ``used`` of its month."""
    book = F.broadcast(price_book(usage.sparkSession))  # seven rows
    j = usage.join(used_before.select("unit", "used"), "unit", "left").join(book, "unit")
    left = F.when(F.col("free").isNotNull(), F.greatest(F.lit(0), F.col("free") - F.coalesce("used", F.lit(0))))
    return j.select("unit", "requests", left.cast("long").alias("free_left"), priced(F.col("requests"), left, F.col("price")).cast("long").alias("micros"))


MAX_MICROS = 1_000_000_000_000
# Price per request in micro-dollars and free requests a month (null: unlimited) of each billing unit.
PRICES = {
    "ts_essentials": (0, None), "ts_pro": (32_000, 5_000), "ts_enterprise": (35_000, 1_000), "ts_enterprise_atmosphere": (40_000, 1_000),
    "pd_essentials": (5_000, 10_000), "pd_pro": (17_000, 5_000), "pd_enterprise": (20_000, 1_000),
}
TIERS = ("ts_essentials", "ts_pro", "ts_enterprise", "ts_enterprise_atmosphere")


def parsed_dollars(text: Column) -> Column:
    """Micro-dollars of ``50``, ``$50.00`` or ``1,250.5``; null for anything else and above a million dollars. Digits only, no float."""
    pattern = r"^\$?\s*(\d{1,3}(?:,\d{3})*|\d+)(?:\.(\d{1,2}))?$"
    t = F.trim(text)
    dollars, cents = F.replace(F.regexp_extract(t, pattern, 1), F.lit(",")), F.rpad(F.regexp_extract(t, pattern, 2), 2, "0")
    value = (dollars.try_cast("decimal(30,0)") * 1_000_000 + cents.try_cast("decimal(30,0)") * 10_000).try_cast("long")
    return F.when(t.rlike(pattern) & (value <= MAX_MICROS), value)


def dollars(micros_: Column) -> Column:
    """``50.00``: sub-cent amounts are cut off, so what is shown never exceeds what is held."""
    size = F.abs(micros_)
    cents = F.expr("0L") + F.floor(size / F.lit(10_000))
    return F.concat(F.when(micros_ < 0, "-").otherwise(""), F.floor(cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("long").cast("string"), 2, "0"))


def tier(fields: Column, of_field: dict[str, str]) -> Column:
    """The highest billing tier of an array of fields; null for an empty array or an unknown field."""
    rank = lambda f: F.coalesce(*[F.when(f.isin([k for k, v in of_field.items() if v == t]), F.lit(i)) for i, t in enumerate(TIERS)])
    ranks = F.transform(fields, rank)
    known = (F.size(fields) > 0) & ~F.exists(ranks, lambda r: r.isNull())
    return F.when(known, F.element_at(F.array(*map(F.lit, TIERS)), F.array_max(ranks) + 1))


def quota_error(status: Column, limits: Column) -> Column:
    """What a failed request means, from its status and the quota names in its body: daily_quota, rate_limited, rejected or unavailable."""
    named = lambda p: F.coalesce(F.exists(limits, lambda x: F.coalesce(x.rlike(p), F.lit(False))), F.lit(False))
    busy = F.when(named("(?i)PerDay"), "daily_quota").when(named("(?i)PerMinute"), "rate_limited").otherwise("daily_quota")
    return F.when(status == 429, busy).when(status.isin(400, 401, 403, 404), "rejected").otherwise("unavailable")


def purge_overdue(now: Column, oldest_expired: Column, last_purge: Column, expired: Column, held: Column, oldest_held: Column, hours: int = 36) -> Column:
    """Whether the purge is behind: a row expired for over ``hours``, a last purge as old, or none ever with something due."""
    over = lambda t: F.coalesce(F.unix_micros(now) - F.unix_micros(t) > hours * 3_600_000_000, F.lit(False))
    return F.when(over(oldest_expired), True).when(last_purge.isNotNull(), over(last_purge)).when(expired > 0, True).otherwise((held > 0) & over(oldest_held))


def purged(rows: DataFrame, orgs: DataFrame, org: str, expires: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and how many went of each org, zeros included."""
    gone = F.col(expires) <= now
    counts = orgs.select(org).join(rows.where(gone).groupBy(org).agg(F.count("*").alias("purged")), org, "left").na.fill(0, ["purged"])
    return rows.where(~F.coalesce(gone, F.lit(False))), counts
