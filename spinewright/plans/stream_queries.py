"""Streaming queries, run to the end of what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spinewright.core import scratch
from spinewright.operators import meter, reserve
from spinewright.plans.model_queries import ORACLES as MODEL_SQL
from spinewright.streaming import observe


def _path(spark: SparkSession) -> str:
    return scratch(spark, "stream")


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = observe.drained(observe.windowed(observe.event_stream(spark, sf_dir)), _path(spark), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "events")


def stream_settled_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    e = observe.event_stream(spark, sf_dir).withColumn("request", F.concat_ws("/", F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))).select("request", "user_id")
    q = e.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(observe.ledger_sink(f"{path}/ledger", "request")).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/ledger").groupBy("user_id").agg(F.count("*").alias("requests"))


def stream_reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reservations of their customer with leases of 60 days: finished ones settle for nine tenths after ten
    days, partly finished ones after 90, when their lease has run out, open ones never."""
    reserve.state_store(spark)
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    o = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    at, micros = F.col("o_orderdate").cast("timestamp"), meter.micros(F.col("o_totalprice"))
    event = lambda kind, at, micros: F.struct(F.lit(kind).alias("kind"), at.alias("at"), micros.alias("micros"))
    asked = event("reserve", at, micros)
    paid = lambda days: event("settle", at + F.expr(f"interval '{days}' day"), F.floor(micros * 9 / 10).cast("long"))
    events = F.when(F.col("o_orderstatus") == "F", F.array(asked, paid(10))).when(F.col("o_orderstatus") == "P", F.array(asked, paid(90))).otherwise(F.array(asked))
    rows = o.select(F.col("o_custkey").alias("period"), F.col("o_orderkey").alias("request_id"), F.explode(events).alias("e")).select("period", "request_id", "e.*")
    out = observe.drained(reserve.metered(rows, CAP, "60 days"), _path(spark), "append")
    return out.where(F.col("outcome") != reserve.EXPIRED).select("period", "request_id", F.unix_seconds("at").alias("at"), "outcome", "micros", "reserved", "spent")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = observe.drained(observe.sessions(observe.event_stream(spark, sf_dir), "user_id", 30), _path(spark), "complete")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("started")).cast("long")  # a row a session of one user
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", number.alias("session"), "events", text("started"), text("ended"))


def stream_local_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = observe.drained(observe.local_weeks(observe.event_stream(spark, sf_dir)), _path(spark), "complete")
    return out.groupBy("week", "partition").agg(F.sum("events").alias("events"), F.count("*").alias("types"))


CAP = 500_000_000_000
QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_settled_once, stream_reserved, stream_sessions, stream_local_weeks)}
# the zone's offset by its rule: six hours behind, five from the second Sunday of March to the first of November, at two o'clock
_LOCAL = """SELECT event_type, ts - INTERVAL 1 HOUR * (6 - (ts >= m + INTERVAL 8 HOUR AND ts < n + INTERVAL 7 HOUR)::INT) AS t FROM (SELECT *,
  make_date(year(ts), 3, 8) + INTERVAL 1 DAY * ((7 - dayofweek(make_date(year(ts), 3, 8))) % 7) AS m, make_date(year(ts), 11, 1) + INTERVAL 1 DAY * ((7 - dayofweek(make_date(year(ts), 11, 1))) % 7) AS n FROM events)"""
ORACLES = {
    "stream_sessions": MODEL_SQL["sessionize"],
    "stream_local_weeks": f"""WITH w AS (SELECT event_type, (date_diff('day', DATE '1970-01-05', t::DATE) // 7)::BIGINT AS week FROM ({_LOCAL}))
SELECT week, (week % 4)::INT AS partition, count(*) AS events, count(DISTINCT event_type) AS types FROM w GROUP BY 1""",
    "stream_reserved": f"""WITH RECURSIVE o AS (SELECT o_custkey::VARCHAR AS period, o_orderkey::VARCHAR AS id, epoch(o_orderdate)::BIGINT AS t, floor(o_totalprice * 1000000 + 0.5)::BIGINT AS m, o_orderstatus AS s FROM orders),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY period ORDER BY t, id, kind) AS r FROM (
  SELECT period, id, t, 'reserve' AS kind, m FROM o UNION ALL SELECT period, id, t + 86400 * CASE s WHEN 'F' THEN 10 ELSE 90 END, 'settle', floor(m * 9 / 10)::BIGINT FROM o WHERE s IN ('F', 'P'))),
w AS (SELECT period, 0::BIGINT AS r, '' AS id, 0::BIGINT AS t, '' AS outcome, 0::BIGINT AS m, 0::BIGINT AS spent, []::STRUCT(id VARCHAR, til BIGINT, m BIGINT)[] AS leases FROM (SELECT DISTINCT period FROM e)
  UNION ALL SELECT period, r, id, t, CASE WHEN kind = 'settle' THEN CASE WHEN mine THEN 'settled' ELSE 'late_settled' END WHEN fits THEN 'granted' ELSE 'refused' END, m, CASE kind WHEN 'settle' THEN spent + m ELSE spent END,
    CASE WHEN kind = 'settle' THEN list_filter(open, lambda x: x.id <> id) WHEN fits THEN list_append(open, {{'id': id, 'til': t + 60 * 86400, 'm': m}}) ELSE open END
  FROM (SELECT *, len(list_filter(open, lambda x: x.id = id)) > 0 AS mine, spent + coalesce(list_sum(list_transform(open, lambda x: x.m)), 0) + m <= {CAP} AS fits
    FROM (SELECT e.period, e.r, e.id, e.t, e.kind, e.m, w.spent, list_filter(w.leases, lambda x: x.til >= e.t) AS open FROM w JOIN e ON e.period = w.period AND e.r = w.r + 1)))
SELECT period, id AS request_id, t AS "at", outcome, m AS micros, coalesce(list_sum(list_transform(leases, lambda x: x.m)), 0)::BIGINT AS reserved, spent FROM w WHERE r > 0""",
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "stream_settled_once": "SELECT user_id, count(DISTINCT json_extract_string(props, '$.k')) AS requests FROM events GROUP BY 1",
}
