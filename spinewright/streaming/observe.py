"""Structured Streaming forms: windowed counts, late and repeated events, latest state with expiry, an idempotent sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spinewright.operators import report

#: Fixed value: weeks in which all cells are swept once.
PARTITIONS = 4


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table's files as a stream; event times become instants, as watermarks need them."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("events"))


def sessions(events: DataFrame, key: str, gap_minutes: int, late: str = "2 hours") -> DataFrame:
    """Sessions of a key as a stream; a gap of more than ``gap_minutes`` starts the next. A session is given out once the
    watermark has passed its end and gap, or all of them with their state in complete mode."""
    gap = f"{gap_minutes} minutes 1 microseconds"  # a session window ends before its gap does
    timed = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key)
    return timed.agg(F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended")).drop("w")


def local_weeks(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events by the local week, Monday to Sunday, of the business zone: ``week`` (since Monday 1970-01-05), ``partition`` that is
    swept in it, ``event_type``, ``events``. The watermark runs on local time, which a clock change sets back by an hour at most."""
    timed = events.withColumn("local_ts", report.local(F.col("ts"))).withWatermark("local_ts", late)
    weeks = timed.groupBy(F.window("local_ts", "7 days", startTime="4 days").alias("w"), "event_type").agg(F.count("*").alias("events"))
    week = F.floor(F.datediff(F.col("w.start").cast("date"), F.lit("1970-01-05").cast("date")) / 7).cast("long")
    return weeks.select(week.alias("week"), F.pmod(week, F.lit(PARTITIONS)).cast("int").alias("partition"), "event_type", "events")


def once(events: DataFrame, key: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark, however often it is delivered."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def latest_with_expiry(events: DataFrame, key: str, hold: str = "30 days") -> DataFrame:
    """The last observation of each key as it changes, and ``expired`` once event time passes its hold."""
    hold_ms = int(pd.Timedelta(hold).total_seconds() * 1000)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ts, kind = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "ts_ms": [ts], "event_type": [kind], "status": ["expired"]})
            return
        last = state.get if state.exists else (-1, "")
        for b in batches:
            for ts, kind in zip(b["ts"].astype("int64") // (1_000_000 if b["ts"].dtype == "datetime64[ns]" else 1000), b["event_type"], strict=True):
                last = max(last, (int(ts), kind))
        state.update(last)
        state.setTimeoutTimestamp(max(last[0] + hold_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "ts_ms": [last[0]], "event_type": [last[1]], "status": ["live"]})

    grouped = events.withWatermark("ts", "2 hours").select(key, "ts", "event_type").groupBy(key)
    return grouped.applyInPandasWithState(step, f"{key} long, ts_ms long, event_type string, status string", "ts_ms long, event_type string", "update", GroupStateTimeout.EventTimeTimeout)


def ledger_sink(path: str, request: str, buckets: int = 64):  # noqa: ANN201
    """A ``foreachBatch`` function that writes each request once: a batch's folder is replaced when it is replayed,
    and requests of other batches are left out. The ledger lies in ``buckets`` by a hash of the request, so a batch
    reads the request column of the buckets it touches only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([request]).withColumn("bucket", F.pmod(F.xxhash64(request), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        try:
            old = spark.read.option("basePath", path).parquet(path).where(F.col("bucket").isin(touched) & (F.col("batch") != batch_id)).select("bucket", request)
            new = new.join(old, ["bucket", request], "left_anti")
        except AnalysisException as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")

    return write


def drained(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Run a stream over all that is there into ``path`` and read the result; a complete result replaces the last one.
    Other results go into a folder a batch, which a replay replaces, so no batch is there twice."""
    return counted(stream, path, mode)[0]


def counted(stream: DataFrame, path: str, mode: str) -> tuple[DataFrame, int]:
    """:func:`drained`, and how many rows came later than the watermark allows and were left out."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    late = sum(o.numRowsDroppedByWatermark for p in q.recentProgress for o in p.stateOperators)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows"), late
