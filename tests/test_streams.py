"""Streamed sessions and weeks against batch, and late rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spinewright.operators import report
from spinewright.streaming import observe

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"
START = datetime(2024, 3, 9)


def _stream(spark, path, batches):
    for i, rows in enumerate(batches):
        made = [(k, START + timedelta(minutes=m), u, t) for k, m, u, t in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_sessions_close_behind_the_watermark_and_late_rows_are_counted(spark, tmp_path):
    batches = [
        [(1, 0, 7, "a"), (2, 30, 7, "a"), (3, 61, 7, "a"), (4, 5, 8, "a")],
        [(5, 400, 9, "a")],
        [(10, 402, 9, "a")],
        [(6, 2, 8, "a"), (7, 3, 7, "a"), (8, 401, 9, "a")],  # the watermark is at 280: two rows are too late
        [(9, 900, 9, "a")],
    ]
    stream = observe.sessions(_stream(spark, tmp_path / "in", batches), "user_id", 30)
    out, late = observe.counted(stream, str(tmp_path / "out"), "append")
    got = sorted((x["user_id"], x["events"], round((x["ended"] - x["started"]).total_seconds() / 60)) for x in out.collect())
    # exactly half an hour goes on, a minute more starts the next; the last session is still open
    assert got == [(7, 1, 0), (7, 2, 30), (8, 1, 0), (9, 3, 2)] and late == 2


def test_streamed_sessions_are_those_of_a_batch(spark, tmp_path):
    rows = [(i, (i * i * 7) % 3000, i % 3, "a") for i in range(200)]
    stream = observe.sessions(_stream(spark, tmp_path / "in", [rows]), "user_id", 30)
    got = observe.drained(stream, str(tmp_path / "out"), "complete").select("user_id", "events", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started", "ended")])
    batch = report.sessions(spark.createDataFrame([(k, START + timedelta(minutes=m), u, t) for k, m, u, t in rows], SCHEMA), "user_id", "ts", 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select("user_id", "events", "started", "ended").collect()))


def test_weeks_turn_at_local_midnight(spark, tmp_path):
    # Monday 11 March 2024 starts at 05:00 UTC, as the clock has changed the day before
    rows = [(1, 2 * 1440 + 5 * 60 - 1, 1, "a"), (2, 2 * 1440 + 5 * 60, 1, "a"), (3, 1440, 1, "b")]
    out = observe.drained(observe.local_weeks(_stream(spark, tmp_path / "in", [rows])), str(tmp_path / "out"), "complete")
    weeks = {(x["week"], x["event_type"]): x["events"] for x in out.collect()}
    assert weeks == {(2826, "a"): 1, (2827, "a"): 1, (2826, "b"): 1} and all(x["partition"] == x["week"] % 4 for x in out.collect())
