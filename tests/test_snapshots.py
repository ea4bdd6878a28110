"""The stored snapshot over batches, replays and lost runs; cuts by many rules."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from spinewright.operators import ingest, snapshots

ROW = "id long, payload string, payload_hash string, fetched_at string, last_seen_at string"
GATED = snapshots.hash_gated(["payload"], ["last_seen_at"])


def _batch(spark, rows, day):
    return spark.createDataFrame([(i, p, hashlib.md5(p.encode()).hexdigest(), day, day) for i, p in rows], ROW)


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/rows") for f in names if f.startswith("part-")}


def _rows(spark, path):
    return {x["id"]: tuple(x)[1:] for x in snapshots.snapshot(spark, path).select("id", "payload", "fetched_at", "last_seen_at").collect()}


def _tallies(spark, path):
    return {x["batch"]: (x["inserted"], x["changed"], x["unchanged"]) for x in snapshots.tallies(spark, path).collect()}


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = f"{tmp_path}/store"
    first = _batch(spark, [(i, f"p{i}") for i in range(400)], "d1")
    assert snapshots.upsert_into(path, first, ["id"], 1, GATED, 16)
    before = _files(path)
    second = _batch(spark, [(3, "p3"), (4, "new"), (900, "p900")], "d2")
    assert snapshots.upsert_into(path, second, ["id"], 2, GATED, 16)
    after = _files(path)
    buckets = {r["b"] for r in second.select(snapshots._bucket(["id"], 16).alias("b")).collect()}
    bucket_of = lambda f: int(f.split("bucket=")[1].split("/")[0])
    assert {f for f in before if bucket_of(f) not in buckets} == {f for f in after if bucket_of(f) not in buckets}
    assert all(before[f] == after[f] for f in before if bucket_of(f) not in buckets) and len(buckets) < 4
    rows = _rows(spark, path)
    assert len(rows) == 401 and rows[3] == ("p3", "d1", "d2") and rows[4] == ("new", "d1", "d2") and rows[5] == ("p5", "d1", "d1") and rows[900] == ("p900", "d2", "d2")
    assert _tallies(spark, path) == {1: (400, 0, 0), 2: (1, 1, 1)}
    # a replay, of either batch, does nothing
    assert not snapshots.upsert_into(path, first, ["id"], 1, GATED, 16) and not snapshots.upsert_into(path, second, ["id"], 2, GATED, 16)
    assert _files(path) == after and _rows(spark, path) == rows


def test_a_run_lost_before_its_tally_is_applied_again(spark, tmp_path):
    path = f"{tmp_path}/store"
    snapshots.upsert_into(path, _batch(spark, [(1, "a"), (2, "b")], "d1"), ["id"], 1, GATED, 4)
    again = _batch(spark, [(2, "c"), (1, "a"), (3, "d")], "d2")
    snapshots.upsert_into(path, again, ["id"], 2, GATED, 4)
    rows, tally = _rows(spark, path), _tallies(spark, path)
    for d, _, names in list(os.walk(f"{path}/batches/batch=2")):
        for n in names:
            os.remove(os.path.join(d, n))
    assert 2 not in _tallies(spark, path)
    assert snapshots.upsert_into(path, again, ["id"], 2, GATED, 4)
    assert _rows(spark, path) == rows and _tallies(spark, path) == tally == {1: (2, 0, 0), 2: (1, 1, 1)}


def test_empty_batches_and_nulls(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert snapshots.upsert_into(path, _batch(spark, [], "d0"), ["id"], 0, GATED, 4)
    rows = spark.createDataFrame([(1, None, None, "d1", "d1"), (2, "x", "h", "d1", "d1")], ROW)
    snapshots.upsert_into(path, rows, ["id"], 1, GATED, 4)
    snapshots.upsert_into(path, spark.createDataFrame([(1, "y", "k", "d2", "d2"), (2, None, None, "d2", "d2")], ROW), ["id"], 2, GATED, 4)
    assert _rows(spark, path) == {1: ("y", "d1", "d2"), 2: (None, "d1", "d2")}


def test_values_only_go_up(spark, tmp_path):
    path, rule = f"{tmp_path}/store", snapshots.only_up("state", {"seen": 1, "called": 2, "won": 3})
    for n, rows in enumerate([[(1, "called"), (2, "seen"), (3, "odd")], [(1, "seen"), (2, "won"), (3, "seen")], [(2, "called"), (4, "seen")]]):
        snapshots.upsert_into(path, spark.createDataFrame(rows, "id long, state string"), ["id"], n, rule, 4)
    assert dict(snapshots.snapshot(spark, path).select("id", "state").collect()) == {1: "called", 2: "won", 3: "seen", 4: "seen"}


def test_a_stream_into_a_snapshot(spark, tmp_path):
    for i in range(3):
        _batch(spark, [(k, f"p{k + i // 2}") for k in range(20 * i, 20 * i + 30)], f"d{i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    sink = snapshots.snapshot_sink(f"{tmp_path}/store", ["id"], GATED, 4)
    for checkpoint in ("one", "two"):  # delivered twice from the start
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    assert len(_rows(spark, f"{tmp_path}/store")) == 70
    assert sorted(_tallies(spark, f"{tmp_path}/store").values()) == [(20, 0, 10), (20, 10, 0), (30, 0, 0)]


def _cut(rows, rules, banned):
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    out, seen = [], set()
    for group, holds, n in rules:
        first = sorted((r for r in rows if holds(r)), key=lambda r: (digest(r), r))[: 3 * n + 10]
        mine = [r for r in first if r not in seen and r not in banned][:n]
        seen |= set(mine)
        out += [(group, r) for r in mine]
    return sorted(out)


def test_many_rules_are_one_scan_and_the_same_rows(spark):
    r, ids = random.Random(4), range(1, 800)
    rules = [(f"g{i}", r.choice([2, 3, 5, 7, 11, 97]), r.choice([0, 1]), r.randint(1, 6)) for i in range(18)]
    df, banned = spark.createDataFrame([(i,) for i in ids], "id long"), set(range(0, 800, 4))
    out = ingest.cut_sample(df, [(g, F.col("id") % m == k, n, False) for g, m, k, n in rules] + [("rest", F.lit(True), 125, True)], "id", F.col("id") % 4 == 0)
    want = _cut(ids, [(g, lambda i, m=m, k=k: i % m == k, n) for g, m, k, n in rules] + [("rest", lambda i: True, 125)], banned)
    assert sorted((x["group"], x["id"]) for x in out.collect()) == want
    plan = ingest._ranked(df, [(g, F.col("id") % m == k, n) for g, m, k, n in rules], [9] * 18, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "WindowGroupLimit" in plan


def test_a_required_group_must_have_a_row(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(ValueError, match="big"):
        ingest.cut_sample(df, [("big", F.col("id") > 5, 2, True)], "id")
    assert ingest.cut_sample(df, [("big", F.col("id") > 5, 2, False)], "id").count() == 0
