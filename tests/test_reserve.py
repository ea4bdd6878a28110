"""Reservations in batches and as a stream against a loop over them."""

import random
from datetime import datetime, timedelta

import pytest

from spinewright.operators import reserve
from spinewright.streaming import observe

ROWS = "period string, at long, micros long"


def _loop(rows, cap):
    out, held = {}, {}
    for p, i, n in sorted(rows, key=lambda r: r[1]):
        ok = n is not None and n > 0 and held.get(p, 0) + n <= cap
        held[p] = held.get(p, 0) + (n if ok else 0)
        out[i] = (ok, held[p])
    return out


def _same(spark, rows, cap, **options):
    got = reserve.reserved(spark.createDataFrame(rows, ROWS).repartition(5), "period", ["at"], "micros", cap, **options).collect()
    assert len(got) == len(rows) and {x["at"]: (x["accepted"], x["held"]) for x in got} == _loop(rows, cap)


@pytest.mark.parametrize("task_rows", [10_000, 100])
def test_reservations_walk_like_a_loop(spark, task_rows):
    r = random.Random(1)
    rows = [(r.choice(["p0", "p0", "p0", "p1", "p2", None]), i, r.choice([None, 0, -3, 5, 20, 50, 80, 101, 300])) for i in range(3000)]
    _same(spark, rows, 1000, task_rows=task_rows)
    _same(spark, [], 1)


@pytest.mark.parametrize("kind", ["plenty", "none", "small_later", "falling"])
def test_a_hot_period_goes_by_blocks(spark, kind, monkeypatch):
    amount = {"plenty": lambda i: 1 + i % 9, "none": lambda i: 10**9, "small_later": lambda i: 700 if i < 900 else 1 if i % 100 == 0 else 500, "falling": lambda i: 4000 - i}[kind]
    rows = [("hot", i, amount(i)) for i in range(4000)] + [("cold", 5000 + i, 40) for i in range(50)]
    walks = []
    monkeypatch.setattr(reserve, "_walked", lambda df, cap, walk=reserve._walked: walks.append(1) or walk(df, cap))
    _same(spark, rows, 10**6, task_rows=200)
    assert len(walks) <= {"plenty": 1, "none": 1, "small_later": 4, "falling": 4}[kind]  # one for the cold period


def _events(rows):
    start = datetime(2024, 3, 1)
    return [(p, start + timedelta(minutes=t), kind, request, micros) for p, t, kind, request, micros in rows]


def _metered(spark, tmp_path, batches, cap, **options):
    """The stream's answers, a file a micro-batch."""
    reserve.state_store(spark)
    schema = "period string, at timestamp, kind string, request_id string, micros long"
    for i, rows in enumerate(batches):
        spark.createDataFrame(_events(rows), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = observe.drained(reserve.metered(stream, cap, **options), str(tmp_path / "out"), "append")
    return sorted((x["at"], x["request_id"], x["outcome"], x["reserved"], x["spent"], x["crossed_80"]) for x in out.collect())


def test_a_stream_of_reservations(spark, tmp_path):
    batches = [
        [("p", 0, "reserve", "a", 60), ("p", 1, "reserve", "b", 50), ("p", 2, "reserve", "c", 40), ("q", 2, "reserve", "d", 100)],
        [("p", 3, "settle", "a", 70), ("p", 4, "settle", "a", 70), ("p", 5, "release", "c", 0), ("p", 6, "release", "zz", 0), ("p", 7, "reserve", "e", 30), ("p", 8, "reserve", "e", 30)],
        # e's lease runs out at 17: its settlement is spent all the same, and what it held is free before
        [("p", 18, "reserve", "f", 25), ("p", 19, "settle", "e", 20), ("p", 20, "reserve", "g", 0), ("p", 20, "reserve", "h", 5)],
    ]
    got = [(round((t - datetime(2024, 3, 1)).total_seconds() // 60), *rest) for t, *rest in _metered(spark, tmp_path, batches, 100, lease="10 minutes", late="1 hour")]
    assert got == [
        (0, "a", "granted", 60, 0, False), (1, "b", "refused", 60, 0, False), (2, "c", "granted", 100, 0, True), (2, "d", "granted", 100, 0, True),
        (3, "a", "settled", 40, 70, False), (4, "a", "repeated", 40, 70, False), (5, "c", "released", 0, 70, False), (6, "zz", "unknown", 0, 70, False),
        (7, "e", "granted", 30, 70, False), (8, "e", "repeated", 30, 70, False), (17, "e", "expired", 0, 70, False), (18, "f", "granted", 25, 70, False),
        (19, "e", "late_settled", 25, 90, False), (20, "g", "refused", 25, 90, False), (20, "h", "refused", 25, 90, False),
    ]


def test_timers_give_leases_back(spark, tmp_path):
    # nothing more comes for q, and the clock of the stream passes its lease
    batches = [[("q", 0, "reserve", "a", 60)], [("p", 30, "reserve", "b", 1)], [("p", 31, "reserve", "c", 1)]]
    got = _metered(spark, tmp_path, batches, 100, lease="10 minutes", late="1 minute")
    assert [(r, o, reserved) for _, r, o, reserved, _, _ in got] == [("a", "granted", 60), ("a", "expired", 0), ("b", "granted", 1), ("c", "granted", 2)]


def test_streamed_grants_are_the_batch_grants(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"p{r.randrange(4)}", i, r.choice([5, 20, 50, 80, 300])) for i in range(300)]
    batches = [[(p, i, "reserve", str(i), n) for p, i, n in rows[k : k + 100]] for k in range(0, 300, 100)]
    got = _metered(spark, tmp_path, batches, 1000, lease="30 days", late="1 day")
    assert {int(x[1]): (x[2] == "granted", x[3]) for x in got} == _loop(rows, 1000)
