"""Reservations against a period's cap, granted in order: in batches, a hot period by blocks, and as a stream with leases."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from spinewright.core import materialize

#: Rows of a period that one task walks; periods with more are walked by blocks of about so many.
TASK_ROWS = 1_000_000


def _walked(rows: DataFrame, cap: int) -> DataFrame:
    """Adds ``accepted`` to ``row, walk_period, walk_amount, walk_start`` (what is granted before the first of them), taken in the
    partitions' order. A task holds one number and a batch of rows."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, 0
        for b in batches:
            accepted, sums = [], []
            for key, n, start in zip(*[b[c].to_pylist() for c in ("walk_period", "walk_amount", "walk_start")], strict=True):
                if now is None or key != now[0]:
                    now, held = (key,), start
                fits = n is not None and n > 0 and held + n <= cap
                held += n if fits else 0
                accepted.append(fits)
                sums.append(held)
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pa.array(accepted, pa.bool_()), pa.array(sums, pa.int64())], [*names, "accepted", "held"])

    names = rows.columns
    return rows.mapInArrow(walk, StructType([*rows.schema.fields, StructField("accepted", BooleanType()), StructField("held", LongType())]))


def reserved(requests: DataFrame, period: str, order: list[str], amount: str, cap: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds ``accepted`` and ``held`` (what is granted so far) to reservations in event order: one is granted if it fits
    beside what has been granted before it in its ``period``; a refused one takes nothing. Amounts that are null, zero
    or negative are refused. ``order`` is total within a period.

    Each grant depends on the last, so a period is walked in order by one task. A period of more than ``task_rows`` rows
    isn't: its order is cut into blocks of about as many, which are summed up. Once ``left`` is what the cap leaves, larger
    requests are refused for good, as nothing is given back; so a block whose remaining ones fit together is granted
    whole, one without any is refused whole, and only blocks where the cap is met are walked, each in a task.
    """
    w = [f"walk_{i}" for i in range(len(order))]
    rows = requests.select(F.struct(*requests.columns).alias("row"), F.col(period).cast("string").alias("walk_period"), F.col(amount).cast("long").alias("walk_amount"), F.lit(0).cast("long").alias("walk_start"), *[F.col(o).alias(x) for o, x in zip(order, w, strict=True)])
    sizes = requests.groupBy(F.col(period).cast("string").alias("walk_period")).agg(F.count("*").alias("n")).where(F.col("n") > task_rows)
    hot = {r["walk_period"]: r["n"] for r in sizes.collect()}  # total rows / task_rows periods at most
    is_hot = F.coalesce(F.col("walk_period"), F.lit("\0")).isin(["\0" if k is None else k for k in hot])
    columns = [F.col("row.*"), "accepted", "held"]
    cold = rows.where(~is_hot) if hot else rows
    walked = _walked(cold.repartition("walk_period").sortWithinPartitions("walk_period", *w).select("row", "walk_period", "walk_amount", "walk_start"), cap).select(*columns)
    return reduce(DataFrame.unionByName, [_by_blocks(rows.where(F.col("walk_period").eqNullSafe(F.lit(k))), w, cap, n // task_rows + 1, task_rows).select(*columns) for k, n in hot.items()], walked)


def _by_blocks(rows: DataFrame, w: list[str], cap: int, blocks: int, task_rows: int) -> DataFrame:
    """One hot period."""
    dealt = materialize(rows.repartitionByRange(blocks, *w).withColumn("block", F.spark_partition_id()))
    amount, held, at = F.col("walk_amount"), 0, 0
    rules: list[tuple[int, int, bool]] = []  # block, the largest amount that is granted there, and whether it is walked
    walked: list[DataFrame] = []
    while at < blocks:
        left = cap - held
        sums = dealt.where((F.col("block") >= at) & amount.between(1, left)).groupBy("block").agg(F.sum(amount.cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))
        fitting = {r["block"]: (int(r["total"]), r["n"]) for r in sums.collect()}  # a row a block
        while at < blocks and held + fitting.get(at, (0, 0))[0] <= cap:
            rules.append((at, left, False))
            held += fitting.get(at, (0, 0))[0]
            at += 1
        if at == blocks:
            break
        if cap - held < left:  # what was granted since leaves less, so fewer requests are in question
            continue
        # the cap is met in this block: it is walked, with later ones as long as few rows are in question
        stop, n = at + 1, fitting[at][1]
        while stop < blocks and n + fitting.get(stop, (0, 0))[1] <= task_rows:
            n += fitting.get(stop, (0, 0))[1]
            stop += 1
        part = dealt.where(F.col("block").between(at, stop - 1) & amount.between(1, left)).withColumn("walk_start", F.lit(held).cast("long"))
        done = materialize(_walked(part.repartition(1).sortWithinPartitions(*w).select("row", "walk_period", "walk_amount", "walk_start", "block", *w), cap))
        walked.append(done)
        rules += [(b, left, True) for b in range(at, stop)]
        held = max(held, done.agg(F.max("held")).first()[0] or 0)
        at = stop
    table = dealt.sparkSession.createDataFrame(rules, "block int, most long, walk boolean")
    ruled = dealt.join(F.broadcast(table), "block")  # a row a block
    fits = F.coalesce(amount.between(1, F.col("most")), F.lit(False))
    keep = ["row", "walk_amount", "block", "accepted", *w]
    out = ruled.where(~F.col("walk") | ~fits).withColumn("accepted", fits & ~F.col("walk")).select(keep)
    return _with_held(materialize(reduce(DataFrame.unionByName, [d.select(keep) for d in walked], out)), w)


def _with_held(rows: DataFrame, w: list[str]) -> DataFrame:
    """``held`` of rows of one period from their grants: the blocks' sums added up, and a running sum in each."""
    granted = F.when(F.col("accepted"), F.col("walk_amount")).otherwise(F.lit(0)).cast("long")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = rows.groupBy("block").agg(F.sum(granted).alias("g")).select("block", F.coalesce(F.sum("g").over(before), F.lit(0).cast("long")).alias("start"))
    within = Window.partitionBy("block").orderBy(*w).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(starts), "block").withColumn("held", F.col("start") + F.sum(granted).over(within))


GRANTED, REFUSED, SETTLED, LATE, REPEATED, RELEASED, EXPIRED, UNKNOWN = "granted", "refused", "settled", "late_settled", "repeated", "released", "expired", "unknown"
_OUT = "period string, request_id string, at_ms long, outcome string, micros long, reserved long, spent long, crossed_80 boolean"
_ANSWER = Row(*[f.split(" ")[0] for f in _OUT.split(", ")])


class _Meter(StatefulProcessor):
    """A period's meter: what is reserved and spent with the open leases, in one value, and the requests that are settled.

    Every access to state is a call to another process, so a batch reads and writes the value once, asks for a request's
    settlement only in a period that has been seen before, and keeps one timer a period: that of the next lease to run out."""

    def __init__(self, cap: int, lease_ms: int):
        self.cap, self.lease_ms = cap, lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meter = handle.getValueState("meter", "reserved long, spent long, warned boolean, timer_ms long, leases array<struct<request_id: string, micros: long, until_ms: long>>")
        self.settled = handle.getMapState("settled", "request_id string", "micros long")

    def _row(self, period: str, request: str, at_ms: int, outcome: str, micros: int) -> Row:
        over = (self.spent + self.held) * 100 >= self.cap * 80
        crossed, self.warned = over and not self.warned and outcome == GRANTED, self.warned or (over and outcome == GRANTED)
        return _ANSWER(period, request, at_ms, outcome, micros, self.held, self.spent, crossed)

    def _expired(self, period: str, before_ms: int) -> list[Row]:
        """Leases that ran out before ``before_ms``, by the time they did."""
        rows = []
        while self.ends and self.ends[0][0] < before_ms:
            until, request = heapq.heappop(self.ends)
            if (lease := self.leases.get(request)) and lease[1] == until:
                del self.leases[request]
                self.held -= lease[0]
                rows.append(self._row(period, request, until, EXPIRED, lease[0]))
        return rows

    def _load(self) -> None:
        was = self.meter.get()
        self.new, self.paid = was is None, {}
        self.held, self.spent, self.warned, self.timer, leases = was or (0, 0, False, None, [])
        self.leases = {request: (micros, until) for request, micros, until in leases}
        self.ends = sorted((until, request) for request, (_, until) in self.leases.items())

    def _save(self, fired: int | None = None) -> None:
        """``fired``: the time up to which timers are gone."""
        if self.timer is not None and fired is not None and self.timer <= fired:
            self.timer = None
        following = min((until for _, until in self.leases.values()), default=None)
        if following is not None and (self.timer is None or following + 1 < self.timer):
            self.timer = following + 1  # a later one that is still set finds nothing to do
            self.handle.registerTimer(self.timer)
        for request, micros in self.paid.items():
            self.settled.updateValue((request,), (micros,))
        self.meter.update((self.held, self.spent, self.warned, self.timer, [(r, m, u) for r, (m, u) in self.leases.items()]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        self._load()
        out = []
        for at_us, request, kind, micros in sorted((r["at_us"], r["request_id"], r["kind"], r["micros"] or 0) for r in rows):
            at = at_us // 1000
            out += self._expired(key[0], at)
            out.append(self._row(key[0], request, at, *self._event(at, kind, request, micros)))
        self._save()
        yield from out

    def _is_settled(self, request: str) -> bool:
        return request in self.paid or (not self.new and self.settled.containsKey((request,)))

    def _event(self, at: int, kind: str, request: str, micros: int) -> tuple[str, int]:
        lease = self.leases.get(request)
        if kind == "reserve":
            if lease is not None or self._is_settled(request):
                return REPEATED, micros
            if micros <= 0 or self.spent + self.held + micros > self.cap:
                return REFUSED, micros
            self.held += micros
            self.leases[request] = (micros, at + self.lease_ms)
            heapq.heappush(self.ends, (at + self.lease_ms, request))
            return GRANTED, micros
        if kind == "settle":
            if self._is_settled(request):
                return REPEATED, micros
            self.paid[request] = micros
            self.spent += micros
        if lease is None:
            return (LATE if kind == "settle" else UNKNOWN), micros
        del self.leases[request]
        self.held -= lease[0]
        return (SETTLED if kind == "settle" else RELEASED), micros

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        self._load()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = self._expired(key[0], now)
        self._save(fired=now)
        yield from rows

    def close(self) -> None:
        pass


def metered(events: DataFrame, cap: int, lease: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """A stream of ``period, at, kind, request_id, micros`` (kind: reserve, settle or release) answered event by event: ``period,
    request_id, at, outcome, micros, reserved, spent, crossed_80``, the sums being those after the event.

    A period's state is its sums, its open leases and its settled requests. A reservation is granted if it fits beside what
    is spent and reserved; a lease that has run out is given back before any later event, and by an event-time timer where
    none comes. A settlement is spent even if its lease is gone (``late_settled``), and once only. Events are taken in the
    order of their times within a micro-batch and as they arrive otherwise, as an answer can't wait; events later than
    ``late`` are dropped by the watermark. The session needs the RocksDB state store."""
    timed = events.withWatermark("at", late).select(F.col("period").cast("string").alias("period"), "at", F.unix_micros("at").alias("at_us"), "kind", F.col("request_id").cast("string").alias("request_id"), F.col("micros").cast("long").alias("micros"))
    lease_ms = int(pd.Timedelta(lease).total_seconds() * 1000)
    answers = timed.groupBy("period").transformWithState(_Meter(cap, lease_ms), _OUT, "append", "eventTime")
    return answers.withColumn("at_ms", F.timestamp_millis("at_ms")).withColumnRenamed("at_ms", "at")


def state_store(spark: SparkSession) -> None:
    """Set the state store that :func:`metered` needs, where the session has another."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

