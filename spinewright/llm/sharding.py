"""K-d tree sharding, in DataFrame functions only.

The root holds all documents. Each round splits every node at the distributed weighted median, by bytes, of its
widest metadata dimension, until a leaf's bytes are the target (given as such, or as a number of shards); the leaves are
the shards, near equal in bytes (law ``bytes``). A node that stands for an odd number of shards is split at that share of its bytes (3 of 7 for 7),
so any number of shards is met. Dimensions are the text's size, its bytes a character, and its words' mean length, so
equal texts have equal coordinates; ties go by a hash of the text. Law of groups: equal texts share a shard, unless
their group outweighs ``GROUP_SHARE`` of a shard and lies on a border. Then a hash of the id splits the group, as near
equal sizes and whole groups can't both hold when one group outweighs a shard.

A median is found by histograms: the node's range is cut into ``BINS`` bins, their bytes are summed in Spark, and
the bin that holds the median is cut again, first along the dimension, then along the hashes. The driver sees
``MOST_SUMS`` sums a round at most (with more nodes, a node has fewer bins), never a row of the table. Splits and searches
are small tables by node that meet the rows in a broadcast join, so plans don't grow with the number of shards; rows
carry their node, written anew a level. Slots number a shard's rows through hash buckets and their counts, so no shard
is sorted in one task.

Null texts weigh one byte like empty ones. Very long texts count with all their bytes. Rows equal in id and text, or
without an id, are told apart by a number from where they stand in the table, which only matters where their group is
split, and for their slots. An empty table gives no rows. Extra columns are ignored by :func:`kd_shards` and kept by
:func:`with_shard`, whatever their names; a column ``shard`` is replaced.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinewright.core import materialize
from spinewright.llm.rows import packed

BINS, LEAST_BINS, MOST_SUMS = 256, 8, 1_000_000
#: Share of a shard's bytes above which equal texts are split by their ids.
GROUP_SHARE = 0.02
#: Share of a shard's bytes to which a median is searched.
FINE_SHARE = 0.0005
#: Bits of the hashes; the lower ``ROW_BITS`` of the id's tell equal rows apart.
HASH_BITS, ROW_BITS = 40, 16
ROWS_A_BUCKET = 50_000
DIMENSIONS = ("d_bytes", "d_width", "d_words")


def coordinates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``s_size``, the dimensions as whole numbers, and the hashes that break ties, to ``docs``."""
    text, mask = F.coalesce(F.col(text_col), F.lit("")), F.lit((1 << HASH_BITS) - 1)
    n = F.octet_length(text).cast("long")
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" ")))
    return docs.withColumns({
        "s_size": n + 1, "d_bytes": n, "d_width": F.floor(F.lit(1000) * n / F.greatest(F.length(text), F.lit(1))).cast("long"),
        "d_words": F.floor(F.lit(1000) * n / (spaces + 1)).cast("long"), "t_text": F.xxhash64(text).bitwiseAND(mask), "t_id": F.shiftleft(F.xxhash64(F.lit("shard"), F.col(id_col)).bitwiseAND((1 << (HASH_BITS - ROW_BITS)) - 1), ROW_BITS).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << ROW_BITS) - 1)),
    })


class _Split:
    """The search for one node's weighted median: which rows may still hold it, and the bytes before them."""

    def __init__(self, dimension: str, low: int, high: int, total: int, share: float, shard: float):
        self.keys, self.at, self.low, self.high = (dimension, "t_text", "t_id"), 0, low, high
        self.fixed: list[int] = []
        self.before, self.half, self.edge = 0, total * share, None
        self.group, self.fine = GROUP_SHARE * shard, FINE_SHARE * shard

    def row(self, node: int) -> tuple[int, int, int, int, int, int, int]:
        f0, f1 = [*self.fixed, 0, 0][:2]
        return node, DIMENSIONS.index(self.keys[0]), self.at, f0, f1, self.low, self.high

    def narrow(self, bins: list) -> None:
        """``bins``: (bin, bytes, least, largest), in order."""
        total = self.before
        for b in bins:
            if total + b["bytes"] >= self.half or b is bins[-1]:
                break
            total += b["bytes"]
        self.before = total
        one = b["least"] == b["largest"]
        if not one and b["bytes"] > self.fine:
            self.low, self.high = b["least"], b["largest"]
            return
        if one and (self.at == 0 or self.at == 1 and b["bytes"] > self.group):
            self.fixed.append(b["least"])
            self.at, self.low, self.high = self.at + 1, 0, (1 << HASH_BITS) - 1
            return
        after = abs(self.before + b["bytes"] - self.half) < abs(self.half - self.before)
        self.edge = (*self.fixed, b["largest"] + 1 if after else b["least"], *(0 for _ in self.keys[len(self.fixed) + 1 :]))


#: A level's splits: node, dimension, and the edge as value, text hash and id hash; rows before it go to the left child.
Level = list[tuple[int, int, int, int, int]]


def _binned(placed: DataFrame, open_: dict[int, _Split], bins: int) -> dict[int, list]:
    """For each node in search its bins' bytes, least and largest keys, in order."""
    spark = placed.sparkSession
    table = spark.createDataFrame([s.row(n) for n, s in open_.items()], "node long, d int, at int, f0 long, f1 long, low long, high long")
    value = F.element_at(F.array(*map(F.col, DIMENSIONS)), F.col("d") + 1)
    key = F.when(F.col("at") == 0, value).when(F.col("at") == 1, F.col("t_text")).otherwise(F.col("t_id"))
    here = key.between(F.col("low"), F.col("high")) & ((F.col("at") < 1) | (value == F.col("f0"))) & ((F.col("at") < 2) | (F.col("t_text") == F.col("f1")))
    rows = placed.join(F.broadcast(table), "node").where(here).select("node", key.alias("key"), "low", "s_size", (F.col("high") - F.col("low") + 1).alias("span"))
    at = F.when(F.col("span") <= bins, F.col("key") - F.col("low")).otherwise(F.expr(f"((key - low) * {bins}L) div span"))
    sums = rows.groupBy("node", at.alias("bin")).agg(F.sum("s_size").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("largest")).collect()  # MOST_SUMS
    out = defaultdict(list)
    for r in sorted(sums, key=lambda r: (r["node"], r["bin"])):
        out[r["node"]].append(r)
    return out


def _descended(rows: DataFrame, level: Level) -> DataFrame:
    """``rows`` with ``node`` one level down where it was split."""
    table = rows.sparkSession.createDataFrame(level, "node long, d int, e0 long, e1 long, e2 long")
    value = F.element_at(F.array(*map(F.col, DIMENSIONS)), F.col("d") + 1)
    before = (value < F.col("e0")) | ((value == F.col("e0")) & ((F.col("t_text") < F.col("e1")) | ((F.col("t_text") == F.col("e1")) & (F.col("t_id") < F.col("e2")))))
    down = F.when(F.col("d").isNull(), F.col("node")).when(before, 2 * F.col("node")).otherwise(2 * F.col("node") + 1)
    return rows.join(F.broadcast(table), "node", "left").withColumn("node", down).drop("d", "e0", "e1", "e2")  # a row a node


def tree(rows: DataFrame, shards: int) -> tuple[DataFrame, list[Level], list[tuple[int, int]]]:
    """``rows`` (narrow and materialised) with their leaf as ``node``; the levels' splits; and each leaf with its shard. Node ``n`` has
    the children ``2 n`` and ``2 n + 1``, the root is 1."""
    if shards < 1:
        raise ValueError(f"{shards} shards")
    placed, levels, leaves = rows.withColumn("node", F.lit(1).cast("long")), [], []
    now, overall = {1: (shards, 0)}, {}  # node: its shards, and the first of them
    while now:
        leaves += [(n, first) for n, (k, first) in now.items() if k == 1]
        wanted = {n: k for n, (k, _) in now.items() if k > 1}
        if not wanted:
            break
        ranges = placed.groupBy("node").agg(F.sum("s_size").alias("bytes"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]).collect()  # a row a node
        overall = overall or {d: max(1, max((r[f"high_{d}"] - r[f"low_{d}"] for r in ranges), default=1)) for d in DIMENSIONS}
        done: dict[int, _Split] = {}
        for r in sorted(ranges, key=lambda r: r["node"]):
            if (k := wanted.get(r["node"])) is not None:
                d = max(DIMENSIONS, key=lambda d: (r[f"high_{d}"] - r[f"low_{d}"]) / overall[d])
                done[r["node"]] = _Split(d, r[f"low_{d}"], r[f"high_{d}"], r["bytes"], (k // 2) / k, r["bytes"] / k)
        open_ = dict(done)
        while open_:
            bins = max(LEAST_BINS, min(BINS, MOST_SUMS // len(open_)))
            for n, sums in _binned(placed, open_, bins).items():
                open_[n].narrow(sums)
            open_ = {n: s for n, s in open_.items() if s.edge is None}
        level = [(n, DIMENSIONS.index(s.keys[0]), *s.edge) for n, s in done.items()]
        if level:
            placed = materialize(_descended(placed, level))
            levels.append(level)
        # nodes without rows have no children
        now = {child: part for n in done for k, first in (now[n],) for child, part in ((2 * n, (k // 2, first)), (2 * n + 1, (k - k // 2, first + k // 2)))}
    return placed, levels, leaves


def _sharded(placed: DataFrame, leaves: list[tuple[int, int]]) -> DataFrame:
    table = placed.sparkSession.createDataFrame(leaves, "node long, shard int")
    return placed.join(F.broadcast(table), "node").drop("node")  # a row a shard


def shards_for(rows: DataFrame, shards: int | None, target_bytes: int | None) -> int:
    """The number of shards, given or from the bytes that each should hold."""
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    return shards or max(1, -(-(rows.agg(F.sum("s_size")).first()[0] or 0) // target_bytes))


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    c = coordinates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return c.select("doc_id", "s_size", *DIMENSIONS, "t_text", "t_id", F.monotonically_increasing_id().alias("m"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))


def kd_shards(docs: DataFrame, shards: int | None = 16, id_col: str = "doc_id", text_col: str = "text", target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``, one row for each row of ``docs``; slots of a shard have no gaps."""
    rows = materialize(_narrow(docs, id_col, text_col))
    n = shards_for(rows, shards, target_bytes)
    placed, _, leaves = tree(rows, n)
    buckets = max(16, rows.count() // (n * ROWS_A_BUCKET) + 1)
    placed = _sharded(placed, leaves).select("doc_id", F.col("s_size").alias("size"), "text_crc32", "shard", "m", F.pmod(F.xxhash64("doc_id", "text_crc32", "m"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "m")
    return placed.withColumn("rank", F.row_number().over(order)).join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))


def with_shard(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """``docs`` with their ``shard``; whole rows stay where they are and descend the tree by broadcast joins."""
    rows = materialize(_narrow(docs, "doc_id", "text"))
    _, levels, leaves = tree(rows, shards_for(rows, shards, target_bytes))
    placed = coordinates(docs.select(packed(docs), "doc_id", "text")).drop("doc_id", "text").withColumn("node", F.lit(1).cast("long"))
    for level in levels:
        placed = _descended(placed, level)
    return _sharded(placed, leaves).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "shard"], "shard")
