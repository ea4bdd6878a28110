"""Near copies: pairs of texts whose sets of five-word shingles have a Jaccard similarity of ``SIMILAR`` or more.

A text's words (A-Z lowered, cut at ASCII white space) give its ``class``; texts of a class have equal shingles. Each class
gets 160 minima of its shingles' hashes. Twenty bands of five minima are the buckets of a first index; similar pairs
share one with a probability of 0.9996 at a similarity of 0.8, more above it. Buckets of up to ``BUCKET_PAIRS`` classes give
all their pairs. Members of larger ones would cost pairs by the square: they are compared with two members of the bucket and
indexed again by twenty bands of eight minima (0.975 at 0.8), treated alike. That links nearly all of a group of near
copies; in a last step the members of large buckets that are still in different components are joined by their rarest shingles,
which finds every similar pair of them. So two classes that share a bucket of the first index end in one component if they are
similar, whatever its size. Every candidate is verified on its whole shingle sets, so no pair below ``SIMILAR`` is ever a link; recall is by
the first index's probability alone and measured in the README.

Texts without words are in no class and no pair. Texts of fewer than five words have one shingle, all of their words.
Very long texts count with all their shingles. Equal texts are one class, ties of minima are equal shingles; an empty
table has no classes and no links. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spinewright.core import materialize, sized_join
from spinewright.llm.rows import gives_back
from spinewright.operators.graph import connected_components

SHINGLE = 5
#: Parts that similar sets share, as whole numbers where rounding would lose a pair.
_NUM, _DEN = 4, 5
SIMILAR = _NUM / _DEN
#: Classes in a bucket up to which all pairs are formed.
BUCKET_PAIRS = 16
#: Classes in a block of those that have a shingle.
BLOCK = 1_000
#: Bytes of shingle sets up to which they are broadcast.
BROADCAST_BYTES = 8_000_000
#: Pairs a task compares at once; each carries two sets of some kilobytes.
PAIRS_A_TASK = 5_000
#: Bands of a class in either index, and minima in a band.
BANDS, WIDE, FINE = 20, 5, 8
_MINIMA = BANDS * FINE
_CHUNK = 1 << 11
_ODD = np.random.default_rng(42).integers(0, 1 << 63, _MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingles(words: list[bytes]) -> np.ndarray:
    """The distinct 64-bit hashes of five words each, in order; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, size = max(1, len(h) - SHINGLE + 1), min(SHINGLE, len(h))
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def _bands(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a set in the first and in the second index."""
    least = np.full(_MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        least = np.minimum(least, (shingles[at : at + _CHUNK, None] * _ODD).min(axis=0))

    def keys(size: int) -> np.ndarray:
        of = least[: BANDS * size].reshape(BANDS, size)
        h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1000 * size)
        for j in range(size):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + of[:, j])
        return h.view(np.int64)

    return keys(WIDE), keys(FINE)


def _class(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 42) - (1 << 63)


def classes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``version, class, wide, fine`` of every distinct text with words: its hash, that of its words, and the buckets."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            version, name, wide, fine = [], [], [], []
            seen: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
            for v, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if v not in seen and (words := _words(t.as_py())):
                    seen[v] = (_class(words), *_bands(_shingles(words)))
                    version.append(v)
                    name.append(seen[v][0])
                    wide.append(seen[v][1])
                    fine.append(seen[v][2])
            lists = [pa.ListArray.from_arrays(pa.array(range(0, BANDS * len(x) + 1, BANDS), pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (wide, fine)]
            yield pa.RecordBatch.from_arrays([pa.array(version, pa.int64()), pa.array(name, pa.int64()), *lists], ["version", "class", "wide", "fine"])

    texts = docs.select(F.xxhash64(text_col).alias("version"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(gives_back(made), "version long, class long, wide array<long>, fine array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first = {c: t for c, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)}
        yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.int64()), pa.array([_shingles(_words(t.as_py())).tobytes() for t in first.values()], pa.binary())], ["class", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, z = ([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(i)] for i in (2, 3))
        keep = []
        for x, y in zip(a, z, strict=True):
            most = min(len(x), len(y)) / max(len(x), len(y))
            both = len(np.intersect1d(x, y, assume_unique=True)) if most >= SIMILAR else 0
            keep.append(both >= SIMILAR * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(i).filter(mask) for i in (0, 1)], ["src", "dst"])


def _candidates(index: DataFrame, bucket_pairs: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``src, dst`` of an index of ``class, bucket``, and the members ``bucket, class, n`` of large buckets."""
    shared = materialize(index.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("n > 1"))
    two = shared.where("n = 2").select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    more = shared.where("n > 2")
    members = materialize(sized_join(index, more, "bucket"))
    few = members.where(F.col("n") <= bucket_pairs).select("bucket", "class")
    pairs = few.join(few.select("bucket", F.col("class").alias("other")), "bucket").where("class < other").select(F.col("class").alias("src"), F.col("other").alias("dst"))
    large = members.where(F.col("n") > bucket_pairs)
    hubs = large.select("class", F.explode(F.array("lo", "hi")).alias("hub")).where("class <> hub").select(F.least("class", "hub").alias("src"), F.greatest("class", "hub").alias("dst"))
    return two.unionByName(pairs).unionByName(hubs).distinct(), large.select("bucket", "class", "n")


def _verified(pairs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """The similar ones of ``pairs``, materialised. ``size``: the bytes of ``sets``."""
    pairs = pairs.repartition(pairs.count() // PAIRS_A_TASK + 1, "src", "dst")
    a, z = (sets.select(F.col("class").alias(end), F.col("shingles").alias(f"{end}_set")) for end in ("src", "dst"))
    both = sized_join(sized_join(pairs, a, "src", limit=BROADCAST_BYTES, rows=size), z, "dst", limit=BROADCAST_BYTES, rows=size)
    return materialize(both.select("src", "dst", "src_set", "dst_set").mapInArrow(gives_back(_similar), "src long, dst long"))


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
        sizes = np.array([len(x) for x in sets], np.int64)
        of = pa.array(np.repeat(np.arange(len(sets)), sizes))
        named = [b.column(i).take(of) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*named, pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], ["class", "root", "size", "shingle"])


def _apart(large: DataFrame, linked: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of large buckets' members that ``linked`` leaves in different components and whose rarest shingles allow them to be similar.

    A bucket of one component has none. Similar sets of n and m shingles share 4/9 of n + m at least, so the first shingle
    they share, in an order that is the same for all, has at most (5n - 4m) / 9 others of the first set before it and
    (5m - 4n) / 9 of the second. The order is from rare to frequent: an edit's own shingles come first, and sets that differ
    by more than that never meet in the shingles of the text they have in common. A frequent shingle's sets are dealt into
    blocks of about ``BLOCK``, so no task holds all of them."""
    roots = connected_components(linked).select(F.col("node").alias("class"), "root")
    named = materialize(large.join(roots, "class", "left").select("bucket", "class", F.coalesce("root", "class").alias("root")))
    split = named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    open_ = materialize(named.join(split, "bucket").select("class", "root").distinct())
    texts = sized_join(sets, open_, "class").select("class", "root", "shingles")
    shingles = materialize(texts.mapInArrow(gives_back(_each_shingle), "class long, root long, size long, shingle long"))
    often = shingles.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    rare_first = Window.partitionBy("class").orderBy(F.coalesce("often", F.lit(1)), "shingle")
    placed = shingles.join(often, "shingle", "left").withColumn("at", F.row_number().over(rare_first) - 1).where(f"often > 1 and {_DEN} * at <= {_DEN - _NUM} * size")
    placed = materialize(placed.withColumn("blocks", F.ceil(F.col("often") / BLOCK).cast("long")))
    # a pair's smaller set lies in one block, the larger one goes to all
    small = placed.where(_within("at", "size", "size")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks"))).drop("often", "blocks")
    wide = placed.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("class", "root", "size", "at")], F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    met = small.join(wide.hint("merge"), ["shingle", "block"]).where("root <> other_root and (size < other_size or size = other_size and class < other_class)")
    near = met.where(_within("at", "size", "other_size")).where(_within("other_at", "other_size", "size"))
    return near.select(F.least("class", "other_class").alias("src"), F.greatest("class", "other_class").alias("dst")).distinct()


def _within(at: str, size: str, other: str) -> str:
    """A set may have ``at`` shingles that a similar one of ``other`` shingles lacks."""
    return f"{_NUM + _DEN} * {at} <= {_DEN} * {size} - {_NUM} * {other}"


def links(docs: DataFrame, found: DataFrame, text_col: str = "text", bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Verified pairs ``(src, dst)`` of classes. ``found``: :func:`classes` of ``docs``, materialised."""
    named = materialize(found.groupBy("class").agg(F.min_by(F.struct("version", "wide", "fine"), "version").alias("x")).select("class", "x.*"))
    pairs, members = _candidates(named.select("class", F.explode("wide").alias("bucket")), bucket_pairs)
    large = materialize(members.select("class").distinct())
    if crowded := large.count():
        again = sized_join(named, large, "class", "left_semi", rows=crowded)
        pairs = pairs.unionByName(_candidates(again.select("class", F.explode("fine").alias("bucket")), bucket_pairs)[0]).distinct()
    pairs = materialize(pairs)
    wanted = materialize(pairs.select(F.explode(F.array("src", "dst")).alias("class")).distinct().join(named.select("class", "version"), "class"))
    texts = sized_join(docs.select(F.xxhash64(text_col).alias("version"), F.col(text_col).cast("string").alias("text")), wanted, "version")
    sets = materialize(texts.select("class", "text").mapInArrow(gives_back(_sets), "class long, shingles binary").dropDuplicates(["class"]))
    size = sets.agg(F.sum(F.octet_length("shingles").cast("long") + 32)).first()[0] or 0
    linked = _verified(pairs, sets, size)
    if not crowded:
        return linked
    rest = materialize(_apart(members, linked, sets))
    return linked.unionByName(_verified(rest, sets, size))
