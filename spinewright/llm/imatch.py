"""I-Match fingerprints: hashes of a text's terms that belong to randomised subsets of a lexicon.

The lexicon is a band of inverse document frequency: terms of at least ``LEAST_POWER`` and at most ``MOST_POWER`` as
powers of the number of texts (so the band moves with the corpus), rarer ones left out as far as needed to keep it
within ``LEXICON_TERMS``, which bounds what is broadcast to 8 bytes a term. Terms are words, A-Z as a-z; frequencies
count the texts that hold a term, over all whole texts, pre-aggregated by batch.

A text's fingerprint starts with the hash of all its distinct lexicon terms, sorted. ``SEEDS`` random orders of the
lexicon follow, each with nested subsets whose sizes suit the text: a level ``l`` keeps a share ``2**-l`` of the
lexicon, and the text's ``LEVELS`` levels start with the first that leaves it about one term or less. So texts of a
similar number of terms have levels in common, where the share of equal hashes tells how many terms they share.
:func:`likeness` is that share, over the subsets in which either text has a term; equal fingerprints have likeness 1.

Edits take the rows in a total order of id and text. Rows are dealt to ranges of that order, whose borders come from a
narrow pass, and the first row of a range also goes to the range before as its last row's neighbour (that of the
first range to the last). A range is sorted and streamed with one row looked ahead, so no window holds rows and the
whole table is shuffled once.

Null texts and empty ones have no terms: a fingerprint of their own, equal to each other's. A text without lexicon terms
is fingerprinted by all its terms, apart from the others. Very long texts count whole. Rows that repeat an id follow each
other by their texts' hashes, equal rows in any order, which changes nothing; null ids come first. A single row is its
own neighbour. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spinewright.core import materialize

#: The band: document frequencies from ``n ** LEAST_POWER`` to ``n ** MOST_POWER``, but two texts at least.
LEAST_POWER, MOST_POWER = 0.1, 0.7
#: Terms that the lexicon holds at most, the more frequent ones of the band; 16 MB.
LEXICON_TERMS = 1 << 21
SEEDS, LEVELS = 24, 3
HASH_SEED = 42
#: Hexadecimal digits of a subset's hash, and what stands for a subset without terms.
DIGITS = 6
NONE = "0" * DIGITS
ROWS_A_RANGE, LEAST_RANGES, MOST_RANGES = 2_000, 12, 16_384
#: Terms whose hashes a task remembers.
_CACHE = 300_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# odd factors that put the lexicon in random orders
_FACTORS = np.array([xxhash.xxh64_intdigest(b"order", i) | 1 for i in range(SEEDS)], np.uint64)
_ORDERS = np.arange(SEEDS)
_HALF = np.uint64(32)


class Terms:
    """Sorted hashes of a text's distinct terms; those of common terms are remembered."""

    def __init__(self) -> None:
        self._known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        if len(self._known) > _CACHE:
            self._known.clear()
        known, out = self._known, []
        for word in set(text.encode().translate(_LOWER).split()):
            h = known.get(word)
            if h is None:
                h = known[word] = xxhash.xxh64_intdigest(word, HASH_SEED)
            out.append(h)
        return np.sort(np.fromiter(out, np.uint64, len(out)))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, df``: how many texts hold a term, by its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            held = [terms(x) for x in batch[0].to_pylist() if x]
            if held:
                term, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "df"])

    return docs.select(text_col).mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", least_power: float = LEAST_POWER, most_power: float = MOST_POWER, most_terms: int = LEXICON_TERMS) -> DataFrame:
    """``term, df`` of the band, at most ``most_terms`` rows."""
    n = docs.count()
    least, most = max(2.0, n**least_power), max(2.0, n**most_power)
    band = materialize(document_frequencies(docs, text_col).where(F.col("df").between(least, most)))
    step = F.floor(16 * F.log2("df")).alias("step")
    # at most 16 steps a doubling, so some 1,000 rows
    steps = sorted(band.groupBy(step).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"])
    total, lowest = 0, None
    for r in steps:
        total += r["n"]
        if total > most_terms:
            break
        lowest = r["step"]
    return band if total <= most_terms else band.where(step >= F.lit(lowest) if lowest is not None else F.lit(False))


def _signatures(terms: np.ndarray, level: int) -> str:
    """A hash for each level from ``level`` on and each order: of the sorted terms in its subset, or zeros for none."""
    with np.errstate(over="ignore"):
        mixed = terms[None, :] * _FACTORS[:, None]
        mixed ^= mixed >> _HALF
        mixed *= _FACTORS[:, None]
    # the first level's subsets hold those of the next
    order, at = np.nonzero(mixed < np.uint64((1 << 64) >> level)) if level else np.indices(mixed.shape).reshape(2, -1)
    rank = mixed[order, at]
    out = []
    for deeper in range(level, level + LEVELS):
        if deeper > level:
            inside = rank < np.uint64((1 << 64) >> deeper)
            order, at, rank = order[inside], at[inside], rank[inside]
        held, stops = terms[at].tobytes(), (8 * np.searchsorted(order, _ORDERS, side="right")).tolist()
        for start, stop in zip([0, *stops], stops, strict=False):
            out.append(f"{xxhash.xxh32_intdigest(held[start:stop], HASH_SEED) >> 8 | 1:0{DIGITS}x}" if stop > start else NONE)
    return "".join(out)


def fingerprint(terms: np.ndarray, lexicon_terms: np.ndarray) -> str:
    """Kind (``l`` lexicon terms, ``a`` all terms, ``e`` no terms), level of two digits, the hash of all terms, and the
    subsets' hashes from that level on."""
    kind, kept = "l", terms
    if len(terms) and len(lexicon_terms):
        at = np.minimum(np.searchsorted(lexicon_terms, terms), len(lexicon_terms) - 1)
        kept = terms[lexicon_terms[at] == terms]
    elif len(terms):
        kept = terms[:0]
    if not len(kept):
        kind, kept = ("a" if len(terms) else "e"), terms
    level = max(0, (len(kept) - 1).bit_length()) if len(kept) else 0
    whole = xxhash.xxh64_hexdigest(kept.tobytes(), HASH_SEED)
    return f"{kind}{level:02d}{whole}" + (_signatures(kept, level) if len(kept) else "")


def likeness(one: str, other: str) -> float:
    """The share of equal hashes, 0 to 1, in the subsets of a common level that hold a term of either text."""
    if one == other:
        return 1.0
    if one[0] != other[0] or one[0] == "e":
        return 0.0
    a, b = int(one[1:3]), int(other[1:3])
    if abs(a - b) >= LEVELS:
        return 0.0
    x, y = ([f[i : i + DIGITS] for i in range(19, len(f), DIGITS)] for f in (one, other))
    same = either = 0
    for level in range(max(a, b), min(a, b) + LEVELS):
        p, q = x[(level - a) * SEEDS : (level - a + 1) * SEEDS], y[(level - b) * SEEDS : (level - b + 1) * SEEDS]
        none = sum(g == h == NONE for g, h in zip(p, q, strict=True))
        either += SEEDS - none
        same += sum(map(str.__eq__, p, q)) - none
    return same / either if either else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _order(id_col: Column, text: Column) -> Column:
    return F.struct(id_col.alias("i"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("m"))


def in_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, at, guest``: partitions that are ranges of the rows' order, sorted, each followed by the first row
    of the next as a guest. ``at`` numbers the ranges."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _order(F.col(id_col), text).alias("o"))
    ranges = max(LEAST_RANGES, min(MOST_RANGES, docs.count() // ROWS_A_RANGE))
    firsts = rows.select("o").repartitionByRange(ranges, "o").groupBy(F.spark_partition_id()).agg(F.min("o").alias("o"))
    borders = [r["o"] for r in firsts.orderBy("o").collect()]  # a row a range
    if not borders:
        return rows.select("doc_id", "text", F.lit(0).alias("at"), F.lit(False).alias("guest"))
    kind = rows.schema["o"].dataType
    table = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kind.fields, strict=True)]) for b in borders])
    # the last border that isn't behind the row, by halving
    steps = [1 << k for k in reversed(range(len(borders).bit_length()))]
    halved = lambda at, step: F.when((at + step < len(borders)) & (F.get(table, at + step) <= F.col("o")), at + step).otherwise(at)
    placed = rows.withColumn("at", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halved))
    is_first = F.get(table, F.col("at")) == F.col("o")
    before = F.pmod(F.col("at") - 1, F.lit(len(borders)))
    own = F.struct(F.col("at"), F.lit(False).alias("guest"))
    dealt = placed.withColumn("x", F.explode(F.when(is_first, F.array(own, F.struct(before.alias("at"), F.lit(True).alias("guest")))).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "o", "x.at", "x.guest")
    return dealt.repartition(len(borders), "at").sortWithinPartitions("at", "guest", "o").select("doc_id", "text", "at", "guest")


def _compared(rows: Iterator[tuple], lexicon_terms: np.ndarray) -> Iterator[tuple]:
    """Rows of the result from sorted rows ``doc_id, text, at, guest``: each that has a successor in its range."""
    terms, last = Terms(), None
    for doc_id, text, at, guest in rows:
        own = fingerprint(terms(text), lexicon_terms)
        if last is not None and last[2] == at:
            changed = edited(last[1], text)
            other = last[3] if changed == last[1] else fingerprint(terms(changed), lexicon_terms)
            digest = hashlib.sha256(changed.encode()).hexdigest()
            yield last[0], len(last[1]), digest, last[3], other, likeness(last[3], other), likeness(last[3], own)
        last = None if guest else (doc_id, text, at, own)


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **band: float) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row."""
    spark = docs.sparkSession
    narrow = docs.select(id_col, text_col)
    terms = np.sort(lexicon(narrow, text_col, **band).select("term").toArrow()["term"].to_numpy().view(np.uint64))
    shared: Broadcast = spark.sparkContext.broadcast(terms)  # LEXICON_TERMS at most
    rows = in_ranges(narrow, id_col, text_col)
    names = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    arrow = None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal arrow

        def stream() -> Iterator[tuple]:
            nonlocal arrow
            for batch in batches:
                arrow = batch.schema.field("doc_id").type
                yield from zip(*[batch[c].to_pylist() for c in ("doc_id", "text", "at", "guest")], strict=True)

        out: list[tuple] = []
        for row in _compared(stream(), shared.value):
            out.append(row)
            if len(out) == 1000:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    def _batch(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        types = (id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

    return rows.mapInArrow(work, schema)
