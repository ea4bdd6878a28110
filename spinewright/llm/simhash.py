"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint is cut into two 32-bit segments. Two fingerprints within two bits agree in at least one segment
up to one bit, so they share one of that segment's 32 one-wildcard variants. The variants are equality-joined
and every pair is verified. Buckets of more than ``BUCKET_PAIRS`` distinct fingerprints would cost pairs by the
square; their members are re-indexed by the one-wildcard variants of the whole fingerprint: texts within two
bits are at most one bit from a common word of 64 bits, and all who name that word are within two bits of each
other, so a star links them. That is exact, holds at most 65 members a word, and needs no pairs.

Nulls and empty texts have fingerprint zero and are linked like any other; very long texts are hashed whole, shingle by
shingle. Repeated rows get one row each. Rows with a null id take part; a component whose ids are all null has a null
``component_id``. A bit set in just half of the shingles is 0. An empty table gives no rows. Extra columns are ignored
by :func:`near_duplicates` and kept by :func:`keep_one`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinewright.core import materialize, sized_join
from spinewright.llm import near_copies
from spinewright.llm.rows import gives_back, packed
from spinewright.operators.graph import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Distinct fingerprints in a bucket up to which pairs are formed and verified directly.
BUCKET_PAIRS = 16
#: Fingerprints a task spreads into their 64 variants.
FINGERPRINTS_A_TASK = 4_000
_CHUNK = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint: a bit is 1 if set in over half of the shingles' XXH64."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and the six white-space characters
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lo, hi = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(lo[at : at + _CHUNK], hi[at : at + _CHUNK], strict=True)], np.uint64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((simhash(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((simhash(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], ["doc_id", "version", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row, ``fp`` as the signed 64-bit long with the fingerprint's bits."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(gives_back(_fingerprints), "doc_id long, fp long")


def links(fps: DataFrame, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Edges ``(src, dst)`` whose components are those of all pairs within two bits. ``fps``: distinct ``fp``, materialised."""
    # few small files would be read by few tasks, each of which makes 64 rows of one
    spread = fps.repartition(fps.count() // FINGERPRINTS_A_TASK + 1, "fp")
    variants = spread.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x")).select(
        "fp",
        F.expr("(shiftrightunsigned(fp, 32 * shiftright(x, 5)) & 4294967295L & ~shiftleft(1L, x & 31)) | shiftleft(cast(x as bigint), 32)").alias("variant"),
    )
    shared = materialize(variants.groupBy("variant").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS
    pairs = shared.where("n = 2").where(near("lo", "hi")).select(F.col("lo").alias("src"), F.col("hi").alias("dst")).distinct()
    crowded = shared.where("n > 2").select("variant", "n")
    if not (keys := crowded.count()):
        return pairs
    members = materialize(sized_join(variants, crowded, "variant", rows=keys))
    few = members.where(F.col("n") <= bucket_pairs).select("variant", "fp")
    verified = few.alias("a").join(few.select("variant", F.col("fp").alias("other")), "variant").where(F.col("fp") < F.col("other")).where(near("fp", "other"))
    words = (
        members.where(F.col("n") > bucket_pairs).select("fp").distinct()
        .select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("x"))
        .select("fp", F.expr("case when x < 64 then fp ^ shiftleft(1L, x) else fp end").alias("word"))
    )
    # at most 65 fingerprints name a word
    stars = words.groupBy("word").agg(F.min("fp").alias("src"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    star_links = stars.select("src", F.explode("all").alias("dst")).where("src <> dst").where(near("src", "dst"))
    return pairs.unionByName(verified.select(F.col("fp").alias("src"), F.col("other").alias("dst"))).unionByName(star_links).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each input row."""
    rows = materialize(fingerprints(docs, id_col, text_col))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    components = materialize(connected_components(links(classes.select("fp"), bucket_pairs)))
    linked = components.join(classes, F.col("node") == F.col("fp")).select("node", "root", "least_id")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_least"))
    named = materialize(linked.join(least, "root").select(F.col("node").alias("fp"), "component_least"))
    of_class = sized_join(classes, named, "fp", "left").select("fp", F.coalesce("component_least", "least_id").alias("component_id"))
    return rows.join(of_class, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component one row stays, whole, the one with the smallest ``doc_id``.

    Links are fingerprints within two bits, and five-word shingle sets with a Jaccard similarity of 0.8 or more
    (:mod:`near_copies`). Rows are told apart by id and text, so a near copy goes also where its id is kept for another
    text. Equal rows count once. Rows without an id come after those with one, in the order of their texts' hashes.
    """
    version = F.xxhash64("text")
    prints = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), version.alias("version"))
    rows = materialize(prints.mapInArrow(gives_back(_versions), "doc_id long, version long, fp long"))
    found = materialize(near_copies.classes(docs))
    fps = materialize(rows.select("fp").distinct())
    of_class = materialize(found.select("version", "class").distinct().join(rows.select("version", "fp").distinct(), "version").groupBy("class").agg(F.min("fp").alias("fp")))
    pairs = materialize(near_copies.links(docs, found))
    n = of_class.count()
    src, dst = (of_class.select(F.col("class").alias(end), F.col("fp").alias(f"{end}_fp")) for end in ("src", "dst"))
    similar = sized_join(sized_join(pairs, src, "src", rows=n), dst, "dst", rows=n).select(F.col("src_fp").alias("src"), F.col("dst_fp").alias("dst")).where("src <> dst")
    roots = materialize(connected_components(links(fps).unionByName(similar)))
    # keys settle which rows stay, so texts move in one join at most
    texts = rows.groupBy(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "version", "fp").agg(F.count("*").alias("n"))
    rooted = sized_join(texts, roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    first = rooted.groupBy(F.coalesce("root", "fp")).agg(F.min(F.struct("none", "id", "version", "n")).alias("x"))
    kept = materialize(first.select("x.*"))
    whole = docs.select(packed(docs), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), version.alias("version"))
    stays = sized_join(whole, kept, ["none", "id", "version"])
    again = stays.where("n > 1").dropDuplicates(["none", "id", "version"])  # only rows that repeat an id and a text
    return stays.where("n = 1").select("row").unionByName(again.select("row")).select("row.*")
