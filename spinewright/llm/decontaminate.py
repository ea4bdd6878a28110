"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every text becomes an array of word hashes and of hashes of its k-grams; of each ``window - k + 1`` consecutive
k-grams the smallest hash is kept (the first position that attains it). Two texts that share ``window`` words keep at
least one k-gram of them in common, so joining the kept fingerprints finds every such span. Each kept k-gram
carries the words around it, so a hit is extended to both sides in the joined row; where the run reaches the
item's window, its words are hit. Items shorter than the window are one window of their own length and get a
profile of k-grams that is guaranteed to find them.

Null and empty texts have no words and hit nothing; very long texts are searched whole. Of k-grams that tie, the first
is kept, in documents as in items. Rows that repeat an id and a text get one row each. Items without words never occur,
equal items each count, an empty benchmark hits nothing, an empty table gives no rows. Extra columns are ignored, and
kept by :func:`drop_contaminated`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinewright.core import materialize, sized_join
from spinewright.llm.rows import packed

WINDOW = 13
K = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprints up to which the benchmark's side is broadcast (about 250 bytes each); above it, a shuffle join.
BROADCAST_FINGERPRINTS = 200_000


def words(text: str) -> Column:
    """The words of a text with A-Z in lower case; ``lower`` knows more letters, so it serves ASCII texts alone."""
    t = F.coalesce(F.col(text), F.lit(""))
    lower = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once: a lambda's variable is never replaced by its expression."""
    return F.transform(F.array(value), body)[0]


def _hashes(text: str) -> Column:
    """The 64-bit hash of each word."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _kept(hw: Column, k: int, length: int, around: int) -> Column:
    """Structs (fp, pos, before, after) of the winnowed k-grams, with ``around`` word hashes to each side.

    A k-gram is ordered by the upper half of its hash, then by its position, both in one long, so the minimum of a
    window also tells where it is. Equal windows have their minimum at the same offset, whatever comes before them.
    """
    w = length - k + 1
    gram = lambda i: F.xxhash64(*[F.try_element_at(hw, i + j) for j in range(k)])
    upto = lambda n: F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    near = lambda start, size: F.slice(hw, start, size)
    placed = F.transform(upto(F.size(hw) - k + 1), lambda i: gram(i).bitwiseAND(F.lit(-1 << 32)).bitwiseOR(i.cast("long")))

    def context(v: Column) -> Column:
        p = v.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        before = F.reverse(near(F.greatest(p - around, F.lit(1)), F.least(p - 1, F.lit(around))))
        return F.struct(gram(p).alias("fp"), p.alias("pos"), before.alias("before"), near(p + k, F.lit(around)).alias("after"))

    least = lambda g: F.array_distinct(F.transform(upto(F.size(g) - w + 1), lambda i: F.array_min(F.slice(g, i, w))))
    kept = _let(placed, lambda g: F.transform(least(g), context))
    return F.coalesce(F.when(F.size(hw) >= length, kept), F.expr("cast(array() as array<struct<fp:bigint,pos:int,before:array<bigint>,after:array<bigint>>>)"))


def _same(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs > 0, differs - 1).otherwise(F.greatest(F.size(a), F.size(b)))


def profiles(lengths: list[int], window: int = WINDOW, k: int = K) -> list[tuple[int, int, int, int]]:
    """(shortest, longest, k, guaranteed length) of the groups of items that share a set of fingerprints."""
    whole = [(window, 1 << 30, min(k, window), window)] if any(n >= window for n in lengths) else []
    middle = [n for n in lengths if k <= n < window]
    return whole + ([(k, window - 1, k, min(middle))] if middle else []) + [(n, n, n, n) for n in sorted({n for n in lengths if n < min(k, window)})]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one row for each row of ``docs``."""
    return _judged(docs, items, id_col, text_col, item_col, item_text_col, window).drop("version")


def _judged(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """:func:`contamination` with ``version``, the hash of the row's text."""
    bench = materialize(items.select(F.col(item_col).cast("string").alias("item"), _hashes(item_text_col).alias("hw"))).where(F.size("hw") > 0)
    lengths = [r["n"] for r in bench.select(F.least(F.size("hw"), F.lit(window)).alias("n")).distinct().collect()]  # at most ``window`` values
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    zero = F.expr("named_struct('fp', cast(null as bigint), 'pos', 0, 'before', cast(array() as array<bigint>), 'after', cast(array() as array<bigint>))")
    found = None
    for at, (shortest, longest, k, length) in enumerate(profiles(lengths, window)):
        around = window - k
        of = bench.where(F.size("hw").between(shortest, longest))
        prints = materialize(
            of.select("item", F.least(F.size("hw"), F.lit(window)).alias("need"), F.explode(_kept(F.col("hw"), k, length, around)).alias("x"))
            .groupBy(F.col("x.fp").alias("fp"), F.col("x.before").alias("item_before"), F.col("x.after").alias("item_after"), "need").agg(F.collect_set("item").alias("items"))
        )
        # one row for each document besides its fingerprints, so that documents without a hit stay
        listed = lambda hw: F.concat(F.array(zero), _kept(hw, k, length, around)) if at == 0 else _kept(hw, k, length, around)  # noqa: B023, E731
        described = rows.select("doc_id", "version", _let(_hashes("text"), lambda hw: F.struct(F.size(hw).alias("n_words"), listed(hw).alias("kept"))).alias("d"))  # noqa: B023
        spread = described.select("doc_id", "version", "d.n_words", F.explode("d.kept").alias("x")).select("doc_id", "version", "n_words", "x.fp", "x.pos", "x.before", "x.after")
        left, right = _same(F.col("before"), F.col("item_before")), _same(F.col("after"), F.col("item_after"))
        hits = (
            sized_join(spread, prints, "fp", "left", limit=BROADCAST_FINGERPRINTS)
            .withColumns({"left": F.when(F.col("need").isNotNull(), left), "right": F.when(F.col("need").isNotNull(), right)})
            .where((F.col("pos") == 0) | (F.col("left") + F.col("right") + k >= F.col("need")))
            .select("doc_id", "version", "n_words", F.when(F.col("pos") > 0, F.col("pos") - F.col("left")).alias("first"), F.when(F.col("pos") > 0, F.col("pos") + k - 1 + F.col("right")).alias("last"), "items")
        )
        found = hits if found is None else found.unionByName(hits)
    if found is None:  # no item has a word
        found = rows.select("doc_id", "version", F.size(words("text")).alias("n_words"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("array<string>").alias("items"))
    per_doc = found.groupBy("doc_id", "version").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum(F.when(F.col("first").isNull(), 1).otherwise(0)).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("first").isNotNull(), F.struct(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    fold = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["last"] - F.greatest(a["to"], s["first"] - 1))).alias("n"), F.greatest(a["to"], s["last"]).alias("to")),
        lambda a: a["n"],
    )
    out = per_doc.select("doc_id", "version", "n_words", fold.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return out.select("doc_id", "version", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones, whole rows. Rows are told apart by id and text, with or without an id."""
    none, known = F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")
    bad = materialize(_judged(docs, items).where("contaminated").select(none, known, "version").distinct())
    whole = docs.select(packed(docs), none, known, F.xxhash64("text").alias("version"))
    return sized_join(whole, bad, ["none", "id", "version"], "left_anti").select("row.*")
