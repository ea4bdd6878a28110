"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources get shares of a word budget by weight. A source is clamped at ``max_epochs`` times its size; the excess
goes to the others by weight until none is above its clamp. Sorting sources by size over weight makes that one
pass of running sums: the clamped sources are a prefix. A source then takes whole repetitions of all its
documents, and for the rest the documents that come first in a seeded order, the last of them in part, so that a
source takes its target to the word.

The order within a source is the MD5 of seed, id and text. It is cut into cells by its first digits, as many as leave a
cell some ``ROWS_A_CELL`` rows; cell sums find the cell where the budget ends, and only that cell's rows are ordered, equal
ones counted first. So no source, however large, is sorted in one task. Sources are numbered and summed in order by
:func:`_in_order`, which sorts ranges of them side by side once they are many, so their number isn't bound by a task.

A null text has size 0. A null source is a source of its own, last. Rows that repeat an id, or have none, are told apart
by their texts. Rows equal in id and text have one place in the order together; where the budget ends in it, they are
numbered, by partitions and within them, and filled one after the other, so the source still takes its target. Very
long texts count with all their words and are cut only in the number of words taken. An empty table gives no rows. Sources with equal size over weight are
clamped in the order of their names. Extra columns stay out of :func:`mix` and whole in :func:`repeat`, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinewright.core import materialize, sized_join
from spinewright.llm.rows import packed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SEED = "mix-1"
#: Rows of a source's cell, about, and the digits that make cells at least and at most.
ROWS_A_CELL, LEAST_DIGITS, MOST_DIGITS = 20_000, 2, 5
#: Ranges of sources that are sorted side by side, and sources up to which one task orders them (a few longs each).
RANGES, FEW_SOURCES = 64, 100_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _source_key(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(col)), F.lit("~"))  # "s..." sorts before "~"


def _order(id_col: str, text_col: str, seed: str) -> Column:
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))


def _order_by_id(id_col: str, text_col: str, seed: str) -> Column:
    """The order of :func:`repeat`: the MD5 of seed and id, then :func:`_order`; rows without an id lie by the latter alone."""
    by_text = _order(id_col, text_col, seed)
    return F.concat(F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")), by_text), by_text)


def _in_order(df: DataFrame, order: list[Column], sums: dict[str, Column], few: bool = False) -> DataFrame:
    """``df`` with the running totals ``sums`` of all rows before each row in a total order.

    If they are ``few``, one task orders them. Else ranges of the order are sorted apart; the windows without a key run
    over one row a range.
    """
    if few:
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(upto), F.lit(0).cast("long")) for n, c in sums.items()})
    ranged = materialize(df.repartitionByRange(RANGES, *order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = ranged.groupBy("range").agg(*[F.sum(c).alias(f"of_{n}") for n, c in sums.items()])
    offsets = offsets.select("range", *[F.coalesce(F.sum(f"of_{n}").over(before), zero).alias(f"of_{n}") for n in sums])
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumns({n: F.coalesce(F.sum(c).over(within), zero) for n, c in sums.items()})
    return summed.join(F.broadcast(offsets), "range").withColumns({n: F.col(n) + F.col(f"of_{n}") for n in sums}).drop("range", *[f"of_{n}" for n in sums])  # a row a range


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_halves: int = 3, max_epochs: int = 2) -> DataFrame:
    """``source_key, source_size, target, words`` of a table of ``source_key, source_size``.

    The budget is ``budget_halves / 2`` of all sizes. Whole numbers until the last division, so sums have no rounding.
    """
    few = sizes.count() <= FEW_SOURCES
    placed = _in_order(sizes, [F.col("source_key")], {"place": F.lit(1).cast("long")}, few)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    weighed = placed.select("source_key", "source_size", weight.alias("weight"))
    t = _in_order(weighed, [F.col("source_size") / F.col("weight"), F.col("source_key")], {"size_before": F.col("source_size"), "weight_before": F.col("weight")}, few)
    all_size, all_weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    if all_weight is None:
        return t.select("source_key", "source_size", F.lit(None).cast("double").alias("target"), F.lit(None).cast("long").alias("words"))
    # twice what is left for this source and the later ones, and their weight
    left2, weight_left = F.lit(budget_halves * all_size) - 2 * max_epochs * F.col("size_before"), F.lit(all_weight) - F.col("weight_before")
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")  # noqa: E731  a product may exceed a long
    full = wide(F.col("weight"), 10) * wide(left2, 20) >= wide(2 * max_epochs * F.col("source_size"), 20) * wide(weight_left, 16)
    t = materialize(t.withColumns({"left2": left2, "weight_left": weight_left, "full": full}))
    open2, open_weight = (F.lit(x).cast("long") for x in t.where(~F.col("full")).agg(F.max("left2"), F.max("weight_left")).first())
    target = F.when(F.col("full"), (max_epochs * F.col("source_size")).cast("double")).otherwise((F.col("weight") * open2).cast("double") / (2 * open_weight).cast("double"))
    return t.select("source_key", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("words"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget_halves: int = 3, max_epochs: int = 2, seed: str = SEED, order: Callable[[str, str, str], Column] = _order) -> DataFrame:
    """A row for each source: its target, whole repetitions, and the row of the seeded order where the rest ends."""
    rows = docs.select(_source_key(source_col).alias("source_key"), n_words(text_col).alias("size"), order(id_col, text_col, seed).alias("o"))
    # words and rows by the longest cells; a source's own cells are as many as its rows ask for
    fine = materialize(rows.groupBy("source_key", F.substring("o", 1, MOST_DIGITS).alias("cell")).agg(F.sum("size").alias("cell_size"), F.count("*").alias("n")))
    sources = materialize(fine.groupBy("source_key").agg(F.sum("cell_size").alias("source_size"), F.sum("n").alias("n")))
    digits = F.greatest(F.lit(LEAST_DIGITS), F.least(F.lit(MOST_DIGITS), F.ceil(F.log(16.0, F.greatest(F.col("n") / ROWS_A_CELL, F.lit(1.0)))))).cast("int")
    sources = materialize(sources.withColumn("digits", digits))
    cells = sized_join(fine, sources.select("source_key", "digits"), "source_key").groupBy("source_key", F.expr("substring(cell, 1, digits)").alias("cell")).agg(F.sum("cell_size").alias("cell_size"))
    wanted = targets(sources.select("source_key", "source_size"), weights, budget_halves, max_epochs).join(sources.select("source_key", "digits"), "source_key")
    wanted = wanted.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0).cast("long"))).withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size"))
    # the cell where the rest ends: a source has at most 16 ** MOST_DIGITS of them, and only one of 20 billion rows has so many
    upto = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(upto), F.lit(0).cast("long")))
    ends = wanted.where("rest > 0").select("source_key", "rest").join(sums, "source_key").where("before < rest and before + cell_size >= rest").select("source_key", "cell", F.col("before").alias("at"))
    table = materialize(wanted.join(ends, "source_key", "left").select("source_key", "source_size", "target", "whole", "rest", "digits", "cell", "at"))
    last = sized_join(rows, table.where("cell is not null").select("source_key", "digits", "cell", "at", "rest"), "source_key").where("substring(o, 1, digits) = cell")
    places = last.groupBy("source_key", "o", "size", "at", "rest").agg(F.count("*").alias("n"))  # equal rows have one place
    running = Window.partitionBy("source_key").orderBy("o", "size").rowsBetween(Window.unboundedPreceding, 0)
    all_of = F.col("n") * F.col("size")
    over = places.withColumn("total", F.sum(all_of).over(running) + F.col("at")).where("total >= rest")
    edge = over.groupBy("source_key").agg(F.min_by(F.struct("o", "size", "n", (F.col("rest") - F.col("total") + all_of).alias("part")), F.struct("o", "size", "total")).alias("edge"))
    return materialize(table.join(edge, "source_key", "left").select("source_key", "source_size", "target", "whole", F.col("edge.o").alias("edge_o"), F.col("edge.size").alias("edge_size"), F.col("edge.n").alias("edge_n"), F.col("edge.part").alias("edge_part")))


def with_taken(docs: DataFrame, sources: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, order: Callable[[str, str, str], Column] = _order) -> DataFrame:
    """``row`` (the whole row of ``docs``), ``size``, ``source_size``, ``target``, ``whole``, and ``taken``, the words the mix takes of the row."""
    keyed = docs.select(packed(docs), _source_key(source_col).alias("source_key"), n_words(text_col).alias("size"), order(id_col, text_col, seed).alias("o"))
    here, edge = F.struct("o", "size"), F.struct(F.col("edge_o").alias("o"), F.col("edge_size").alias("size"))
    placed = sized_join(keyed, sources, "source_key").withColumn("at_edge", F.coalesce(here == edge, F.lit(False)))
    most_equal = sources.agg(F.max("edge_n")).first()[0] or 1
    if most_equal == 1:
        numbered = placed.withColumn("number", F.lit(0).cast("long"))
    else:
        numbered = placed.where("not at_edge").withColumn("number", F.lit(0).cast("long")).unionByName(_numbered(placed.where("at_edge")))
    filled = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("edge_part") - F.col("number") * F.col("size")))
    extra = F.when(F.col("edge_o").isNull(), 0).when(here < edge, F.col("size")).when(F.col("at_edge"), filled).otherwise(0)
    return numbered.select("row", "size", "source_size", "target", "whole", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Equal rows of each source with their ``number`` from 0: within the partitions they were written in, and those added up."""
    fixed = materialize(rows.withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33).alias("p")
    counts = fixed.groupBy("source_key", part).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_key").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = materialize(counts.select("source_key", "p", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start")))
    within = Window.partitionBy("source_key", "p").orderBy("m")
    return sized_join(fixed.withColumn("p", part), starts, ["source_key", "p"]).withColumn("number", F.col("start") + F.row_number().over(within) - 1).drop("m", "p", "start")


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row."""
    d = docs.select("doc_id", "text", "source")
    return with_taken(d, plan(d)).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def repeat(docs: DataFrame) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, whole; a part of half a text or more counts as one."""
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.col("whole")).cast("int")
    out = with_taken(docs, plan(docs, order=_order_by_id), order=_order_by_id).withColumn("times", times).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
