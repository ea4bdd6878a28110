"""The automatic merge queue: candidates decided one after the other by falling score, and undone by whole subtrees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinewright.core import materialize
from spinewright.operators.graph import connected_components

#: Candidates and rulings of a component that one task decides; larger components are decided in turns of so many.
TASK_EDGES = 200_000
MERGED, ONE, CHAIN, DISTINCT = "merged", "already_one", "skipped_chain", "skipped_distinct"


class Clusters:
    """Union-find over ids whose least member names a cluster, with the clusters that must stay apart from it."""

    def __init__(self) -> None:
        self.parent: dict[object, object] = {}
        self.least: dict[object, object] = {}
        self.apart: dict[object, set] = {}

    def find(self, x: object) -> object:
        parent = self.parent
        if x not in parent:
            parent[x] = self.least[x] = x
            self.apart[x] = set()
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def rule_apart(self, x: object, y: object) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.apart[x].add(y)
            self.apart[y].add(x)

    def decide(self, x: object, y: object) -> str:
        """Merge the clusters of ``x`` and ``y`` unless they are one or must stay apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return ONE
        if y in self.apart[x]:
            return DISTINCT
        if len(self.apart[x]) < len(self.apart[y]):
            x, y = y, x
        for z in self.apart.pop(y):  # the side with fewer rulings moves
            self.apart[z].discard(y)
            self.apart[z].add(x)
            self.apart[x].add(z)
        self.parent[y] = x
        self.least[x] = min(self.least[x], self.least.pop(y))
        return MERGED


def _decided(rows: DataFrame) -> DataFrame:
    """``left_id, right_id, outcome`` of candidates, and with a null ``outcome`` ``left_id, root`` of the clusters met.

    ``rows``: ``part, ruled, score, left_id, right_id, a, b``, the last two being the clusters to decide on. A part is
    walked by one task that holds that part only: its rulings first, then its candidates in turn, streamed from the
    sorted shuffle."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, clusters = None, Clusters()

        def roots() -> pd.DataFrame:
            ids = list(clusters.parent)
            least = [clusters.least[clusters.find(x)] for x in ids]
            return pd.DataFrame({"left_id": ids, "right_id": None, "outcome": None, "root": least}, columns=names)

        for frame in frames:
            out: list[tuple] = []
            for p, ruled, left, right, a, b in zip(*[frame[c] for c in ("part", "ruled", "left_id", "right_id", "a", "b")], strict=True):
                if p != part:
                    if clusters.parent:
                        yield roots()
                    part, clusters = p, Clusters()
                if ruled:
                    clusters.rule_apart(a, b)
                else:
                    out.append((left, right, clusters.decide(a, b), None))
            if out:
                yield pd.DataFrame(out, columns=names)
        if clusters.parent:
            yield roots()

    names, kind = ["left_id", "right_id", "outcome", "root"], rows.schema["a"].dataType.simpleString()
    dealt = rows.repartition("part").sortWithinPartitions(F.col("part"), F.col("ruled").desc(), F.col("score").desc(), "left_id", "right_id")
    return dealt.select("part", "ruled", "left_id", "right_id", "a", "b").mapInPandas(walk, f"left_id {kind}, right_id {kind}, outcome string, root {kind}")


def auto_merged(pairs: DataFrame, chained: DataFrame, apart: DataFrame, least: int = 95, task_edges: int = TASK_EDGES) -> tuple[DataFrame, DataFrame]:
    """The automatic queue, as if run one candidate after the other by falling score and ids.

    ``pairs``: ``left_id, right_id, score``, ids of one type; ``chained``: ``id``; ``apart``: ``left_id, right_id`` ruled
    distinct. Gives ``left_id, right_id, outcome`` (merged, already_one, skipped_chain, skipped_distinct) of every
    candidate, and ``id, root`` of the ids of those that aren't chains', the root being the smallest id of the cluster.

    Only candidates of one connected component bear on each other, so components are decided side by side, each by one
    pass over its candidates in turn (:class:`Clusters`), however long the queue is. A component of more than
    ``task_edges`` candidates and rulings isn't given to one task: its candidates are cut into ranges of turns of about
    that many; each range is a pass over the clusters that the ranges before have left.
    """
    flag = chained.select("id").distinct().withColumn("flag", F.lit(True))
    side = lambda df, c, name: df.join(flag.select(F.col("id").alias(c), F.col("flag").alias(name)), c, "left")
    queue = side(side(pairs.where(F.col("score") >= least).select("left_id", "right_id", "score"), "left_id", "lf"), "right_id", "rf")
    queue = materialize(queue.select("left_id", "right_id", "score", (F.col("lf").isNotNull() | F.col("rf").isNotNull()).alias("chain")))
    edges = queue.where("not chain").select("left_id", "right_id", "score")
    whole = materialize(connected_components(edges, "left_id", "right_id"))
    of = lambda c, name: whole.select(F.col("node").alias(c), F.col("root").alias(name))
    rulings = apart.select("left_id", "right_id").distinct().join(of("left_id", "part"), "left_id").join(of("right_id", "q"), "right_id")
    rows = _rows(edges.join(of("left_id", "part"), "left_id"), rulings.where("part = q"), "left_id", "right_id")
    sized = materialize(rows.groupBy("part").agg(F.count("*").alias("n")))
    large = sized.where(F.col("n") > task_edges).select("part")
    if large.isEmpty():
        return _outcomes(queue, [materialize(_decided(rows))])
    rows = materialize(rows)
    small = materialize(_decided(rows.join(large, "part", "left_anti")))
    return _outcomes(queue, [small, *_in_ranges(rows.join(large, "part", "left_semi"), task_edges)])


def _rows(candidates: DataFrame, rulings: DataFrame, a: str, b: str) -> DataFrame:
    """What :func:`_decided` walks, of candidates and rulings between the clusters ``a`` and ``b``."""
    no_score = F.lit(None).cast(candidates.schema["score"].dataType)
    turns = candidates.select("part", F.lit(False).alias("ruled"), "score", "left_id", "right_id", F.col(a).alias("a"), F.col(b).alias("b"))
    return turns.unionByName(rulings.select("part", F.lit(True).alias("ruled"), no_score.alias("score"), F.col(a).alias("left_id"), F.col(b).alias("right_id"), F.col(a).alias("a"), F.col(b).alias("b")))


def _in_ranges(rows: DataFrame, task_edges: int) -> Iterator[DataFrame]:
    """Large components, decided in ranges of turns one after the other."""
    candidates, rulings = rows.where("not ruled"), rows.where("ruled").select("part", "left_id", "right_id")
    ranges = candidates.count() // task_edges + 1
    ranged = candidates.repartitionByRange(ranges, F.col("score").desc(), F.col("left_id"), F.col("right_id"))
    ranged = materialize(ranged.select("part", "score", "left_id", "right_id", F.spark_partition_id().alias("range")))
    roots = materialize(candidates.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct().withColumn("root", F.col("id")))
    for r in range(ranges):
        named = lambda c, name, roots=roots: roots.select(F.col("id").alias(c), F.col("root").alias(name))
        here = materialize(ranged.where(F.col("range") == r).join(named("left_id", "p"), "left_id").join(named("right_id", "q"), "right_id"))
        # rulings between clusters that this range's candidates touch, once a pair of clusters
        met = lambda c, here=here: here.select(F.explode(F.array("p", "q")).alias(c)).distinct()
        ruled = rulings.join(named("left_id", "p"), "left_id").join(named("right_id", "q"), "right_id").where("p <> q")
        ruled = ruled.join(met("p"), "p", "left_semi").join(met("q"), "q", "left_semi").select("part", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
        out = materialize(_decided(_rows(here, ruled, "p", "q")))
        yield out.where("outcome is not null")
        moved = out.where("outcome is null").select(F.col("left_id").alias("root"), F.col("root").alias("new"))
        roots = materialize(roots.join(moved, "root", "left").select("id", F.coalesce("new", "root").alias("root")))
    nothing = F.lit(None)
    yield roots.select(F.col("id").alias("left_id"), nothing.cast(roots.schema["id"].dataType).alias("right_id"), nothing.cast("string").alias("outcome"), "root")


def _outcomes(queue: DataFrame, decided: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    everything = reduce(DataFrame.unionByName, decided)
    chains = queue.where("chain").select("left_id", "right_id", F.lit(CHAIN).alias("outcome"))
    out = everything.where("outcome is not null").select("left_id", "right_id", "outcome").unionByName(chains)
    return out, everything.where("outcome is null").select(F.col("left_id").alias("id"), "root")


def subtree_restored(businesses: DataFrame, merges: DataFrame, undone: DataFrame) -> DataFrame:
    """``id, merged_into`` after undoing merges (``merge_id``) that :func:`~spinewright.operators.merge.undoable` allows: the loser
    is live again and all that had been merged into it before points at it once more.

    ``merges``: ``merge_id, winner, loser`` of live merges, a loser once. Chains of merges are followed by pointer
    doubling over the losers alone: a round halves what is left of every chain, and chains that have come to their end
    leave the rounds. Merges that form a cycle never end; they raise an error once the rounds exceed what any chain of
    so many merges needs."""
    up = materialize(merges.join(undone.select("merge_id"), "merge_id", "left_anti").select(F.col("loser").alias("id"), F.col("winner").alias("up")))
    rounds, ended = up.count().bit_length() + 2, []
    while not up.isEmpty():
        if len(ended) > rounds:
            raise ValueError(f"merges form a cycle: {[r['id'] for r in up.orderBy('id').limit(5).collect()]} come to no end")
        known = up.select(F.col("id").alias("via"), F.col("up").alias("next"))
        if ended:  # those that have ended are pointed at too
            known = known.unionByName(reduce(DataFrame.unionByName, ended).select(F.col("id").alias("via"), F.col("up").alias("next")))
        step = materialize(up.join(known, F.col("up") == F.col("via"), "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        ended.append(step.where("not moved").select("id", "up"))
        up = step.where("moved").select("id", "up")
    if not ended:
        return businesses.select("id", F.lit(None).cast(merges.schema["winner"].dataType).alias("merged_into"))
    return businesses.select("id").join(reduce(DataFrame.unionByName, ended), "id", "left").select("id", F.col("up").alias("merged_into"))
