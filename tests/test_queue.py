"""The automatic merge queue and its undoing against loops, on long chains, large components and cycles."""

import random

import pytest

from spinewright.operators import queue

PAIRS, IDS, APART = "left_id long, right_id long, score int", "id long", "left_id long, right_id long"


def _one_after_the_other(pairs, chained, apart, least):
    """The automatic queue as a loop over its candidates."""
    root, out = {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for left, right, score in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if score < least:
            continue
        a, b = find(left), find(right)
        if left in chained or right in chained:
            out[left, right] = "skipped_chain"
        elif a == b:
            out[left, right] = "already_one"
        elif any({find(x), find(y)} == {a, b} for x, y in apart):
            out[left, right] = "skipped_distinct"
        else:
            out[left, right] = "merged"
            root[max(a, b)] = min(a, b)
    return out, find


def _same(spark, pairs, chained, apart, **options):
    want, find = _one_after_the_other(pairs, chained, apart, 95)
    outcomes, roots = queue.auto_merged(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame([(i,) for i in chained], IDS), spark.createDataFrame(apart, APART), **options)
    rows = outcomes.collect()
    assert len(rows) == len(want) and {(x["left_id"], x["right_id"]): x["outcome"] for x in rows} == want
    got = {x["id"]: x["root"] for x in roots.collect()}
    assert got == {i: find(i) for pair, kind in want.items() if kind != "skipped_chain" for i in pair}
    return want


@pytest.mark.parametrize(("seed", "task_edges"), [(1, 1000), (2, 1000), (3, 8), (4, 20)])
def test_auto_merge_is_the_queue(spark, seed, task_edges):
    # with few candidates a task, the components are decided in ranges of turns
    r = random.Random(seed)
    pairs = [(a, b, r.randint(90, 99)) for a, b in {tuple(sorted(r.sample(range(40), 2))) for _ in range(70)}]
    pairs += [(100, 101, 99), (101, 102, 97), (100, 102, 98), (102, 103, 94)]
    chained, apart = set(r.sample(range(40), 3)), [tuple(sorted(r.sample(range(40), 2))) for _ in range(60)]
    assert set(_same(spark, pairs, chained, apart, task_edges=task_edges).values()) == {"merged", "already_one", "skipped_chain", "skipped_distinct"}


def test_rulings_follow_clusters(spark):
    # 1-2 and 3-4 merge first; 1 and 3 are ruled apart, so 2-4 is skipped; 5 joins 3's side and is barred from 2 too
    pairs = [(1, 2, 99), (3, 4, 99), (2, 4, 98), (4, 5, 97), (2, 5, 96), (2, 6, 96), (5, 6, 95)]
    assert _same(spark, pairs, set(), [(1, 3), (1, 3), (3, 1)])[5, 6] == "skipped_distinct"


def test_a_falling_chain_takes_no_rounds(spark, monkeypatch):
    writes = []
    monkeypatch.setattr(queue, "materialize", lambda df, write=queue.materialize: writes.append(1) or write(df))
    # each candidate's score is below the last one's and touches its cluster; a ruling holds the ends apart
    chain = [(i, i + 1, 6000 - i) for i in range(5000)]
    outcomes, roots = queue.auto_merged(spark.createDataFrame(chain, PAIRS), spark.createDataFrame([], IDS), spark.createDataFrame([(0, 5000)], APART))
    n = {x["outcome"]: x["count"] for x in outcomes.groupBy("outcome").count().collect()}
    assert n == {"merged": 4999, "skipped_distinct": 1} and len(writes) <= 4
    assert roots.where("root <> 0").collect() == [(5000, 5000)]


def test_auto_merge_of_nothing_and_of_names(spark):
    pairs, none, ids = (spark.createDataFrame([], s) for s in (PAIRS, APART, IDS))
    outcomes, roots = queue.auto_merged(pairs, ids, none)
    assert outcomes.count() == roots.count() == 0
    pairs = spark.createDataFrame([("b", "c", 99), ("a", "b", 98), ("x", "y", 97)], "left_id string, right_id string, score int")
    outcomes, roots = queue.auto_merged(pairs, spark.createDataFrame([("y",)], "id string"), spark.createDataFrame([], "left_id string, right_id string"))
    assert sorted(tuple(x) for x in roots.collect()) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert sorted(x["outcome"] for x in outcomes.collect()) == ["merged", "merged", "skipped_chain"]


def _restored(spark, businesses, merges, undone):
    b = spark.createDataFrame([(i,) for i in businesses], IDS)
    m = spark.createDataFrame(merges, "merge_id long, winner long, loser long")
    return {x["id"]: x["merged_into"] for x in queue.subtree_restored(b, m, spark.createDataFrame([(u,) for u in undone], "merge_id long")).collect()}


def test_restoring_follows_chains_of_merges(spark):
    m = [(1, 4, 5), (2, 3, 4), (3, 2, 3), (4, 6, 7)]
    assert _restored(spark, range(1, 8), m, []) == {1: None, 2: None, 3: 2, 4: 2, 5: 2, 6: None, 7: 6}
    assert _restored(spark, range(1, 8), m, [3]) == {1: None, 2: None, 3: None, 4: 3, 5: 3, 6: None, 7: 6}
    assert _restored(spark, range(1, 8), m, [2, 4]) == {1: None, 2: None, 3: 2, 4: None, 5: 4, 6: None, 7: None}
    assert _restored(spark, range(1, 3), m[:0], []) == {1: None, 2: None}


def test_a_long_chain_is_restored_in_few_rounds(spark, monkeypatch):
    writes = []
    monkeypatch.setattr(queue, "materialize", lambda df, write=queue.materialize: writes.append(1) or write(df))
    merges = [(i, i - 1, i) for i in range(1, 1001)]
    assert _restored(spark, range(1001), merges, [500]) == {i: None if i in (0, 500) else 0 if i < 500 else 500 for i in range(1001)}
    assert len(writes) <= 13


def test_a_cycle_of_merges_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        _restored(spark, range(1, 6), [(1, 2, 1), (2, 3, 2), (3, 1, 3), (4, 1, 4)], [])
