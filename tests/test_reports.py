"""A run's report and a business's listings on hand-made rows."""

from spinewright.operators import reports

RUNS = "run_id long, status string, kind string, cluster_keys array<string>"


def _runs(spark):
    return spark.createDataFrame([(1, "complete", "sweep", ["b", "a"]), (2, "running", "change_check", ["zz"]), (3, "stopped", "sweep", [])], RUNS)


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_units_and_hosts_are_always_shown(spark):
    ledger = spark.createDataFrame([(1, "ts_enterprise", 3, 0), (1, "ts_enterprise", 2, 70), (1, "pd_pro", 9, 9)], "run_id long, unit string, units long, micros long")
    got = _rows(reports.requests_by_unit(_runs(spark), ledger), "run_id", "unit", "requests", "free", "micros")
    assert got == [(1, "ts_enterprise", 5, 3, 70), (1, "ts_essentials", 0, 0, 0), (2, "ts_enterprise", 0, 0, 0), (2, "ts_essentials", 0, 0, 0), (3, "ts_enterprise", 0, 0, 0), (3, "ts_essentials", 0, 0, 0)]
    seen = spark.createDataFrame([(7, 1, "social"), (8, 1, "social"), (7, 2, "other")], "attachment_id long, run_id long, host_class string")
    attached = spark.createDataFrame([(7, "attached"), (8, "rejected")], "attachment_id long, status string")
    counts = {(r["run_id"], r["host_class"]): r["n"] for r in reports.host_counts(_runs(spark), seen, attached).collect()}
    assert len(counts) == 18 and {k: n for k, n in counts.items() if n} == {(1, "social"): 1, (2, "other"): 1}


def test_only_ended_runs_have_unsearched_tiles(spark):
    searches = spark.createDataFrame([(1, "t1", "planned", False, None), (1, "t2", "done", True, "novelty"), (2, "t3", "planned", False, None), (3, "t4", "searching", True, "max_depth")], "run_id long, tile_key string, status string, truncated boolean, why string")
    got = _rows(reports.unfinished_tiles(_runs(spark), searches), "run_id", "tile_key", "kind", "why")
    assert got == [(1, "t1", "unsearched", None), (1, "t2", "truncated", "novelty"), (3, "t4", "truncated", "max_depth"), (3, "t4", "unsearched", None)]


def test_places_count_at_their_best_and_clusters_in_order(spark):
    outcomes = spark.createDataFrame([(1, 5, "unmatched", "a"), (1, 5, "attached", "b"), (1, 6, "outside", "a"), (1, 7, "tentative", "a")], "run_id long, place_id long, outcome string, cluster_key string")
    got = _rows(reports.outcome_counts(_runs(spark), outcomes), "run_id", "found", "attached", "tentative", "unmatched")
    assert got == [(1, 2, 1, 1, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    clusters = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "cluster_key string, display_name string, sort_order int")
    got = _rows(reports.outcomes_by_cluster(_runs(spark), outcomes, clusters), "run_id", "place", "cluster_key", "display_name", "found", "unmatched")
    assert got == [(1, 1, "a", "A", 2, 1), (1, 2, "b", "B", 1, 0), (2, 1, "zz", None, 0, 0)]


def test_change_checks_only(spark):
    searches = spark.createDataFrame([(2, "new", 3, None), (2, "both", 1, 2), (2, None, None, None), (2, "saturated", 0, 0), (1, "gone", 0, 9)], "run_id long, verdict string, new_ids long, gone_ids long")
    got = _rows(reports.change_counts(_runs(spark), searches), "run_id", "checked", "unchanged", "with_new", "with_gone", "new_ids", "gone_ids", "changed_tiles")
    assert got == [(2, 3, 0, 2, 1, 4, 2, 3)]


def test_listings_of_a_family(spark):
    firms = spark.createDataFrame([(1, None), (2, 1)], "id long, merged_into long")
    attached = spark.createDataFrame(
        [(1, "a", 1, "attached", 90, None), (2, "b", 2, "attached", 80, 5), (3, "c", 1, "tentative", 70, None), (4, "d", 2, "tentative", 85, None), (5, "e", 1, "rejected", 99, 3)],
        "attachment_id long, place_id string, business_id long, status string, score long, decided_at long",
    )
    seen = spark.createDataFrame([(1, 1, "a", True, "own", 4, 1), (2, 2, "b", False, "none", 9, 1), (3, 2, "b", True, "social", 7, 1), (4, 2, "a", True, "own", 99, 1)], "obs_id long, business_id long, place_id string, had_website boolean, host_class string, observed_at long, run_id long")
    got = _rows(reports.checked_listings(attached, seen, firms), "place", "attachment_id", "id", "host_class")
    # a was seen later, but for another business; tentative ones go by score
    assert got == [(1, 2, 1, "none"), (2, 1, 1, "own"), (3, 4, 1, None), (4, 3, 1, None), (5, 5, 1, None)]
    assert _rows(reports.observed_history(seen, firms), "id", "place", "obs_id") == [(1, 1, 4), (1, 2, 2), (1, 3, 3), (1, 4, 1)]
