"""Listing operators on hand-checked values, nulls and empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from spinewright.operators import listings
from tests.test_operators import one

PROBE = "idx long, name_norm string, phone string, postal string, street_num string, lat double, lng double, sab boolean"
BUSINESS = "id long, name_norm string, phone string, blockable boolean, postal string, street_num string, lat double, lng double, city string"


def test_candidates_by_arm(spark):
    b = [
        (1, "zzz", "+1", True, None, None, None, None, None), (2, "zzz", "+1", False, None, None, None, None, None), (3, "yyy", None, False, "78501", "5", None, None, None), (4, "rio grande roofing", None, False, "78501", None, None, None, "mcallen"),
        (5, None, None, False, None, None, 26.001, -98.001, None), (6, "xxx", None, False, None, None, 26.002, -98.0, None), (7, "rio grande roofs", None, False, "99999", None, None, None, "McAllen"), *((100 + i, "copy", "+9", True, "1", "1", 30.0, -90.0, "x") for i in range(40)),
    ]
    p = [(1, "rio grande roofing", "+1", "78501", "5", 26.0, -98.0, False), (2, "rio grande roofing", None, "78501", "5", 26.0, -98.0, True), (3, None, None, None, None, None, None, False), (4, None, "+9", None, None, None, None, False)]
    probes, businesses = spark.createDataFrame(p, PROBE), spark.createDataFrame(b, BUSINESS)
    got = listings.probe_candidates(probes, businesses, "mcallen").collect()
    by = {i: {r["id"] for r in got if r["idx"] == i} for i in (1, 2, 3, 4)}
    assert by == {1: {1, 3, 4, 5}, 2: {4, 7}, 3: set(), 4: set(range(100, 110))}
    assert {(r["idx"], r["id"]): r["name_similarity"] for r in got}[1, 4] == 1.0 and len(got) == len({(r["idx"], r["id"]) for r in got})
    assert {r["id"] for r in listings.probe_candidates(probes, businesses).where("idx = 2").collect()} == set()
    assert listings.probe_candidates(probes.limit(0), businesses, "mcallen").count() == listings.probe_candidates(probes, businesses.limit(0), "mcallen").count() == 0


def test_tile_changes(spark):
    stored = [("both", "a"), ("both", "b"), ("same", "a"), ("full", "a"), ("pages", "a"), ("gone", "a"), ("first", "a")]
    seen = [("both", "a"), ("both", "c"), ("same", "a"), ("same", "a"), ("full", "z"), ("new", "n"), ("first", "f"), ("first", "a")]
    made = [("both", 2, 1, True), ("same", 1, None, True), ("full", 60, 1, True), ("pages", 40, 3, False), ("gone", 0, 1, True), ("new", 1, 1, True), ("first", 2, 1, False)]
    rows = listings.tile_changes(spark.createDataFrame(stored, "tile string, member string"), spark.createDataFrame(seen, "tile string, member string"), spark.createDataFrame(made, "tile string, results int, pages int, checked boolean"))
    assert {tuple(r) for r in rows.collect()} == {("both", "both", 1, 1), ("same", "unchanged", 0, 0), ("full", "saturated", 1, 0), ("pages", "saturated", 0, 0), ("gone", "gone", 0, 1), ("new", "new", 1, 0), ("first", "baseline", 2, 0)}


@pytest.mark.parametrize(("features", "refused"), [
    ('{"name":45,"sab":1,"signals":["name","phone"],"rule":"over_25km"}', None), ("{}", None), ('{"signals":[]}', None), ('{"name":4.5}', "name"), ('{"zip":1,"title":2}', "title"), ('{"city":2}', "city"), ('{"rule":null}', "rule"),
    ("[1]", "features"), (None, "features"), ('{"signals":["other"]}', "signals"), ('{"similarity":0.5}', None),
])
def test_stored_features(spark, features, refused):
    assert one(spark, listings.refused_feature(F.col("f"), ["similarity"]), f=features) == refused


def test_geocoded_county(spark):
    def answer(state="48", **change):
        match = {"matchedAddress": "1 MAIN", "coordinates": {"x": -98.2, "y": 26.2}, "geographies": {"Counties": [{"GEOID": "48215", "NAME": "Hidalgo", "STATE": state}]}, **change}
        return json.dumps({"result": {"addressMatches": [match]}})

    got = lambda text: one(spark, listings.geocoded_county(F.col("t")), t=text)
    good = got(answer())
    assert (good["lat"], good["lng"], good["county_fips"], good["failure_reason"]) == (26.2, -98.2, "48215", None)
    cases = [(None, "unreachable"), ("<html>", "bad_shape"), ('{"result": {}}', "bad_shape"), ('{"result": {"addressMatches": []}}', "no_match"), (answer(geographies={"Counties": []}), "bad_shape"), (answer(coordinates={"x": None, "y": 1}), "bad_shape"), (answer("35"), "not_texas")]
    for text, reason in cases:
        assert (got(text)["failure_reason"], got(text)["lat"]) == (reason, None), text


def test_tile_keys(spark):
    got = one(spark, listings.tile_parts(F.col("k")), k="city:a/b|cafe|r013")
    assert tuple(got) == ("city", "a/b", "cafe", "r013")
    assert one(spark, listings.tile_parts(F.col("k")), k="nonsense") is None


def test_closing_adds_nothing_twice(spark):
    runs, s = spark.createDataFrame([(1,), (2,)], "run_id long"), "run_id long, request_id string, micros long"
    searches = spark.createDataFrame([(1, "a", 5), (1, None, 7), (1, "b", 9), (3, "c", 1)], s)
    ledger = spark.createDataFrame([("a", 1, 4), ("z", 3, 2)], "request_id string, run_id long, micros long")
    after, cost = listings.closed_out(runs, searches, ledger)
    assert {tuple(r) for r in after.collect()} == {("a", 1, 4), ("z", 3, 2), ("b", 1, 9)} and {tuple(r) for r in cost.collect()} == {(1, 13), (2, 0)}
    assert {tuple(r) for r in listings.closed_out(runs, searches, after)[0].collect()} == {tuple(r) for r in after.collect()}
