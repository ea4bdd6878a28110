"""JSON records, lists and maps, and the functions for spark.sql, on odd values."""

import pytest
from pyspark.sql import functions as F

from spinewright.functions import keys, records, sql
from spinewright.operators import ingest, screens


def test_types_of_json(spark):
    texts = {'{"a":1}': "object", "[]": "array", '"x"': "string", "1": "number", "1.5": "number", "1e300": "number", "true": "boolean", "null": "null", "nope{": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", records.json_type(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in rows} == texts


def test_fields_of_objects(spark):
    df = spark.createDataFrame([(1, '{"a": "x", "b": {"c": [1]}, "d": null, "e": 2.5}'), (2, "[1]"), (3, None), (4, "{}"), (5, "bad")], "id long, j string")
    got = sorted(tuple(r) for r in records.each_field(df, "j", ["id"]).collect())
    assert got == [(1, "a", "x", "string"), (1, "b", '{"c":[1]}', "object"), (1, "d", None, "null"), (1, "e", "2.5", "number")]


def test_record_sets_are_strict_unless_told(spark):
    df = spark.createDataFrame([(1, '[{"a": 1, "b": "x"}, {"b": "y"}]'), (2, None), (3, "[]")], "id long, j string")
    assert sorted(map(tuple, records.record_set(df, "j", "a int, b string", ["id"]).collect()), key=str) == [(1, 1, "x"), (1, None, "y")]
    bad = spark.createDataFrame([(1, '[{"a": "no"}]')], "id long, j string")
    assert records.record_set(bad, "j", "a int", ["id"], strict=False).collect()[0]["a"] is None
    with pytest.raises(Exception, match="MALFORMED|CANNOT_PARSE"):
        records.record_set(bad, "j", "a int", ["id"]).collect()


def test_maps_and_lists(spark):
    df = spark.sql("select map('a', 1, 'b', 2) x, map('b', 5, 'c', cast(null as int)) y, cast(null as map<string,int>) z, array('q', ' ', null, '') l, cast(null as array<string>) n")
    r = df.select(records.added(F.col("x"), F.col("y")).alias("add"), records.overlaid(F.col("x"), F.col("y")).alias("over"), records.added(F.col("x"), F.col("z")).alias("same"), records.present(F.col("l")).alias("l"), records.present(F.col("n")).alias("n")).first()
    assert (r["add"], r["over"], r["same"], r["l"], r["n"]) == ({"a": 1, "b": 7, "c": 0}, {"a": 1, "b": 5, "c": None}, {"a": 1, "b": 2}, ["q"], [])
    with pytest.raises(Exception, match="twice"):
        spark.sql("select array('a', 'b', 'a') l").select(records.only_once(F.col("l"))).collect()


def test_sql_functions_are_the_columns(spark):
    sql.register(spark)
    df = spark.createDataFrame([(26.1, -98.2, 26.2, -98.1, "Café|x"), (None, 1.0, 2.0, 3.0, ""), (0.0, 0.0, 0.0, 180.0, "r0")], "a double, b double, c double, d double, k string")
    df.createOrReplaceTempView("sql_rows")
    got = spark.sql("select distance_m(a, b, c, d) m, fnv1a_32(k) h from sql_rows").collect()
    want = df.select(keys.distance_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m"), keys.fnv1a32(F.col("k")).alias("h")).collect()
    assert [r["h"] for r in got] == [r["h"] for r in want] and [r["m"] for r in got] == pytest.approx([r["m"] for r in want])


@pytest.mark.parametrize(("features", "ok"), [
    ('{"name": 40, "nameSim": 0.5}', True), ("{}", True), ('{"distanceM": null}', True), ('{"signals": []}', True), ('{"sab": 0, "city": 1}', True), ('{"rule": "over_25km"}', True),
    (None, False), ("[]", False), ("x", False), ('{"name": "40"}', False), ('{"distanceM": "3"}', False), ('{"signals": "name"}', False), ('{"signals": ["name", 1]}', False), ('{"signals": ["email"]}', False),
    ('{"rule": "other"}', False), ('{"rule": 1}', False), ('{"sab": 2}', False), ('{"sab": "1"}', False), ('{"address_line": "12 Main"}', False),
])
def test_features_hold_no_listing_data(spark, features, ok):
    sql.register(spark)
    assert spark.createDataFrame([(features,)], "f string").selectExpr("features_ok(f) ok").first()["ok"] is ok


@pytest.mark.parametrize(("status", "searches", "message"), [
    ("done", "[]", "not active"), ("running", "{}", "must be a json array"), ("running", '[{"kind": "enterprise"}]', "needs a tileKey"), ("queued", '[{"tileKey": "t", "kind": "ids_only"}]', "does not match"),
])
def test_planned_searches_are_refused(spark, status, searches, message):
    sql.register(spark)
    with pytest.raises(Exception, match=message):
        spark.sql("select * from plan_run_searches('r', 'sweep', :s, :j)", args={"s": status, "j": searches}).collect()


def test_searches_are_planned_once(spark):
    sql.register(spark)
    plan = lambda kind, name: spark.sql("select * from plan_run_searches('r', :k, 'queued', :j)", args={"k": kind, "j": f'[{{"tileKey": "t", "kind": "{name}", "depth": 2}}]'}).collect()
    assert plan("sweep", "enterprise") == plan("sweep", "enterprise") and plan("change_check", "ids_only")[0]["depth"] == 2


def test_public_keys_are_never_shared(spark):
    rows = spark.range(500).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("name"))
    got = {r["name"]: r["key"] for r in ingest.public_keys(rows, "name", size=2).collect()}  # of 1,024 keys
    assert len(set(got.values())) == len(got) == 500
    assert got == {r["name"]: r["key"] for r in ingest.public_keys(rows.repartition(5), "name", size=2).collect()}
    taken = spark.createDataFrame([(k,) for k in sorted(got.values())[:50]], "key string")
    again = {r["key"] for r in ingest.public_keys(rows.limit(300), "name", taken, size=2).collect()}
    assert len(again) == 300 and not again & set(sorted(got.values())[:50])
    with pytest.raises(ValueError, match="too short"):
        ingest.public_keys(rows.limit(40), "name", size=1)


def test_website_signals(spark):
    firms = spark.createDataFrame([(1, None), (2, 1), (3, None)], "id long, merged_into long")
    attached = spark.createDataFrame([(1, "a", "attached"), (2, "b", "attached"), (2, "c", "tentative"), (3, "d", "attached"), (3, "e", "attached")], "business_id long, place_id string, status string")
    seen = spark.createDataFrame([(1, 1, "a", True, "own", 5), (2, 1, "a", False, "none", 9), (3, 2, "b", True, "social", 7), (4, 2, "c", True, "own", 99), (5, 1, "d", True, "own", 9), (6, 3, "d", None, None, 3)], "obs_id long, business_id long, place_id string, had_website boolean, host_class string, observed_at long")
    got = {r["id"]: tuple(r)[1:] for r in screens.website_signals(attached, seen, firms).collect()}
    # 1 and 2 are one; the latest of a says it has no website; d was observed for another business too; e never
    assert got == {1: (True, "social", 9, 2), 3: (None, None, 3, 1)}


def test_the_shared_folder_is_given_back(spark):
    import os

    from spinewright import core

    df = core.materialize(spark.range(3))
    folder = core._own_folder(spark).removeprefix("file://")
    assert df.count() == 3 and spark.sparkContext.applicationId in folder and os.path.isdir(folder)
    other = core._own_folder
    try:
        core._own_folder = lambda s: other(s) + "/part"
        kept = core.materialize(spark.range(2))
        assert core.cleanup(spark) and not os.path.exists(folder + "/part") and os.path.isdir(folder) and kept is not None
    finally:
        core._own_folder = other
