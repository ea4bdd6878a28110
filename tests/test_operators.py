"""Hand-checked values of keys, scores, graphs, sources, metering and streams."""

import random

import pytest
from pyspark.sql import functions as F

from spinewright.core import sized_join
from spinewright.functions import keys
from spinewright.operators import graph, ingest, meter, report, resolve, sweep
from spinewright.sources import files
from spinewright.streaming import observe


def one(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], kinds).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "norm"), [
    ("ZORBA, INC.", "zorba"), ("Rio Roofing L.L.C.", "rio roofing"), ("Sun Plumbing, LLC DBA Sun Pros", "sun plumbing sun pros"), ("Ølsen Straße", "olsen strasse"), ("LLC", None), (None, None), ("", None),
    ("C & L Plumbing", "c l plumbing"), ("Taqueria de la Rosa Mia", "rosa mia"), ("Taqueria Guanajuato", "taqueria guanajuato"), ("Smith LLC 956-263-1462", "smith"), ("Las 3 Torres", "3 torres"), ("Garza Co Inc", "garza"), ("Café Ñandú", "cafe nandu"),
])
def test_name_norm(spark, raw, norm):
    assert one(spark, keys.name_norm(F.col("r")), r=raw) == norm


def test_store_number(spark):
    assert one(spark, keys.name_parts(F.col("r")), r="Smartstyle 8")["had_store_number"]
    assert not one(spark, keys.name_parts(F.col("r")), r="8 Smartstyle")["had_store_number"]


@pytest.mark.parametrize(("raw", "want"), [
    ("123 North Main Street Suite 4-B", ("123", "N MAIN ST", "4-B")), ("500 E Nolana Ave #12", ("500", "E NOLANA AVE", "12")), ("Lot Road", (None, "LOT RD", None)), ("77 Suite Drive", ("77", "SUITE DR", None)), (None, (None, None, None)),
])
def test_address(spark, raw, want):
    got = one(spark, keys.address_parts(F.col("r")), r=raw)
    assert (got["street_num"], got["street_norm"], got["unit"]) == want


@pytest.mark.parametrize(("raw", "want"), [("(956) 263-1462", ("+19562631462", True)), ("1-800-263-1462", ("+18002631462", False)), ("956-555-1462", (None, False)), ("263-1462", (None, False)), ("956 263 1462 x12", ("+19562631462", False)), (None, (None, False))])
def test_phone(spark, raw, want):
    got = one(spark, keys.phone(F.col("r")), r=raw)
    assert (got["e164"], got["blockable"]) == want


@pytest.mark.parametrize(("url", "kind"), [(None, "none"), ("https://www.facebook.com/x", "social"), ("http://notfacebook.com", "other"), ("https://shop.business.site/", "business_site_dead"), ("http://business.site.evil.com", "other"), ("not a url", "other"), ("https://a.wixsite.com/b", "platform_subdomain")])
def test_host_class(spark, url, kind):
    assert one(spark, keys.host_class(F.col("u")), u=url) == kind


def test_hash_distance_similarity(spark):
    assert [one(spark, keys.fnv1a32(F.col("s")), s=s) for s in ("", "a", "abc")] == [2166136261, 3826002220, 440920331]
    d = keys.distance_m(*map(F.col, ("a", "b", "c", "d")))
    assert one(spark, d, a=26.2, b=-98.2, c=26.2, d=-98.2) == 0
    assert abs(one(spark, d, a=0.0, b=0.0, c=0.0, d=1.0) - 111194.93) < 1
    sim = keys.gram_similarity(keys.trigrams(F.col("a")), keys.trigrams(F.col("b")))
    assert round(one(spark, sim, a="word", b="two words"), 4) == 0.3636 and round(one(spark, sim, a="smartstyle 8", b="smartstyle"), 4) == 0.8462
    assert one(spark, sim, a="", b="") == 0
    assert one(spark, keys.postal(F.col("p")), p=" 78501-1234 ") == "78501" and one(spark, keys.unit_identity(F.col("u")), u="Ste. #4-B") == "4B"


def test_score_rules(spark):
    base = dict(name_norm="rio grande roofing", phone="+19562631462", blockable=True, street_num="1", street_norm="MAIN ST", unit="2", postal="78501", lat=26.2, lng=-98.2, location_match_type="overture", cluster_key="roof", chain=False)
    schema = "id long, name_norm string, phone string, blockable boolean, street_num string, street_norm string, unit string, postal string, lat double, lng double, location_match_type string, cluster_key string, chain boolean"
    cases = [({}, 100, "merge"), ({"lat": 27.2}, 0, "distinct"), ({"chain": True}, 94, "review"), ({"name_norm": "zzz"}, 80, "review"), ({"location_match_type": "census_non_exact"}, 94, "review"), ({"phone": None, "street_num": "2", "street_norm": "OAK", "lat": 26.21}, 59, "ignore"), ({"lat": None}, 94, "review"), ({"unit": "Ste. #2"}, 100, "merge"), ({"unit": "3", "phone": None, "lat": None}, 65, "ignore")]
    rows, pairs = [tuple({"id": 0, **base}[k] for k in resolve.BUSINESS)], []
    for i, (change, _, _) in enumerate(cases, 1):
        rows.append(tuple({"id": i, **base, **change}[k] for k in resolve.BUSINESS))
        pairs.append((0, i))
    b = spark.createDataFrame(rows, schema)
    got = {r["right_id"]: r for r in resolve.score(resolve.sides(spark.createDataFrame(pairs, "left_id long, right_id long"), b)).collect()}
    for i, (change, score, band) in enumerate(cases, 1):
        assert (got[i]["score"], got[i]["band"]) == (score, band), (change, got[i])


def test_components(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(r.randint(400, 600), r.randint(400, 600)) for _ in range(120)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {x["node"]: x["root"] for x in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sized_join_both_ways(spark):
    a, b = spark.range(100), spark.range(50, 150)
    assert sized_join(a, b, "id").count() == sized_join(a, b, "id", limit=1).count() == 50
    assert "SortMergeJoin" in sized_join(a, b, "id", limit=1)._jdf.queryExecution().executedPlan().toString()


def test_block_cap_refuses_whole_blocks(spark):
    rows = spark.createDataFrame([(i, "n", "p" if i < 40 else "q") for i in range(44)], "id long, name_norm string, k string")
    assert resolve.block_pairs(rows, F.col("k")).count() == 6
    assert [tuple(r) for r in resolve.skipped_blocks(rows, F.col("k")).collect()] == [("p", 40, 780)]


def test_geocoder_lines(spark):
    lines = ['"1","1 Main","Match","Exact","1 MAIN ST","-98.2,26.2","5","L"', '"2","x","No_Match"', '"3","x","Tie"', '"4","x","Match","Exact","y","-120,26","5","L"', '"5","x","Match","Exact","y","junk","5","L"', ""]
    got = {r["id"]: (r["outcome"], r["lat"]) for r in files.geocoded(spark.createDataFrame([(x,) for x in lines], "value string"), 25, -107, 37, -93).collect()}
    assert got == {"1": ("match", 26.2), "2": ("no_match", None), "3": ("tie", None), "4": ("out_of_bounds", None), "5": ("malformed", None)}


def test_files(spark, tmp_path):
    batch = files.geocode_batch(spark.createDataFrame([(1, 'a "b"\x07c', None)], "id long, s string, z string"), ["id", "s", "z"])
    assert batch.first()["value"] == '"1","a ""b"" c",""'
    lines = spark.createDataFrame([('{"a": 1, "zz": 2}',), ("{bad",)], "value string")
    from pyspark.sql.types import LongType, StructField, StructType

    good, bad = files.typed_json(lines, StructType([StructField("a", LongType())]))
    assert [tuple(r) for r in good.collect()] == [(1,)] and [r["value"] for r in bad.collect()] == ["{bad"]
    for name in ("2024-01", "2024-02"):
        spark.range(1).selectExpr("id", "named_struct('xmin', -98.0, 'ymin', 26.0) as bbox").write.parquet(f"{tmp_path}/release/{name}/t")
    assert [r["release"] for r in files.releases(spark, str(tmp_path)).collect()] == ["2024-02", "2024-01"]
    scan = files.box_scan(spark, f"{tmp_path}/release/2024-01/t", 25, -99, 27, -97, ["id"])
    assert scan.count() == 1 and "PushedFilters: [IsNotNull(bbox.xmin)" in scan._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "s.json").write_text('{"cities": [{"n": "x"}, {"n": "y"}]}')
    assert files.seed(spark, str(tmp_path / "s.json"), "cities").count() == 2


def test_ingest_helpers(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, h string"), spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k long, h string")
    assert {tuple(r) for r in ingest.upsert_actions(old, new, "k", "h").collect()} == {(1, "gone"), (2, "changed"), (3, "unchanged"), (4, "inserted")}
    assert {tuple(r) for r in ingest.upserted(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, None), (4, "d")}
    assert {tuple(r) for r in ingest.insert_absent(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, None), (4, "d")}


def test_meter_and_report(spark):
    assert one(spark, meter.priced(F.col("r"), F.col("f"), F.lit(35_000)), r=59_436, f=1_000) == 2_045_260_000
    assert one(spark, meter.micros(F.col("m")), m=1.5) == 1_500_000
    assert one(spark, report.band(F.col("c")), c=0.95) == "0.9-1.0" and one(spark, report.band(F.col("c")), c=1.0) == "=1.0"
    week = report.week_index(F.expr("timestamp_ntz'1970-01-12 12:00:00'"))
    assert spark.range(1).select(week.alias("w")).first()["w"] == 1
    tile = spark.createDataFrame([("r", 0.0, 0.0, 4.0, 8.0)], "path string, south double, west double, north double, east double")
    assert {tuple(r) for r in sweep.quadrants(tile).collect()} == {("r0", 0.0, 0.0, 2.0, 4.0), ("r1", 0.0, 4.0, 2.0, 8.0), ("r2", 2.0, 0.0, 4.0, 4.0), ("r3", 2.0, 4.0, 4.0, 8.0)}


def test_streams(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    events = observe.event_stream(spark, sf)
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert observe.drained(observe.once(events, ["event_id"]).select("event_id"), f"{tmp_path}/once", "append").count() == n
    live = observe.drained(observe.latest_with_expiry(events, "user_id"), f"{tmp_path}/live", "update")
    assert live.where("status = 'live'").select("user_id").distinct().count() == spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    sink, batch = observe.ledger_sink(f"{tmp_path}/ledger", "id"), spark.range(10)
    for batch_id, rows in ((0, batch), (0, batch), (1, spark.range(5, 15))):
        sink(rows, batch_id)
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 15
