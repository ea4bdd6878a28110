"""Merging, geometry, metering and planning against plain loops and hand-checked values."""

import random

import pytest
from pyspark.sql import functions as F

from spinewright.operators import geometry, ingest, merge, meter, sweep
from tests.test_operators import one


def test_merge_bookkeeping(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 9)], "id long, root long")
    made = spark.createDataFrame([(1, 5), (2, 3), (3, 3), (9, 1)], "id long, created_at long")
    assert {tuple(x) for x in merge.winners(roots, made).collect()} == {(1, 2), (2, 2), (3, 2), (9, 9)}
    merges = spark.createDataFrame([(1, 5, 6, False), (2, 5, 7, False), (3, 5, 8, True), (4, 9, 5, True)], "merge_id long, winner long, loser long, undone boolean")
    assert {x["merge_id"] for x in merge.undoable(merges).collect() if x["undoable"]} == {2}
    saves = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", 2, 12)], "k string, version int, at int")
    assert {x["at"] for x in merge.version_conflicts(saves, "k", "version", ["at"]).collect() if x["refused"]} == {11}
    rows = spark.createDataFrame([("x", None, 1), ("x", "o", 2), ("y", None, 3), ("z", "p", 4)], "k string, org_id string, v int")
    assert {(x["k"], x["v"]) for x in merge.own_or_built_in(rows, ["k"], "o", ["v"]).collect()} == {("x", 2), ("y", 3)}


def test_chain_flags(spark):
    rows = [(1, "a", None, None, None), (2, "a", None, None, "a"), (3, "a", None, None, None), (4, "b", None, None, "b"), (5, "c", None, None, None), (6, "c", "own", None, None), (7, "a", None, 1, "a"), (8, None, None, None, "x")]
    b = spark.createDataFrame(rows, "id long, name_norm string, override string, merged_into long, chain_key string")
    got = {x["id"]: (x["chain_key"], x["change"]) for x in merge.flagged_chains(b, spark.createDataFrame([("c", 3), ("b", 2)], "name_norm string, n long")).collect()}
    assert got == {1: ("a", "flagged"), 2: ("a", "unchanged"), 3: ("a", "flagged"), 4: (None, "cleared"), 5: ("c", "flagged"), 7: (None, "cleared"), 8: (None, "cleared")}


def _record(**values):
    base = dict.fromkeys(("legal_name", "display_name", "phone", "blockable", "street", "street_num", "street_norm", "unit", "postal", "city", "lat", "lng", "match_type", "closed_at", "basic_category", "cluster_key", "operating_status", "confidence"))
    return {"k": 1, **base, **values}


def test_survivors_by_source(spark):
    schema = "k long, id long, source string, confidence double, legal_name string, display_name string, phone string, blockable boolean, street string, street_num string, street_norm string, unit string, postal string, city string, lat double, lng double, match_type string, closed_at timestamp, basic_category string, cluster_key string, operating_status string"
    names = [x.split()[0] for x in schema.split(", ")]
    records = [
        _record(id=1, source=merge.PERMIT, legal_name="LEGAL", phone="p1", blockable=True, street="s1", postal="1", cluster_key="permit"), _record(id=2, source=merge.PLACES, confidence=0.5, display_name="low", phone="p2", blockable=False, lat=1.0, lng=2.0, match_type="overture"),
        _record(id=3, source=merge.PLACES, confidence=0.9, display_name="high", postal="3"), _record(id=4, source=merge.GEOCODER, lat=5.0, lng=6.0, match_type="census_exact"), _record(id=5, source="elsewhere", confidence=1.0, display_name="no", phone="no"),
        _record(k=2, id=6, source=merge.PERMIT, legal_name="ONLY"), _record(k=2, id=7, source=merge.GEOCODER, lat=7.0, lng=8.0, match_type="census_non_exact"), _record(k=2, id=8, source=merge.GEOCODER, lat=9.0, lng=8.0, match_type="census_exact"), _record(k=3, id=9, source=merge.PERMIT, legal_name="HIDDEN"), _record(k=3, id=10, source=merge.PLACES),
    ]
    out = {x["k"]: x for x in merge.survived(spark.createDataFrame([tuple(x[n] for n in names) for x in records], schema), "k").collect()}
    a, b, c = out[1], out[2], out[3]
    assert (a["legal_name"], a["display_name"], a["display_name_source"], a["phone"], a["blockable"], a["postal"], a["street"], a["lat"], a["cluster_key"], a["confidence"]) == ("LEGAL", "high", 3, "p2", False, "3", None, 1.0, "permit", 0.9)
    assert (b["display_name"], b["lat"], b["location_source"]) == ("ONLY", 9.0, 8)
    assert (c["legal_name"], c["display_name"], c["phone"], c["blockable"]) == ("HIDDEN", None, None, False)


def test_attachments_keep_decisions(spark):
    s = "k long, status string, reason string, score int, run int"
    old = [(1, "rejected", "score", 1, 1), (2, "tentative", "confirmed", 1, 1), (3, "attached", "score", 1, 1), (4, "tentative", "score", 1, 1), (5, "attached", "score", 1, 1)]
    new = [(1, "attached", "score", 9, 2), (2, "attached", "score", 9, 2), (3, "tentative", "score", 9, 2), (4, "attached", "score", 9, 2), (6, "tentative", "score", 9, 2)]
    got = {tuple(x) for x in merge.attachments_kept(spark.createDataFrame(old, s), spark.createDataFrame(new, s), ["k"]).collect()}
    assert got == {(1, "rejected", "score", 1, 1), (2, "tentative", "confirmed", 1, 1), (3, "attached", "score", 1, 2), (4, "attached", "score", 9, 2), (5, "attached", "score", 1, 1), (6, "tentative", "score", 9, 2)}


# geometry

_RING_TYPE = "array<struct<lng:double,lat:double>>"


def _inside(x, y, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            hit = not hit
    return hit


def _segment_meets(a, b, r):
    """Clips the segment by the rectangle's four sides."""
    lo, hi = 0.0, 1.0
    for start, step, least, most in ((a[0], b[0] - a[0], r[1], r[3]), (a[1], b[1] - a[1], r[0], r[2])):
        if step == 0:
            if not least <= start <= most:
                return False
            continue
        t = sorted(((least - start) / step, (most - start) / step))
        lo, hi = max(lo, t[0]), min(hi, t[1])
    return lo <= hi


def test_rings_and_rectangles(spark):
    import math

    r, rows = random.Random(4), []
    for i in range(300):
        n, cx, cy = r.randint(3, 9), r.uniform(-2, 2), r.uniform(-2, 2)
        angles = sorted((r.uniform(0, 2 * math.pi) for _ in range(n)), reverse=True)
        ring = [(cx + (d := r.uniform(0.2, 2)) * math.cos(t), cy + d * math.sin(t)) for t in angles]
        ring.append(ring[0])
        s, w = r.uniform(-3, 3), r.uniform(-3, 3)
        rows.append((i, ring, s, w, s + r.uniform(0.01, 1.5), w + r.uniform(0.01, 1.5)))
    d = spark.createDataFrame(rows, f"id int, ring {_RING_TYPE}, s double, w double, n double, e double")
    rect = geometry.Rect(*map(F.col, "swne"))
    got = d.select("id", geometry.meets_rings(rect, F.array("ring")).alias("meets"), geometry.in_ring(F.col("w"), F.col("s"), F.col("ring")).alias("inside"), geometry.clockwise(F.col("ring")).alias("cw"), geometry.bounding_box(F.array("ring")).alias("box")).collect()
    for x in got:
        _, ring, s, w, n, e = rows[x["id"]]
        assert x["inside"] == _inside(w, s, ring)
        assert x["meets"] == (any(_segment_meets(a, b, (s, w, n, e)) for a, b in zip(ring, ring[1:], strict=False)) or _inside(w, s, ring))
        assert x["cw"] == (sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(ring, ring[1:], strict=False)) > 0)
        assert tuple(x["box"]) == (min(p[1] for p in ring), min(p[0] for p in ring), max(p[1] for p in ring), max(p[0] for p in ring))


def test_ring_cleaning(spark):
    ring = [(0.0, 0.0), (0.0, 1.00001), (0.00001, 1.00002), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    d = spark.createDataFrame([(ring, ring[::-1], [(0.0, 0.0)], None)], ", ".join(f"{c} {_RING_TYPE}" for c in "abcd"))
    x = d.select(geometry.outer_rings(F.array("a", "b", "c")).alias("r"), geometry.cleaned(F.col("d")).alias("none")).first()
    assert [[tuple(p) for p in q] for q in x["r"]] == [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]] and x["none"] is None


def test_circles(spark):
    box = geometry.circle_box(F.lit(26.0), F.lit(-98.0), F.lit(10_000.0))
    s, w, n, e = spark.range(1).select(*box).first()
    assert abs((n - s) * geometry.M_PER_DEGREE - 20_000) < 1 and abs((s + n) / 2 - 26) < 1e-9 and (e - w) > (n - s)
    near = geometry.meets_circle(geometry.Rect(*map(F.lit, (26.05, -98.0, 26.2, -97.9))), F.lit(26.0), F.lit(-98.0), F.col("m"))
    assert one(spark, near, m=6_000.0) and not one(spark, near, m=5_000.0)


# metering and planning


@pytest.mark.parametrize(("text", "micros"), [("50", 50_000_000), ("$50.00", 50_000_000), ("1,250.5", 1_250_500_000), ("12,50", None), ("-1", None), ("", None), ("1.234", None), (None, None), ("1,000,000", 10**12), ("1000000.01", None)])
def test_dollars(spark, text, micros):
    assert one(spark, meter.parsed_dollars(F.col("t")), t=text) == micros


def test_dollars_shown(spark):
    shown = meter.dollars(F.col("m"))
    assert [one(spark, shown, m=m) for m in (0, 9_999, 10_000, 1_999_999, -1_500_000)] == ["0.00", "0.00", "0.01", "1.99", "-1.50"]


def test_tiers_and_errors(spark):
    of = {"id": "ts_essentials", "name": "ts_pro", "phone": "ts_enterprise"}
    tier = lambda *fields: spark.range(1).select(meter.tier(F.array(*map(F.lit, fields)), of).alias("t")).first()["t"]
    assert (tier("id"), tier("id", "phone", "name"), tier("id", "unknown")) == ("ts_essentials", "ts_enterprise", None)
    error = lambda status, *limits: spark.range(1).select(meter.quota_error(F.lit(status), F.array(*map(F.lit, limits)).cast("array<string>")).alias("e")).first()["e"]
    assert [error(429, "SearchPerDay"), error(429, "RequestsPerMinute"), error(429), error(403), error(503)] == ["daily_quota", "rate_limited", "daily_quota", "rejected", "unavailable"]


def test_area_and_service_listing(spark):
    assert [one(spark, sweep.out_of_area(F.col("a")), a=a) for a in ("x, Reynosa, México ", "x, McAllen, TX", None)] == [True, False, False]
    score = sweep.service_area_score(F.lit(99), F.col("p") == 1, F.lit(True), F.col("s"))
    assert [one(spark, score, p=1, s=0.6), one(spark, score, p=1, s=0.5), one(spark, score, p=0, s=0.9)] == [95, 94, 94]


def test_skip_reasons(spark):
    reason = ingest.skip_reason(F.col("n"), F.col("c"), F.col("r"), F.col("ok") == 1)
    assert [one(spark, reason, n=n, c=c, r=r, ok=ok) for n, c, r, ok in (("x", "US", "TX", 1), (" ", "US", "TX", 1), ("x", "US", None, 1), ("x", "MX", "TX", 1), (None, "MX", None, 0))] == [None, "no_name", "not_texas", "not_texas", "malformed"]


def test_root_tiles_come_once(spark):
    cells = spark.createDataFrame([("food", "city", "a\0b"), ("food", "city", "a\0b"), ("roof", "county", "c")], "cluster string, unit_kind string, unit string")
    types = spark.createDataFrame([("food", "cafe"), ("food", "bar"), ("roof", "roofer")], "cluster string, type string")
    assert sorted(x["tile_key"] for x in sweep.root_tiles(cells, types).collect()) == ["city:a/b|bar|r", "city:a/b|cafe|r", "county:c|roofer|r"]
