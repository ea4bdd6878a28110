"""Screen-level operators, sequential reservations, keys' hard cases and sinks against loops and hand-checked values."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from spinewright import core
from spinewright.functions import keys
from spinewright.operators import meter, report, resolve, screens, sweep
from spinewright.streaming import observe


def test_letters_fold_like_their_decompositions(spark):
    letters = [chr(c) for c in range(0xC0, 0x1F00) if unicodedata.category(chr(c))[0] == "L"]
    got = [x[0] for x in spark.createDataFrame([(c,) for c in letters], "c string").select(keys.fold(F.col("c"))).collect()]
    assert got == [keys.plain(c) for c in letters]


def test_hash_works_on_utf16_units(spark):
    def plain(text):
        h, raw = 2166136261, text.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
        return h

    texts = ["", "abc", "é漢", "\U0001f600", "a\U0001f600b\U00010000"]
    assert [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(keys.fnv1a32(F.col("t"))).collect()] == [plain(t) for t in texts]


def test_keys_of_permits(spark):
    row = spark.createDataFrame([("7", "1001", "  San \t Juan ", " ")], "a string, b string, c string, d string")
    got = row.select(
        keys.county_padded(F.col("a")), keys.county_padded(F.col("b")), keys.county_bare(F.lit("007")), keys.folded(F.col("c")), keys.folded(F.col("d")), keys.external_id(F.col("a"), F.col("b")),
        keys.public_key(F.col("c")), keys.picked_phone(F.array(F.lit("12")))["e164"], keys.chain_key(F.lit("Taqueria Jalisco"), F.lit("jalisco")),
    ).first()
    assert tuple(got)[:6] == ("007", None, "7", "SAN JUAN", None, "7-1001") and got[7] is None and got[8] == "taqueria jalisco"
    assert len(got[6]) == 9 and got[6].startswith("SL-") and set(got[6][3:]) <= set(keys.KEY_DIGITS)


def test_tiles_equal_a_recursion(spark):
    r = random.Random(2)
    points = [(i, r.random() ** 2, r.random()) for i in range(2000)]
    want = {}

    def split(path, s, w, n, e, inside):
        want[path] = len(inside)
        if len(inside) >= 100 and len(path) <= 4:
            my, mx = (s + n) / 2, (w + e) / 2
            for d, (a, b, c, f) in enumerate(((s, w, my, mx), (s, mx, my, e), (my, w, n, mx), (my, mx, n, e))):
                own = [p for p in inside if a <= p[1] < c and b <= p[2] < f]
                if own:
                    split(f"{path}{d}", a, b, c, f, own)

    split("r", 0.0, 0.0, 1.0, 1.0, points)
    frame = spark.createDataFrame(points, "id long, lat double, lng double")
    got = sweep.subdivided(frame, (0.0, 0.0, 1.0, 1.0), 100, 4)
    assert {x["path"]: x["points"] for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Scan") == 1 and "NestedLoop" not in plan
    assert sweep.subdivided(frame.limit(0), (0.0, 0.0, 1.0, 1.0), 100, 4).count() == 0


def test_blocks_keep_to_live_rows_of_one_tenant(spark):
    rows = [(i, "same name", "+19562345678", True, "1", "78501", org, gone) for i, org, gone in ((1, "a", None), (2, "a", None), (3, "b", None), (4, "a", 1), (5, None, None), (6, None, None))]
    b = spark.createDataFrame(rows, "id long, name_norm string, phone string, blockable boolean, street_num string, postal string, org_id string, merged_into long")
    assert {(x["left_id"], x["right_id"]) for x in resolve.candidates(b).collect()} == {(1, 2), (5, 6)}
    assert {(x["left_id"], x["right_id"]) for x in resolve.candidates(b.drop("org_id", "merged_into")).collect()} == {(i, j) for i in range(1, 7) for j in range(i + 1, 7)}


def test_candidates_read_their_rows_once(spark):
    from spinewright.plans import resolve_queries

    plan = resolve_queries.candidate_union(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "p_type" not in plan and "part.parquet" not in plan  # the arms work on the materialised rows


def test_months_across_clock_changes(spark):
    row = spark.sql("select timestamp'2024-03-05 12:00:00' a, timestamp'2024-11-01 04:59:59' b")
    got = row.select(*[F.date_format(x, "yyyy-MM-dd HH:mm") for c in "ab" for x in (report.period_window(F.col(c))["start"], report.period_window(F.col(c))["reset"])]).first()
    assert tuple(got) == ("2024-03-01 06:00", "2024-04-01 05:00", "2024-10-01 05:00", "2024-11-01 05:00")


def test_public_columns_only(spark):
    rows = spark.createDataFrame([(1, "n", "s", None), (2, "m", "s", 1)], "id long, display_name string, phone_private string, merged_into long")
    out = screens.exported(rows)
    assert out.columns == ["id", "display_name"] and out.count() == 1


def test_percent_and_version(spark):
    row = spark.createDataFrame([(0, 0, 0), (5, 0, -1), (199, 100, 1_700_000_000), (1, 3, None)], "used long, cap long, at long")
    got = report.source_version(row, "at").select(report.pct_used(F.col("used"), F.col("cap")), "source_version").collect()
    assert [tuple(x) for x in got] == [(0, "1970-01-01T00:00:00Z"), (100, None), (199, "2023-11-14T22:13:20Z"), (33, None)]


def test_purge_overdue(spark):
    t = lambda h: f"timestamp'2024-01-10 00:00:00' - interval {h} hour"
    case = lambda expired_at, purge, expired, held, held_at: meter.purge_overdue(F.expr(t(0)), *[F.expr(x) if x else F.lit(None).cast("timestamp") for x in (expired_at, purge)], F.lit(expired), F.lit(held), F.expr(held_at) if held_at else F.lit(None).cast("timestamp"))
    got = spark.range(1).select(case(t(40), t(1), 1, 1, None), case(t(10), t(40), 1, 1, None), case(t(10), t(1), 1, 1, None), case(None, None, 1, 1, None), case(None, None, 0, 1, t(50)), case(None, None, 0, 1, t(5)), case(None, None, 0, 0, None)).first()
    assert tuple(got) == (True, True, False, True, True, False, False)


def test_replayed_batches_are_not_doubled(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "request long, v string")
    sink = observe.ledger_sink(f"file://{tmp_path}/l", "request", 4)
    for batch in (0, 0, 1, 1):
        sink(rows if batch == 0 else rows.unionByName(spark.createDataFrame([(3, "c")], "request long, v string")), batch)
    assert sorted(x["request"] for x in spark.read.parquet(f"file://{tmp_path}/l").collect()) == [1, 2, 3]


def test_no_machine_folder_on_a_cluster(spark):
    class Conf:
        def __init__(self, **kept):
            self.kept = kept

        def get(self, key, default=None):
            return self.kept.get(key, default)

    class Session:
        def __init__(self, **kept):
            self.conf = Conf(**kept)

    assert core.shared_root(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    with pytest.raises(ValueError):
        core.shared_root(Session(**{"spark.master": "yarn"}))
    with pytest.raises(ValueError):
        core.shared_root(Session(**{"spark.master": "local-cluster[3,2,1024]"}))
    assert core.shared_root(Session(**{"spark.master": "local[4]"})).startswith("file:")
