"""Cases of the fourth review, on tables made for them."""

import math
import random

from spinewright.operators import report, shapes
from tests.test_findings import _same, _tables
from tests.test_shapes import POINTS, SHAPES, _holds


def test_customers_whose_first_keys_meet_share_one(spark, tmp_path):
    # the first keys of 442,114 and 890,228 are the same, and so are those of 9,977 and 252,104
    c = spark.createDataFrame([(i, f"Customer#{i:09d}") for i in (442_114, 890_228, 9_977, 252_104, 5)], "c_custkey long, c_name string")
    _same(spark, "public_keys", _tables(spark, tmp_path, customer=c))


def test_points_of_shuffled_cells_meet_shapes_by_compiled_tests(spark, monkeypatch):
    # shuffled cells, of which one is so crowded that it is dealt over blocks
    monkeypatch.setattr(shapes, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(shapes, "CELL_POINTS", 50)
    r, square = random.Random(3), lambda x, y, d: [(x, y), (x, y + d), (x + d, y + d), (x + d, y)]
    made = [(i, [square(r.uniform(-98, -96), r.uniform(29, 31), 0.4)], None, None, None) for i in range(10)]
    made += [(20 + i, None, r.uniform(29, 31), r.uniform(-98, -96), m) for i, m in enumerate((50.0, 9e3, 4e4, 2e6))]
    points = [(i, 0, r.uniform(28.5, 31.5), r.uniform(-98.5, -95.5)) for i in range(800)] + [(1000 + i, 0, 30.0, -97.0) for i in range(300)]
    # points at a circle's edge, where the bounds of a distance leave the answer to the distance itself
    points += [(2000 + i, 0, made[12][2] + math.degrees(4e4 / 6_371_000) * (1 + (i - 5) * 2e-11), made[12][3]) for i in range(11)]
    some, cells = spark.createDataFrame(points, POINTS), spark.createDataFrame(made, SHAPES)
    out = shapes.points_in_shapes(some, cells)
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in x]
    assert len(joins) == 1 and "lambda" not in joins[0] and "block" in joins[0]
    want = {(p[0], s[0]) for p in points for s in made if _holds(s, p[2], p[3])}
    got = [(x["place_id"], x["shape_id"]) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and {s for _, s in want} > {22, 23}
    # rings with more edges in a row of cells than there are slots, and several rings, are joined apart
    comb = [(-97 + i / 100, 30 + (i % 2) / 2) for i in range(40)] + [(-96.6, 29.9), (-97.0, 29.9)]
    made += [(40, [comb], None, None, None), (41, [square(-97.5, 29.5, 1), square(-97.2, 29.8, 1)], None, None, None)]
    out = shapes.points_in_shapes(some, spark.createDataFrame(made, SHAPES))
    assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 2
    want = {(p[0], s[0]) for p in points for s in made if _holds(s, p[2], p[3])}
    assert {tuple(x) for x in out.select("place_id", "shape_id").collect()} == want and {40, 41} < {s for _, s in want}


def test_near_rows_are_shuffled_as_lists_of_a_position(spark, monkeypatch):
    # 300 rows at six positions and 90 at one, which has several lists
    monkeypatch.setattr(report, "LIST_ROWS", 60)
    written, put = [], report.materialize
    monkeypatch.setattr(report, "materialize", lambda df: written.append(put(df)) or written[-1])
    at = {i: (26.0 + i % 3 * 0.0006, -98.0 + i % 2 * 0.0011) for i in range(300)} | {300 + i: (27.0, -98.0) for i in range(90)}
    rows = spark.createDataFrame([(i, *p) for i, p in at.items()], "id long, lat double, lng double")
    out = report.proximity_pairs(rows, 0.00135, 0.0015)
    plan = out._jdf.queryExecution().executedPlan().toString()
    near = lambda a, b: abs(a[0] - b[0]) <= 0.00135 and abs(a[1] - b[1]) <= 0.0015
    assert sorted((r["left_id"], r["right_id"]) for r in out.collect()) == sorted((i, j) for i in at for j in at if i < j and near(at[i], at[j]))
    lists = next(df for df in written if "ids" in df.columns)
    assert 8 <= lists.count() < 20 and sum(len(r["ids"]) for r in lists.collect()) == len(at)
    # both sides become rows after their shuffle
    assert plan.index("Generate explode(a_ids") < plan.index("REPARTITION_BY_NUM") and plan.count("Generate explode(ids") == 1
