"""Cases of the third review, on tables made for them."""

import hashlib
import os
import shutil

from pyspark.sql import functions as F

import __spark_entry__ as entry
from spinewright.functions import keys
from spinewright.llm import near_copies
from spinewright.operators import ingest, listings, report, reports, shapes, sweep
from tests.compare import SF, same_rows


def _tables(spark, path, **changed):
    """A copy of the smallest tables with some of them changed."""
    for name in os.listdir(SF):
        if name[:-8] not in changed:
            shutil.copy(f"{SF}/{name}", path)
    for name, df in changed.items():
        df.coalesce(1).write.parquet(f"file://{path}/{name}")
        part = next(x for x in os.listdir(path / name) if x.endswith(".parquet"))
        shutil.move(path / name / part, path / f"{name}.parquet")
        shutil.rmtree(path / name)
    return str(path)


def _shifted(df, key, by):
    return df.withColumn(key, F.col(key) + by)


def _same(spark, name, sf):
    same_rows(spark, entry.queries()[name], entry.oracle_sql()[name], sf)


def test_closures_of_roots_without_orders(spark, tmp_path):
    o = spark.read.parquet(f"{SF}/orders.parquet").where("o_custkey % 10 <> 4")
    _same(spark, "closure_apply", _tables(spark, tmp_path, orders=o))


def test_paths_of_large_keys_are_no_places(spark, tmp_path):
    p = spark.read.parquet(f"{SF}/part.parquet")
    _same(spark, "key_shapes", _tables(spark, tmp_path, part=p.unionByName(_shifted(p, "p_partkey", 300_000))))


def test_name_keys_fold_once(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("raw"))
    text = df.select(keys.chain_key(F.col("raw"), keys.name_norm(F.col("raw"))).alias("key"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("translate(") == 2


def test_names_are_keyed_after_they_are_counted(spark):
    text = entry.queries()["statewide_name_fold"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" in text and "translate(" not in text[text.rindex("Aggregate ["):].split("\n", 1)[1]


def test_few_rows_of_a_sample_are_ranked(spark):
    rows, rules = spark.range(50_000), [("all", F.lit(True), 20), ("odd", F.col("id") % 2 == 1, 5), ("few", F.col("id") < 3, 5), ("none", F.col("id") < 0, 5)]
    lead = ingest._leading(rows, rules, [20, 5, 5, 5], "id")
    assert lead.count() < 100
    want = {0: 20, 1: 5, 2: 3}
    got = ingest._ranked(rows, rules, [20, 5, 5, 5], "id")
    assert {r["rule"]: r["count"] for r in got.groupBy("rule").count().collect()} == want
    digest = lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)
    assert [r["row"]["id"] for r in got.where("rule = 0").orderBy("place").collect()] == sorted(range(50_000), key=digest)[:20]


def test_crowded_cells_meet_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(report, "CELL_ROWS", 7)
    at = {i: (26.0 + i % 13 * 0.0004, -98.0 + i % 7 * 0.0005) for i in range(400)}
    rows = spark.createDataFrame([(i, *p) for i, p in at.items()] + [(900, None, 1.0)], "id long, lat double, lng double")
    out = report.proximity_pairs(rows, 0.00135, 0.0015)
    near = lambda a, b: abs(a[0] - b[0]) <= 0.00135 and abs(a[1] - b[1]) <= 0.0015
    want = sorted((i, j) for i in at for j in at if i < j and near(at[i], at[j]))
    assert sorted((r["left_id"], r["right_id"]) for r in out.collect()) == want
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [x" in text and "SortMergeJoin" in text[: text.index("BroadcastHashJoin")]


def test_similar_members_of_a_large_bucket_are_linked(spark, monkeypatch):
    # groups of two under one bucket, each far from the bucket's least and largest class and in other fine buckets
    monkeypatch.setattr(near_copies, "BLOCK", 5)
    words = lambda g: [f"w{g}x{i}" for i in range(60)]
    texts = [" ".join([*words(g)[:-1], f"end{side}"]) for g in range(20) for side in (0, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_copies.classes(docs).withColumns({"wide": F.array(F.lit(1).cast("long")), "fine": F.array(F.col("class"))})
    of = {r["class"]: r["text"] for r in near_copies.classes(docs).join(docs.select("text", F.xxhash64("text").alias("version")), "version").collect()}
    got = {frozenset((of[r["src"]], of[r["dst"]])) for r in near_copies.links(docs, found).collect()}
    assert got == {frozenset(texts[2 * g : 2 * g + 2]) for g in range(20)}


def test_near_copies_of_an_absent_text_form_few_pairs(spark, monkeypatch):
    # 150 texts, each with four words of its own in one frame, so far from all others; ten have a near copy of another size
    monkeypatch.setattr(near_copies, "BLOCK", 40)
    frame, texts = [f"w{i}" for i in range(150)], []
    for i in range(150):
        own = list(frame)
        for at in (7 + i * 37 % 20, 40 + i * 53 % 20, 75 + i * 29 % 20, 110 + i * 31 % 20):
            own[at] = f"own{i}at{at}"
        texts += [" ".join(own)] + [" ".join([*own, f"end{i}", "end"])] * (i < 10)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_copies.classes(docs)
    of = {r["class"]: r["text"] for r in found.join(docs.select("text", F.xxhash64("text").alias("version")), "version").collect()}
    sets = docs.join(found, F.xxhash64("text") == F.col("version")).select("class", "text").mapInArrow(near_copies._sets, "class long, shingles binary")
    large = found.select(F.lit(1).cast("long").alias("bucket"), "class", F.lit(len(texts)).cast("long").alias("n"))
    pairs = near_copies._apart(large, spark.createDataFrame([], "src long, dst long"), sets).collect()
    shingles = {c: set(near_copies._shingles(near_copies._words(t)).tolist()) for c, t in of.items()}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    want = {(a, b) for a in of for b in of if a < b and alike(a, b) >= 0.8}
    assert len(of) == 160 and len(want) >= 10 and want <= {(r["src"], r["dst"]) for r in pairs}
    assert len(pairs) < 300  # of 12,720


def test_cells_of_one_file_are_classed_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(shapes, "CELLS_A_TASK", 20)
    written, put = [], shapes.materialize
    monkeypatch.setattr(shapes, "materialize", lambda df: written.append(df.rdd.getNumPartitions()) or put(df))
    circles = spark.range(30).selectExpr("id shape_id", "29 + id / 50 lat", "-96 - id / 50 lng", "cast(3000 + 100 * id as double) radius_m", "cast(null as array<array<struct<lng:double,lat:double>>>) rings").coalesce(1)
    cells = shapes.cover(circles, finer=3)
    assert min(written) > 1 and cells.select("shape_id", "depth", "x", "y").distinct().count() == cells.count()


def test_crowded_places_meet_few_rows(spark, monkeypatch):
    # two crowded corners of one cell: a place in the second sees none of the first's rows, which come before its own by id
    for name, n in {"SHOWN": 4, "MORE": 4, "PLACES": 50}.items():
        monkeypatch.setattr(listings, name, n)
    at = {i: (26.0001 + i % 9 * 0.00001, -97.9999 - i % 5 * 0.00001) for i in range(200)}
    at |= {i: (26.0018 + i % 9 * 0.00001, -97.9984 - i % 5 * 0.00001) for i in range(200, 300)}
    at |= {300 + i: (27 + i * 0.0005, -98 + i % 3 * 0.0004) for i in range(40)}
    written, put = [], listings.materialize
    monkeypatch.setattr(listings, "materialize", lambda df: written.append(put(df)) or written[-1])
    rows = spark.createDataFrame([(i, *p) for i, p in at.items()], "id long, lat double, lng double")
    found = listings._nearby(rows, rows).collect()
    near = lambda p, q: p[0] - listings.BOX_LAT <= q[0] <= p[0] + listings.BOX_LAT and p[1] - listings.BOX_LNG <= q[1] <= p[1] + listings.BOX_LNG
    want = {(*p, i) for p in at.values() for i in [i for i, q in at.items() if near(p, q)][: listings.OTHERS]}
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    heads = [df.groupBy("x", "y").count().agg(F.max("count")).first()[0] for df in written if "hidden" in df.columns and "x" in df.columns]
    assert heads[0] == 5 and len(heads) > 1  # four rows of a cell and the one that stands for the rest, then more


def test_matches_are_scored_once(spark):
    scored = spark.range(60).select((F.col("id") % 7).alias("probe"), (F.col("id") * 5 % 11).alias("other"), (F.col("id") % 3 * 5 + 85).alias("score"))
    out = sweep.decided(scored, "probe", "score", "other", 90, 80)
    of = {}
    for r in scored.distinct().collect():
        of.setdefault(r["probe"], []).append((-r["score"], r["other"]))
    best = {p: sorted(x)[:2] for p, x in of.items()}
    got = {r["probe"]: (r["score"], r["best"], r["tied"]) for r in out.collect()}
    assert got == {p: (-a[0], a[1], b[1] if b[0] <= -90 else None) for p, (a, b) in best.items()}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_grams_as_numbers_are_as_similar(spark):
    names = ["rio grande roofing", "rio grande roofs", "zz", "", None, "a1 b2", "b2 a1 a1"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    a, b = keys.trigrams(F.col("a")), keys.trigrams(F.col("b"))
    either, both = F.size(F.array_union(a, b)), F.size(F.array_intersect(a, b))
    plain, coded = F.when(either > 0, both / either).otherwise(0.0), keys.gram_similarity(keys.gram_codes(a), keys.gram_codes(b))
    assert pairs.where(~plain.eqNullSafe(coded)).count() == 0


def test_outcomes_are_counted_in_tasks_of_counted_rows(spark, monkeypatch):
    monkeypatch.setattr(reports, "TASK_ROWS", 100)
    outcome = F.element_at(F.array(*map(F.lit, ("attached", "tentative", "unmatched", "outside", "odd"))), (F.col("id") * 7 % 5 + 1).cast("int"))
    rows = spark.range(3_000).select((F.col("id") % 37).alias("run_id"), (F.col("id") % 11).alias("place_id"), F.when(F.col("id") % 13 > 0, outcome).alias("outcome"), F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("cluster_key"))
    runs = spark.range(40).select(F.col("id").alias("run_id"), F.array(F.lit("c3"), F.lit("c1"), F.lit("c9"), F.lit(None), F.lit("c1")).alias("cluster_keys"))
    clusters = spark.createDataFrame([("c1", "One", 2), ("c3", "Three", None), ("c9", "Nine", 1)], "cluster_key string, display_name string, sort_order int")
    out, of = reports.outcomes_by_cluster(runs, rows, clusters), {}
    for r in rows.collect():
        if r["outcome"] not in (None, "outside"):
            of.setdefault((r["run_id"], r["cluster_key"]), []).append(r["outcome"])
    order = [("c9", "Nine"), ("c1", "One"), ("c1", "One"), ("c3", "Three"), (None, None)]
    count = lambda run, key: (len(x := of.get((run, key), [])), *(x.count(o) for o in ("attached", "tentative", "unmatched")))
    assert {tuple(r) for r in out.collect()} == {(run, key, name, place, *count(run, key)) for run in range(40) for place, (key, name) in enumerate(order, 1)}
    assert out.rdd.getNumPartitions() == 31
    text = out._jdf.queryExecution().executedPlan().toString()
    counting = text[text.rindex("HashAggregate") :]
    assert "Exchange hashpartitioning" in counting and "31), REPARTITION_BY_NUM" in counting  # brought together, then counted
