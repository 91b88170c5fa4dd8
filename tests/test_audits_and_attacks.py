"""Audits, attacks and synthesis on small tables with expected values, and what their plans must not hold."""

from __future__ import annotations

import math
import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakframe.functions import blocks
from cloakframe.functions.ranges import place_of
from cloakframe.operators import attacks, audit, experiments, synth
from cloakframe.operators.profile import PrivacyProfile


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ladder(spark):
    return spark.createDataFrame([(i, 20 + i % 3, float(i)) for i in range(10)], "participant_id int, age int, score double")


def test_copying_the_source_is_found(ladder):
    got = audit.audit_release(ladder, ladder).first()
    assert got["reason_codes"][:4] == ["backend_not_approved", "profile_disallows_row_level", "exact_row_overlap", "identifier_overlap"]
    assert (got["exact_row_overlap"], got["identifier_overlap"], got["quasi_combo_overlap"], got["near_copy_rate"], got["passed"]) == (10, 10, 3, 1.0, False)


def test_a_clean_table_passes(ladder, spark):
    other = spark.createDataFrame([(900 + i, 60 + i, 500.0 + 9 * i) for i in range(10)], ladder.schema)
    got = audit.audit_release(ladder, other, True, PrivacyProfile("own", 10, 5, 5, 0.01, True)).first()
    assert got["passed"] and got["reason_codes"] == [] and got["near_copy_rate"] == 0.0


def test_overlaps_treat_nulls_as_equal(spark):
    a = spark.createDataFrame([(None, "x"), (1, None), (1, None), (2, "<NA>")], "age int, city string")
    b = spark.createDataFrame([(None, "x"), (2, None), (3, "q")], "age int, city string")
    assert audit.exact_row_overlap(a, b).first()[0] == 2
    assert audit.rare_quasi_overlap(a, b, 2).first()[0] == 2
    assert audit.identifier_overlap(a, b).first()[0] == 0


def test_near_copies_by_brute_force(spark):
    rnd = random.Random(1)
    raw = [(rnd.gauss(0, 1), rnd.gauss(5, 2), None if rnd.random() < 0.1 else rnd.gauss(0, 3)) for _ in range(80)]
    syn = [tuple(None if v is None else v + rnd.gauss(0, 0.05) for v in rnd.choice(raw)) for _ in range(40)] + [(9.0, 9.0, 9.0)] * 3
    columns = ["a", "b", "c"]
    schema = "a double, b double, c double"
    got = audit.near_copy_rate(spark.createDataFrame(raw, schema), spark.createDataFrame(syn, schema), columns)
    assert "NestedLoop" not in plan_of(got).replace("BroadcastNestedLoopJoin BuildRight, Cross", "") and "CartesianProduct" not in plan_of(got)
    import numpy as np

    r, s = np.array(raw, float), np.array(syn, float)
    middle = np.nanmedian(r, axis=0)
    r, s = np.where(np.isnan(r), middle, r), np.where(np.isnan(s), middle, s)
    z = lambda x: (x - r.mean(axis=0)) / r.std(axis=0)
    near = np.linalg.norm(z(s)[:, None] - z(r)[None], axis=2).min(axis=1) < 0.05 * math.sqrt(3)
    assert got.first()[0] == round(near.mean(), 6)
    assert audit.near_copy_rate(spark.createDataFrame([("x",)], "t string"), spark.createDataFrame([("x",)], "t string")).first()[0] is None


def test_k_anonymity(spark):
    df = spark.createDataFrame([(20, "A")] * 2 + [(21, "B")] + [(22, "C")] * 3, "age int, city string")
    assert tuple(attacks.k_anonymity(df, ["age", "city"], 3).first()) == (6, 1, 1, 0.166667, 3, 0.5, 3)
    assert tuple(attacks.k_anonymity(df.limit(0), ["age"], 3).first()) == (0, 0, 0, 0.0, 0, 0.0, 0)
    with pytest.raises(ValueError):
        attacks.k_anonymity(df, ["age"], 1)


def test_unique_linkage(spark):
    target = spark.createDataFrame([(20, "A"), (21, "B"), (None, "C")], "age int, city string")
    aux = spark.createDataFrame([(20, "A"), (21, "B"), (21, "B"), (40, "Z")], "age int, city string")
    assert tuple(attacks.unique_linkage(target, aux, ["age", "city"]).first()) == (3, 1, 0.333333)


def test_attribute_inference(spark):
    syn = spark.createDataFrame([("20s", "A", "x"), ("30s", "B", "y"), ("40s", "C", "z")], "band string, city string, diagnosis string")
    got = attacks.attribute_inference(syn, syn, ["band", "city"], "diagnosis").first()
    assert (got["coverage"], got["accuracy"], got["baseline_accuracy"], got["material"]) == (1.0, 1.0, 0.333333, True)
    away = spark.createDataFrame([("60s", "Q", "x")], syn.schema)
    got = attacks.attribute_inference(syn, away, ["band", "city"], "diagnosis").first()
    assert got["coverage"] == 0.0 and got["accuracy"] is None and not got["material"]


def test_longitudinal_linkage(spark):
    early = spark.createDataFrame([(i, 1980 + i, "A") for i in range(4)], "person bigint, birth int, city string")
    got = attacks.longitudinal_linkage(early, early, ["birth", "city"], "person").first()
    assert (got["linkage_rate"], got["precision"], got["elevated"]) == (1.0, 1.0, True)
    got = attacks.longitudinal_linkage(early, early, ["city"], "person").first()
    assert (got["linkage_rate"], got["precision"]) == (0.0, None)


def test_fuzzy_linkage_is_a_band_join(spark):
    early = spark.createDataFrame([(1, "A", 30, 50.0), (2, "A", 40, 70.0), (3, "B", None, 10.0), (4, "B", 30, 10.0)], "person bigint, city string, age int, score double")
    late = spark.createDataFrame([(1, "A", 31, 54.0), (2, "A", 39, 66.0), (3, "B", None, 10.0), (4, "B", 30, 20.0)], early.schema)
    out = attacks.fuzzy_longitudinal_linkage(early, late, ["city"], {"age": 1, "score": 5}, "person")
    got = out.first()
    assert (got["unique_matches"], got["correct_matches"], got["precision"]) == (2, 2, 1.0)
    exact = attacks.fuzzy_longitudinal_linkage(early, late, ["city"], {"age": 0}, "person").first()
    assert exact["unique_matches"] == 1
    wide = attacks.fuzzy_longitudinal_linkage(early, late, ["city"], {"age": 100}, "person").first()
    assert wide["unique_matches"] == 1
    with pytest.raises(ValueError):
        attacks.fuzzy_longitudinal_linkage(early, late, ["city"], {"age": -1}, "person")


@pytest.mark.parametrize("columns", [["a"], ["a", "b"], ["b", "a", "c"]])
def test_nearest_distance_by_brute_force(spark, columns, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    rnd = random.Random(2)
    made = lambda n, at: [(i, rnd.gauss(at, 3), float(rnd.randrange(3)), rnd.random()) for i in range(n)]
    left, right = made(60, 0), made(90, 1)
    schema = "id bigint, a double, b double, c double"
    pick = lambda r: [r["abc".index(c) + 1] for c in columns]
    got = {r.id: r.distance for r in attacks.nearest_distance(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), columns, "id").collect()}
    assert len(got) == 60
    for r in left:
        assert math.isclose(got[r[0]], min(math.dist(pick(r), pick(s)) for s in right), abs_tol=1e-12)


@pytest.mark.parametrize("small", [0, 6, 256])
def test_crowded_bins_by_brute_force(spark, monkeypatch, small):
    """A third of all rows share one value: they meet in blocks, and no join makes their pairs; small bins are lists."""
    monkeypatch.setattr(blocks, "BLOCK", 7)
    monkeypatch.setattr(blocks, "SMALL", small)
    rnd = random.Random(5)
    value = lambda: 5.0 if rnd.random() < 0.4 else round(rnd.uniform(0, 40), 1)
    made = lambda n: [(i, "AB"[i % 2], value(), None if i == 3 else value()) for i in range(n)]
    early, late = made(90), made(80)
    schema = "person bigint, city string, x double, y double"
    out = attacks.fuzzy_longitudinal_linkage(spark.createDataFrame(early, schema), spark.createDataFrame(late, schema), ["city"], {"x": 1.5, "y": 4.0}, "person")
    assert "NestedLoop" not in plan_of(out).replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    unique = correct = 0
    for p, c, x, y in early:
        hits = [q for q, d, u, v in late if c == d and None not in (y, v) and abs(x - u) <= 1.5 and abs(y - v) <= 4.0]
        unique += len(hits) == 1
        correct += hits == [p]
    got = out.first()
    assert (got["unique_matches"], got["correct_matches"]) == (unique, correct)
    raw, syn = [(x, y or 0.0) for _, _, x, y in early], [(x, y or 0.0) for _, _, x, y in late]
    import numpy as np

    r, s = np.array(raw), np.array(syn)
    z = lambda v: (v - r.mean(axis=0)) / r.std(axis=0)
    near = np.linalg.norm(z(s)[:, None] - z(r)[None], axis=2).min(axis=1) < 0.05 * math.sqrt(2)
    assert audit.near_copy_rate(spark.createDataFrame(raw, "x double, y double"), spark.createDataFrame(syn, "x double, y double"), ["x", "y"]).first()[0] == round(near.mean(), 6)


def test_equal_rows_of_a_bin_are_counted_not_gathered(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(blocks, "meet", lambda left, right, *a, f=blocks.meet, **k: (seen.append((left.count(), right.count())), f(left, right, *a, **k))[1])
    late = spark.range(20_000).select(F.lit("p").alias("person"), F.lit("A").alias("city"), F.lit(5.0).alias("x"))
    early = late.limit(300).unionByName(spark.createDataFrame([("q", "A", 8.0), ("r", "B", 5.0)], late.schema))
    more = late.unionByName(spark.createDataFrame([("q", "A", 9.5), ("z", "C", 5.0)], late.schema))
    got = attacks.fuzzy_longitudinal_linkage(early, more, ["city"], {"x": 2.0}, "person").first()
    assert (got["earlier_rows"], got["unique_matches"], got["correct_matches"]) == (302, 1, 1)
    # the bins of 5.0 are crowded: one row stands for the 20,000, and one for the 300
    assert seen and all(left <= 6 and right <= 6 for left, right in seen)


def test_small_bins_make_no_python_groups_and_no_pairs(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    out = attacks.fuzzy_longitudinal_linkage(c, c, ["c_nationkey"], {"c_acctbal": 20.0}, "c_custkey")
    plan = plan_of(out)
    assert "Arrow" not in plan and "NestedLoopJoin BuildRight, Inner" not in plan


def test_no_column_name_clashes(spark):
    names = ["n", "count", "k0", "v", "rows", "correct", "entity", "found", "bin", "near", "hits"]
    rows = [tuple(str(i * (k + 1) % 7) for k in range(len(names))) for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    classes = {r[:3]: sum(x[:3] == r[:3] for x in rows) for r in rows}
    assert attacks.k_anonymity(df, names[:3]).first()["classes"] == len(classes)
    assert attacks.unique_linkage(df, df.limit(3), names).first()["target_rows"] == 40
    assert attacks.attribute_inference(df, df, names[:5], "rows").first()["accuracy"] == 1.0
    assert attacks.longitudinal_linkage(df, df.dropDuplicates(), names[:4], "entity").first()["precision"] == 1.0
    assert attacks.fuzzy_longitudinal_linkage(df, df.dropDuplicates(), ["n", "near"], {"bin": 0.0}, "entity").first()["precision"] == 1.0
    assert audit.rare_quasi_overlap(df, df, 1000, names).first()[0] == len(set(rows))


def test_auc_with_ties(spark):
    rnd = random.Random(3)
    rows = [(float(rnd.randrange(12)), rnd.random() < 0.4) for _ in range(200)]
    got = attacks.pairwise_auc(spark.createDataFrame(rows, "s double, m boolean"), "s", "m")
    pairs = [(a > b) + (a == b) / 2 for (a, m), (b, h) in product(rows, rows) if m and not h]
    assert got.first()[0] == round(sum(pairs) / len(pairs), 6)


def test_membership_and_ensemble(spark):
    of = lambda a, b: spark.createDataFrame([(i, float(i), float(i), float(i * 7 % 3)) for i in range(a, b)], "id bigint, x double, y double, n double")
    members, holdout = of(0, 4), of(10, 14)
    got = attacks.membership_auc(members, holdout, members, ["x", "y"], "id").first()
    assert got["auc"] == 1.0 and got["interpretation"] == "elevated"
    every = attacks.ensemble_membership(members, holdout, members, ["x", "y", "n"], "id")
    summary = attacks.ensemble_summary(every).first()
    assert summary["attacks"] == 7 and summary["max_auc"] == 1.0 and summary["best_columns"] == "x"
    assert attacks.attack_subsets(["a", "b", "c", "d"], 2, 2) == [["a"], ["a", "b", "c", "d"]]


def test_synthesis_depends_on_keys_not_on_partitions(spark):
    df = spark.createDataFrame([(i, f"n{i}", "xyz"[i % 3], i / 7, None, i) for i in range(60)], "row_id bigint, name string, kind string, v double, gone double, age int")
    # means are sums of doubles, whose last bits follow the order of the rows
    rows = lambda d, seed: sorted((r[0], r[1], r[2], round(r[3], 9), r[4], r[5]) for r in synth.synthesize_table(d, seed).collect())
    one = rows(df, 7)
    assert one == rows(df.repartition(7), 7) and one != rows(df, 8) and len(one) == 60
    assert {r[2] for r in one} <= set("xyz") and all(r[4] is None for r in one) and all(-3 <= r[5] <= 62 for r in one)
    assert not {r[1] for r in one} & {f"n{i}" for i in range(60)}
    synth.register_synthesizer(synth.Synthesizer("seen", lambda d, s: d))
    assert "name" not in synth.synthesize(df, "seen").columns
    with pytest.raises(KeyError):
        synth.synthesize(df, "missing")


def test_splits_and_drift(spark):
    df = spark.range(1000)
    halves = synth.split_members_holdout(df, "id").groupBy("member").count().collect()
    assert all(420 < r["count"] < 580 for r in halves)
    assert [r.id for r in synth.drift_snapshot(df.limit(3), {"id": (5, 6)}).collect()] == [5, 6, 6]


def test_experiments(spark):
    runs = spark.createDataFrame([("e", 1.0, {"auc": 0.4}), ("e", 3.0, {"auc": 0.6}), ("f", 1.0, {})], "experiment_id string, duration_seconds double, metrics map<string,double>")
    got = {(r.experiment_id, r.metric): r for r in experiments.aggregate_runs(runs).collect()}
    assert got[("e", "auc")]["mean"] == 0.5 and got[("e", "duration_seconds")]["mean"] == 2.0 and got[("f", "duration_seconds")]["sd"] == 0.0
    results = spark.createDataFrame([("membership-v0", {"auc": 0.5, "x": 1.0}), ("own", {c: 1.0 for c in "abcde"})], "benchmark string, metrics map<string,double>")
    assert sorted((r.benchmark, r.metric) for r in experiments.comparison_table(results).collect()) == [("membership-v0", "auc"), *[("own", c) for c in "abcd"]]
    said = [("ledger", "deny", "deny"), ("ledger", "allow", "allow"), ("folder", "deny", "allow"), ("folder", "allow", "allow")]
    got = {r.baseline: (r.attack_success_rate, r.authorised_success_rate, r.accuracy) for r in experiments.boundary_summary(spark.createDataFrame(said, "baseline string, expected string, observed string")).collect()}
    assert got == {"ledger": (0.0, 1.0, 1.0), "folder": (1.0, 1.0, 0.5)}
    table = spark.createDataFrame([(i % 5, float(i)) for i in range(25)], "age int, v double")
    assert [r.seed for r in experiments.run_seed_suite(table, "demo", [7, 17]).collect()] == [7, 17]
    with pytest.raises(ValueError):
        experiments.run_seed_suite(table, "demo", [7, 7])
    assert experiments.suite_problems("s", [1, 2], [{"id": "a"}, {"id": "b", "rows": 30}]) == []
    assert experiments.suite_problems(" ", [True, 1.5], [{"id": "a"}, {"id": "a", "kind": "x", "rows": 3}, {}]) == ["no_suite_name", "seed_not_whole", "experiment_without_id", "experiment_id_repeated", "unknown_kind", "too_few_rows"]
    assert experiments.run_suite({"t": table}, "s", [7], [{"id": "a", "table": "t"}]).first()["metrics"]["audit_passed"] == 0.0
    with pytest.raises(ValueError):
        experiments.run_suite({"t": table}, "s", [], [{"id": "a", "table": "t"}])


def test_fuzzy_linkage_query_equals_its_sql_without_single_matches(spark, tmp_path):
    """Every customer twice: nothing matches once, and the SQL's sum over no rows is null."""
    import duckdb

    from cloakframe.plans import attack_plans, base

    twice = spark.range(40).selectExpr("id as c_custkey", "cast(id % 5 as int) as c_nationkey", "'A' as c_mktsegment", "cast(id % 20 as double) as c_acctbal")
    twice.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(base.SQL["f15_fuzzy_longitudinal_linkage"]).fetchall()
    assert [tuple(r) for r in attack_plans.f15_fuzzy_longitudinal_linkage(spark, str(tmp_path)).collect()] == want == [(40, 0, None, 0.0, None, False)]


def test_sides_that_grow_with_the_table_are_never_broadcast(spark):
    """However few bytes they take shuffled: seeds' audits and single audits share the step."""
    raw = spark.createDataFrame([(i, f"u{i}", i % 3) for i in range(60)], "user_id int, email string, age int")
    syn = spark.createDataFrame([(1, i, f"u{i}", i % 2) for i in range(30, 90)], "seed int, user_id int, email string, age int")
    made = syn.drop("seed")
    tagged = audit.shared_by_tag(raw.toDF("k0", "k1", "k2"), syn.toDF("seed", "k0", "k1", "k2"), "seed", "n")
    found = {"exact": audit.exact_row_overlap(raw, made), "identifier": audit.identifier_overlap(raw, made), "combo": audit.quasi_combo_overlap(raw, made), "tagged": tagged.select("n")}
    same = sum(i % 3 == i % 2 for i in range(30, 60))
    assert {k: df.first()[0] for k, df in found.items()} == {"exact": same, "identifier": 60, "combo": 2, "tagged": same}
    for df in found.values():
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pairs_of_blocks_are_dealt_by_number_and_ranges_are_cut_by_the_finest_component(spark, monkeypatch):
    """Few bytes are not merged into one task with all their pairs; a component of two values does not order the ranges."""
    import pyarrow as pa

    side = lambda: spark.range(400).select((F.col("id") % 40).alias("k"), "id")
    test = lambda a, b: pa.table({"n": pa.array([len(a) * len(b)], pa.int64())})
    met = blocks.meet(side(), side(), ["k"], test, "n bigint").withColumn("task", F.spark_partition_id()).collect()
    assert [r.n for r in met] == [100] * 40 and len({r.task for r in met}) == 4
    seen, put = [], attacks.nearest_vectors
    monkeypatch.setattr(attacks, "nearest_vectors", lambda asked, ref: seen.append(ref) or put(asked, ref))
    rows = spark.range(60).select("id", (F.col("id") % 2).alias("a"), (F.col("id") * 7 % 31).alias("b"))
    parts = [rows.where(F.col("id") % 3 == i) for i in range(3)]
    found = attacks.ensemble_membership(*parts, ["a", "b"], "id").collect()
    assert [r.columns for r in sorted(found)] == ["a", "b", "a,b"]
    assert {r.tag: r.n for r in seen[0].groupBy("tag").agg(F.count_distinct("p").alias("n")).collect()} == {0: 2, 1: 20, 2: 20}


def test_nearest_in_a_block_compares_neighbours_not_all_pairs(monkeypatch):
    rng, made = np.random.default_rng(4), []
    sides = []
    for n in (6000, 8000):
        v = np.column_stack([rng.integers(0, 25, n).astype(float), np.round(rng.uniform(-1, 1, n), 4)])
        v[:40] = v[0]
        sides.append(pa.table({"tag": [0] * n, "v": list(v), "p": v[:, 1], "r": [0] * n, "u": [math.inf] * n}))
    shapes = np.broadcast_shapes
    monkeypatch.setattr(attacks.np, "broadcast_shapes", lambda *s: made.append(math.prod(shapes(*s)[:2])) or shapes(*s))
    got = attacks.nearest_in(*sides).column("d").to_numpy()
    x, y = (np.array(s.column("v").to_pylist()) for s in sides)
    assert np.array_equal(got, [np.sqrt(((y - one) ** 2).sum(axis=1).min()) for one in x])
    assert 0 < sum(made) < 6000 * 8000 / 8
    # none beside, one beside, and what is known already
    assert np.isinf(attacks.nearest_in(sides[0], sides[1].slice(0, 0)).column("d").to_numpy()).all()
    assert np.allclose(attacks.nearest_in(sides[0], sides[1].slice(0, 1)).column("d").to_numpy(), [math.dist(one, y[0]) for one in x])
    known = sides[0].set_column(4, "u", pa.array([0.0] * len(x)))
    assert not attacks.nearest_in(known, sides[1]).column("d").to_numpy().any()


def test_nearest_leaves_out_vectors_with_gaps(spark):
    rows = lambda *x: spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "id bigint, a double, b double")
    asked, held = rows((0.0, 1.0), (5.0, 1.0), (None, 1.0)), rows((None, 1.0), (1.0, 1.0), (math.nan, 1.0), (4.5, None))
    got = {r.id: r.distance for r in attacks.nearest_distance(asked, held, ["b", "a"], "id").collect()}
    assert got == {0: 1.0, 1: 4.0, 2: None}
    assert {r.distance for r in attacks.nearest_distance(asked, held.limit(0), ["a"], "id").collect()} == {None}


def test_place_among_many_bounds(spark):
    lists = [sorted(random.Random(3).sample(range(1000), 200)), [], [5.0], list(range(64))]
    df = spark.range(400).select((F.col("id") % 4).cast("int").alias("k"), (F.col("id") * 2.6 - 10).alias("x"))
    for r in df.select("k", "x", place_of(F.col("x"), [list(map(float, x)) for x in lists], F.col("k")).alias("r")).collect():
        assert r.r == sum(b <= r.x for b in lists[r.k])
