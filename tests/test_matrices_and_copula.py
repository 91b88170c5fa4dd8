"""Matrix sums against numpy, and a copula that keeps marginals and rank correlations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloakframe.functions import gram
from cloakframe.operators import copula, stats, synth


def test_two_hundred_columns_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(0, 1, (500, 200)) @ rng.normal(0, 1, (200, 200)) + 1e6
    df = spark.createDataFrame(pd.DataFrame(values, columns=[f"v{i}" for i in range(200)])).repartition(5)
    got = {(r.a, r.b): r.correlation for r in stats.correlation_matrix(df).collect()}
    want = np.corrcoef(values, rowvar=False)
    assert len(got) == 200 * 201 // 2
    assert max(abs(got[f"v{i}", f"v{j}"] - want[i, j]) for i in range(200) for j in range(i, 200)) < 1e-5


def test_gaps_constants_and_empty_tables(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"a": rng.normal(0, 1, 300), "b": rng.normal(5, 2, 300), "c": np.ones(300), "d": rng.normal(0, 1, 300), "e": rng.normal(0, 1, 300)})
    frame.loc[rng.random(300) < 0.3, "b"] = np.nan
    frame.loc[rng.random(300) < 0.3, "d"] = np.nan
    # e is constant where d is there
    frame.loc[frame["d"].notna(), "e"] = 2.0
    df = spark.createDataFrame([tuple(None if x != x else float(x) for x in r) for r in frame.itertuples(index=False)], "a double, b double, c double, d double, e double").repartition(3)
    got = {(r.a, r.b): r.correlation for r in stats.correlation_matrix(df).collect()}
    want = frame.corr()
    for (a, b), r in got.items():
        if "c" in (a, b) or (a, b) == ("d", "e"):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=2e-6)
    with pytest.raises(stats.GuardError):
        stats.correlation_matrix(df.limit(0))
    assert gram.columns_summary(df.limit(0), [F.col("a")]) is None


def test_parts_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(gram, "FAN", 3)
    df = spark.range(1000).repartition(40).select(F.col("id").cast("double").alias("x"))
    total, high = gram.reduce_rows(df, [F.col("x")], [("sum", lambda x: x.sum(axis=0)), ("max", lambda x: x.max(axis=0))])
    assert (total[0], high[0]) == (499500.0, 999.0)


def ranks(v) -> np.ndarray:
    return pd.DataFrame(v).rank().corr().to_numpy()


def test_copula_keeps_marginals_and_rank_correlations(spark):
    rng = np.random.default_rng(5)
    n = 6000
    a = rng.gamma(2, 3, n)
    b = np.exp(0.8 * np.log(a) + rng.normal(0, 0.4, n))
    c = (-a / 3 + rng.normal(0, 1, n)).round().astype(int)
    gap = rng.random(n) < 0.2
    rows = [(f"p{i}", float(x), None if g else float(y), int(z), "uv"[i % 2]) for i, (x, y, z, g) in enumerate(zip(a, b, c, gap, strict=True))]
    df = spark.createDataFrame(rows, "patient_id string, a double, b double, c int, kind string")
    made = synth.synthesize(df, "copula", 7)
    assert made.columns == ["a", "b", "c", "kind"] and made.schema["c"].dataType == df.schema["c"].dataType
    got = made.toPandas()
    assert len(got) == n and abs(got["b"].isna().mean() - gap.mean()) < 0.02
    # Kolmogorov's distance of every marginal, and rank correlations
    for name, source in (("a", a), ("b", b[~gap]), ("c", c)):
        own, at = got[name].dropna().to_numpy(), np.quantile(source, np.linspace(0.01, 0.99, 99))
        assert max(abs((own <= x).mean() - (source <= x).mean()) for x in at) < 0.03
    want = ranks({"a": a, "b": np.where(gap, np.nan, b), "c": c})
    assert np.abs(ranks(got[["a", "b", "c"]].astype(float)) - want).max() < 0.04
    assert abs((got["kind"] == "u").mean() - 0.5) < 0.03
    # c has few values, and only those are drawn
    assert set(got["c"]) <= set(c.tolist())


def test_copula_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(x), float(x + y), None, float(i % 3)) for i, (x, y) in enumerate(rng.normal(0, 1, (3000, 2)))], "a double, b double, none double, d double")
    one, two = (synth.synthesize(df.repartition(p), "copula", 7).toPandas() for p in (1, 7))
    order = ["a", "b", "d"]
    pd.testing.assert_frame_equal(one.sort_values(order, ignore_index=True), two.sort_values(order, ignore_index=True))
    assert one["none"].isna().all() and not one["a"].equals(synth.synthesize(df, "copula", 8).toPandas()["a"])
    assert synth.synthesize(df.limit(0), "copula", 7).count() == 0


def test_knots_are_exact_ranks(spark, monkeypatch):
    monkeypatch.setattr(copula, "KNOTS", 20)
    values = [float(i * i % 1009) for i in range(1009)]
    m = copula.marginal(spark.createDataFrame([(v,) for v in values] + [(None,)] * 10, "v double"), "v")
    assert not m.whole and len(m.values) <= 20 and (m.values[0], m.values[-1]) == (min(values), max(values))
    assert [round(u * 1009) for u in m.upto] == [sum(x <= v for x in values) for v in m.values] and m.nulls == pytest.approx(10 / 1019)


def test_all_seeds_run_in_the_same_jobs(spark):
    from cloakframe.operators import audit, experiments

    rng = np.random.default_rng(8)
    rows = [(f"n{i}", int(rng.integers(20, 30)), None if i % 9 == 0 else float(rng.integers(0, 5)), "xyz"[i % 3]) for i in range(80)]
    df = spark.createDataFrame(rows, "name string, age int, score double, city string")
    roles = {"age": "quasi_identifier", "city": "quasi_identifier"}
    sc, jobs = spark.sparkContext, {}
    for seeds in ([7], [7, 17, 27, 37]):
        sc.setJobGroup(f"seeds-{len(seeds)}", "seeds")
        got = {r.seed: r.metrics for r in experiments.run_seed_suite(df, "e", seeds, roles=roles).collect()}
        jobs[len(seeds)] = len(sc.statusTracker().getJobIdsForGroup(f"seeds-{len(seeds)}"))
        assert set(got) == set(seeds)
    # re-planning at runtime may split a job or not
    assert jobs[4] <= jobs[1] + 3
    for seed in (7, 37):
        one = audit.audit_release(df, synth.synthesize(df, "demo", seed, roles), roles=roles).first()
        want = {k: float(one[k]) for k in ("exact_row_overlap", "identifier_overlap", "quasi_combo_overlap", "rare_quasi_overlap", "near_copy_rate")} | {"audit_passed": float(one["passed"])}
        assert dict(got[seed]) == want
    both = synth.synthesize_seeds(df, "copula", [1, 2], {})
    for seed in (1, 2):
        order = ["age", "score", "city"]
        apart = synth.synthesize(df, "copula", seed).toPandas().sort_values(order, ignore_index=True)
        pd.testing.assert_frame_equal(both.where(f"__seed = {seed}").drop("__seed").toPandas().sort_values(order, ignore_index=True), apart)
