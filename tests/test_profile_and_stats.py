"""Profiles, statistics and their guards."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cloakframe.operators import profile, stats
from cloakframe.operators.profile import PROFILES


def test_names_give_roles(spark):
    df = spark.createDataFrame([(1, 2, 3, 4.0, 5, "x")], "participant_id int, mrn int, account_number int, measurement double, age int, PHQ string")
    roles = {r.name: r.role for r in profile.classify_columns(df).collect()}
    assert roles == {"participant_id": "identifier", "mrn": "identifier", "account_number": "identifier", "measurement": "general", "age": "quasi_identifier", "PHQ": "sensitive"}
    assert roles == {c: profile.role_of(c) for c in df.columns}


def test_profile_counts_and_free_text(spark):
    df = spark.createDataFrame([(1, "a", "t" * 70), (2, "a", "t" * 80), (None, None, None)], "x int, kind string, notes string")
    rows = {r.name: r for r in profile.profile_table(df).collect()}
    assert (rows["x"].non_null, rows["x"].unique, rows["x"].unique_ratio) == (2, 2, 1.0)
    assert rows["notes"].role == "free_text" and rows["kind"].role == "general" and rows["kind"].unique_ratio == 0.5
    counts = {r.role: r.columns for r in profile.role_counts(profile.profile_table(df)).collect()}
    assert counts == {"identifier": 0, "quasi_identifier": 0, "sensitive": 0, "general": 2, "free_text": 1}
    assert profile.profile_table(df.limit(0)).count() == 3


def test_identifiers_are_dropped(spark):
    df = spark.createDataFrame([(1, "n", 2)], "c_custkey int, c_name string, age int")
    assert profile.drop_identifiers(df).columns == ["c_custkey", "age"]
    assert profile.drop_identifiers(df, {"c_custkey": "identifier", "c_name": "general"}).columns == ["c_name", "age"]


def test_describe_reports_safe_columns_and_refuses_small_tables(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "participant_id int, score double")
    rows = stats.describe_numeric(df).collect()
    assert [(r.name, r.n_rows, r.n, r.mean, r.min, r.max) for r in rows] == [("score", 10, 10, 4.5, 0.0, 9.0)]
    assert math.isclose(rows[0]["std"], np.std(range(10), ddof=1))
    with pytest.raises(stats.GuardError):
        stats.describe_numeric(df.limit(3))


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(12)], "a double, b double, c double")
    got = {(r.a, r.b): r.correlation for r in stats.correlation_matrix(df).collect()}
    assert got[("a", "b")] == 1.0 and got[("a", "c")] is None and len(got) == 6


def test_correlations_with_gaps_equal_numpy(spark):
    rnd = random.Random(2)
    rows = [tuple(None if rnd.random() < g else rnd.gauss(1e6, 1) + i * 0.01 for g in (0, 0, 0.2, 0.3)) + (None,) for i in range(200)]
    got = {(r.a, r.b): r.correlation for r in stats.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double, e double")).collect()}
    v = np.array([r[:4] for r in rows], float)
    for i, j in ((0, 1), (0, 2), (2, 3), (2, 2), (0, 0)):
        both = ~np.isnan(v[:, i]) & ~np.isnan(v[:, j])
        assert abs(got[("abcd"[i], "abcd"[j])] - np.corrcoef(v[both, i], v[both, j])[0, 1]) < 1e-5
    assert got[("a", "e")] is None and got[("e", "e")] is None


def test_medians(spark):
    from cloakframe.functions import ranges

    rnd = random.Random(3)
    for n in (1, 2, 7, 300, 301):
        values = [float(rnd.randrange(n)) for _ in range(n)]
        assert ranges.exact_median(spark.createDataFrame([(v,) for v in [*values, None]], "x double"), "x") == np.median(values)
    assert ranges.exact_median(spark.createDataFrame([(None,)], "x double"), "x") is None


def test_small_groups_are_left_out(spark):
    df = spark.createDataFrame([("A", i) for i in range(4)] + [("B", i) for i in range(6)], "group string, score int")
    assert [(r.group, r.n) for r in stats.group_summary(df, "group", "score").collect()] == [("B", 6)]
    with pytest.raises(stats.GuardError):
        stats.group_summary(df, "group", "group")


def test_ols_against_numpy(spark):
    rnd = random.Random(1)
    rows = [(float(i), rnd.choice(["x", "y", "z"]), rnd.gauss(0, 1)) for i in range(60)]
    rows = [(a, g, 3 + 0.5 * a + {"x": 0, "y": 2, "z": -1}[g] + e) for a, g, e in rows]
    got = {r.term: r for r in stats.ols(spark.createDataFrame(rows, "a double, g string, y double"), "y", ["a", "g"]).collect()}
    x = np.array([[1, a, g == "y", g == "z"] for a, g, _ in rows], float)
    y = np.array([r[2] for r in rows])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    residual = y - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (residual @ residual) / 56)
    for term, b, s in zip(["const", "a", "g[y]", "g[z]"], beta, se, strict=True):
        assert math.isclose(got[term].coef, b, rel_tol=1e-8) and math.isclose(got[term].se, s, rel_tol=1e-8)
    assert math.isclose(got["a"].r2, 1 - residual @ residual / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9)


def test_student_quantiles():
    for degrees, value in ((1, 12.7062), (5, 2.5706), (30, 2.0423), (1000, 1.9623)):
        assert abs(stats.t_quantile(0.975, degrees) - value) < 1e-3
        assert abs(stats.t_two_sided(stats.t_quantile(0.975, degrees), degrees) - 0.05) < 1e-9


def test_rare_levels_forbid_a_predictor(spark):
    df = spark.createDataFrame([("a", 1.0)] * 9 + [("b", 2.0)] * 2, "g string, y double")
    assert not stats.rare_level_guard(df, "g").first()["allowed"]
    with pytest.raises(stats.GuardError):
        stats.ols(df, "y", ["g"])


def test_release_view_hides_counts_and_extrema(spark):
    rows = [("score", 13, 13, 2.34567, 0.87654, 0.0, 9.0), ("sparse", 13, 3, 1.0, 1.0, 0.0, 1.0)]
    described = spark.createDataFrame(rows, "name string, n_rows bigint, n bigint, mean double, std double, min double, max double")
    got = stats.release_safe_describe(described, 5, 5).collect()
    assert [tuple(r) for r in got] == [("score", "10-19", "10-19", 2.35, 0.88)]
    with pytest.raises(stats.GuardError):
        stats.release_safe_describe(described, 100, 10)


def test_aggregates_with_identifiers_are_refused(spark):
    fine = spark.createDataFrame([("A", 1.234567890123)], "g string, mean double")
    assert stats.aggregate_pii_guard(fine) is fine
    with pytest.raises(stats.GuardError) as e:
        stats.aggregate_pii_guard(spark.createDataFrame([("jo@example.org", 1.0)], "g string, mean double"))
    assert "jo@" not in str(e.value)
    with pytest.raises(stats.GuardError):
        stats.aggregate_pii_guard(spark.createDataFrame([(1.0,)], "`jo@example.org` double"))


def test_profiles():
    assert (PROFILES["clinical"].min_dataset, PROFILES["clinical"].min_group, PROFILES["enterprise"].max_near_copy) == (30, 10, 0.015)
