"""Merged sketches against exact profiles; hashed nearest neighbours against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import blocks
from cloakframe.operators import attacks, sketches


def test_any_parts_merge_to_their_whole(spark):
    rnd = random.Random(1)
    rows = [(None if i % 11 == 0 else "abc"[i % 3], f"u{rnd.randrange(3000)}" if i % 7 else None, rnd.gauss(0, 1) if i % 5 else float("nan"), i % 2 == 0) for i in range(12_000)]
    df = spark.createDataFrame(rows, "part string, name string, n double, p0 boolean").repartition(6)
    stored = sketches.column_sketches(df, F.col("part"))
    assert stored.select("part").distinct().count() == 4 and stored.count() == 16
    for wanted in (["a", "b", "c", None], ["a"], ["b", None]):
        keep = [r for r in rows if r[0] in wanted]
        some = stored.where(F.coalesce(F.col("part")["p0"], F.lit("none")).isin([w or "none" for w in wanted]))
        got = {r.name: r for r in sketches.estimates(sketches.merged(some), (0.1, 0.5)).collect()}
        for i, c in enumerate(df.columns):
            there = [r[i] for r in keep if r[i] is not None]
            exact = len({str(x) for x in there})
            assert (got[c].n, got[c].non_null) == (len(keep), len(there)) and abs(got[c].unique - exact) <= 0.03 * exact
        ranked = sorted(r[2] for r in keep if r[2] == r[2])
        for q, v in zip((0.1, 0.5), got["n"].quantiles, strict=True):
            assert abs(sum(x <= v for x in ranked) / len(ranked) - q) < 0.02
        assert got["p0"].quantiles is None and got["name"].quantiles[1] in (4.0, 5.0)
    empty = sketches.column_sketches(df.limit(0), F.col("part"))
    assert empty.count() == sketches.estimates(sketches.merged(empty)).count() == 0


def test_sketches_need_one_pass(spark):
    df = spark.range(10).select(*[F.col("id").alias(f"c{i}") for i in range(30)])
    plan = sketches.column_sketches(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Range (") == 1


@pytest.mark.parametrize("small", [0, 256])
def test_hashed_nearest_has_high_recall(spark, monkeypatch, small):
    monkeypatch.setattr(blocks, "SMALL", small)
    monkeypatch.setattr(blocks, "BLOCK", 64)
    rnd = random.Random(2)
    point = lambda: [rnd.gauss(0, 4), rnd.gauss(0, 1), float(rnd.randrange(4))]
    left, right = [(i, *point()) for i in range(300)], [(i, *point()) for i in range(500)]
    left += [(900, 500.0, 0.0, 0.0), (901, None, 1.0, 1.0)]
    schema = "id bigint, a double, b double, c double"
    one, two = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = {r.id: r.distance for r in attacks.nearest_distance(one, two, ["a", "b", "c"], "id", approximate=True).collect()}
    assert set(got) == {r[0] for r in left} and got[901] is None
    exact = {r[0]: min(math.dist(r[1:], s[1:]) for s in right) for r in left if None not in r}
    assert all(got[i] >= d - 1e-9 for i, d in exact.items())
    assert sum(math.isclose(got[i], d, abs_tol=1e-9) for i, d in exact.items()) >= 0.9 * len(exact)
    # far from all: alone in its buckets, so searched exactly
    assert math.isclose(got[900], exact[900])
    assert attacks.nearest_distance(one.limit(0), two, ["a"], "id", approximate=True).count() == 0
    assert attacks.nearest_distance(one.limit(2), two.limit(0), ["a"], "id", approximate=True).where("distance is not null and distance < double('inf')").count() == 0


def test_json_is_opened_level_by_level(spark):
    import json

    from cloakframe.operators import pii as scans

    rnd = random.Random(4)

    def value(depth: int):
        kind = rnd.randrange(6 if depth else 3)
        if kind < 2:
            return rnd.choice(["a@x.org", "é\"q", "", "t\n"])
        if kind == 2:
            return rnd.choice([1, 2.5, None, True, 123456789012])
        if kind < 5:
            return {f"k{i}": value(depth - 1) for i in range(rnd.randrange(3))}
        return [value(depth - 1) for _ in range(rnd.randrange(3))]

    def walk(x) -> list[str]:
        if isinstance(x, str):
            return [x]
        if isinstance(x, dict):
            return [t for k, v in x.items() for t in [k, *walk(v)]]
        return [t for v in x for t in walk(v)] if isinstance(x, list) else []

    made = [value(6) for _ in range(150)]
    texts = [json.dumps(m) for m in made] + ["not json a@x.org", "{broken", "", None, '"alone"', "12"]
    want = sorted([t for m in made for t in walk(m)] + ["not json a@x.org", "{broken", "alone"])
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    assert sorted(r.text for r in scans.json_texts(df, "value").collect()) == want
    assert "Python" not in scans.json_texts(df, "value")._jdf.queryExecution().executedPlan().toString()
    assert scans.json_texts(df.limit(0), "value").count() == 0


def test_files_are_digested_through_a_window(spark, tmp_path, monkeypatch):
    import hashlib

    from cloakframe.sources import tables

    rnd, want = random.Random(5), {}
    for i, size in enumerate((0, 1, 1000, 9 << 20)):
        path = tmp_path / "in" / f"d {i}#%41" / f"f{i}.bin"
        path.parent.mkdir(parents=True)
        content = rnd.randbytes(size)
        path.write_bytes(content)
        want[f"d {i}#%41/f{i}.bin"] = (hashlib.sha256(content).hexdigest(), size)
    got = {r.path: (r.sha256, r.bytes) for r in tables.artifact_digests(spark, f"{tmp_path}/in").collect()}
    assert got == want


def test_fallback_is_staged_and_sets_are_whole(spark, tmp_path):
    from cloakframe.operators import release

    df = spark.createDataFrame([(float(i), f"g{i % 3}") for i in range(40)], "score double, arm string")
    out = release.resolve_release(df, False, folder=f"{tmp_path}/r").collect()
    assert [r.status for r in out] == ["READY"] and spark.read.json(f"{tmp_path}/r/payload").count() == 1
    manifest = spark.read.json(f"{tmp_path}/r/manifest").first()
    assert manifest.allow_after_final_scan and manifest.release_class == "aggregate"
    files = spark.createDataFrame([(f"f{i}", "ab" * 32, i) for i in range(5)], "path string, sha256 string, bytes bigint")
    whole = release.set_digest(files).first()["set_sha256"]
    problems = lambda m: sorted((r.path or "", r.problem) for r in release.verify_artifacts(m, files, whole).collect())
    assert problems(files)[0] == ("", None) and problems(files.where("bytes > 0"))[0] == ("", "set_mismatch")


@pytest.mark.parametrize("approximate", [False, True])
def test_nearest_searches_are_led_by_the_component_with_most_values(spark, monkeypatch, approximate):
    """A search led by a component of two values would have two ranges, however many rows there are."""
    seen, put = [], attacks.nearest_vectors
    monkeypatch.setattr(attacks, "nearest_vectors", lambda asked, ref: seen.append(ref.agg(F.count_distinct("p")).first()[0]) or put(asked, ref))
    rows = spark.range(60).select("id", (F.col("id") % 2).alias("a"), (F.col("id") * 7 % 31).alias("b"))
    one, two = rows.where("id % 3 = 0"), rows.where("id % 3 = 1")
    got = {r.id: r.distance for r in attacks.nearest_distance(one, two, ["a", "b"], "id", approximate=approximate).collect()}
    assert len(got) == 20 and min(seen) > 2
    place = lambda i: (i % 2, i * 7 % 31)
    assert all(d >= min(math.dist(place(i), place(j)) for j in range(1, 60, 3)) - 1e-9 for i, d in got.items())
