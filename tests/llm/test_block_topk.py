"""Exact top-k against brute force."""

from __future__ import annotations

import math
import random

import numpy as np

from cloakframe.llm import block_topk as K


def brute(rows: list[tuple], every: int = 50, k: int = 5) -> list[tuple]:
    usable = [(i, v, [math.floor(256 * x) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q, e in usable:
        if q is not None and q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(e, c, strict=False)), v is None, v or 0) for j, v, c in usable if j != i)[:k]
            out += [(q, rank, None if unknown else v, -s) for rank, (s, unknown, v) in enumerate(scored, 1)]
    return sorted(out, key=repr)


def test_odd_rows_ties_and_repeats(spark):
    rnd = random.Random(12)
    vector = lambda w=6: [rnd.choice([-1.0, -0.3, 0.0, 0.25, 0.7, 1.5]) for _ in range(w)]
    rows = [(i, vector()) for i in range(400)]
    same = vector()
    rows += [(i, same) for i in range(1000, 1200)] + [(100, same), (100, same), (None, same), (None, vector()), (-50, vector()), (2000, []), (2050, vector(9)), (2100, vector(2))]
    rows += [(2150, None), (2200, [1.0, None]), (2250, [math.nan] * 6), (2300, [math.inf] * 6), (2301, [-math.inf])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id bigint, embedding array<double>, kind string, part int, width int")
    got = sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in K.top_k(df).collect()], key=repr)
    assert got == brute(rows)
    few = [(0, [1.0]), (50, [-2.0]), (51, [0.5])]
    got = sorted([tuple(r) for r in K.top_k(spark.createDataFrame(few, "vec_id bigint, embedding array<float>")).collect()], key=repr)
    assert got == brute(few)
    assert K.top_k(df.limit(0)).count() == K.top_k(df.where("vec_id = 50")).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [50_000.25, -50_000.5]), (1, [50_000.0, 50_000.0]), (2, [50_000.25, -50_000.25]), (3, [-1.0, 0.0]), (50, [1e30, -1e30])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in K.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert [got[0, r] for r in (2, 3, 4)] == [(v, s) for _, _, v, s in brute([r for r in rows if r[0] != 50])][:3]
    # beyond what a long can hold, components are held
    assert got[0, 1][0] == 50 and got[50, 1][0] == 0


def test_blocks_are_taken_by_falling_bound_until_none_can_win():
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (8, 16))
    matrix = np.concatenate([c + rng.integers(-9, 10, (50, 16)) for c in centres])
    ids = rng.permutation(len(matrix)).astype(np.int64)
    blocks = [K.make_block(s, matrix[s : s + 50], ids[s : s + 50], np.ones(50, dtype=bool))[0] for s in range(0, len(matrix), 50)]
    queries = matrix[::10]
    tops = K.Tops(len(queries), 5)
    visits = K.search(queries, blocks, tops)
    assert len(queries) <= visits < 0.5 * len(queries) * len(blocks)
    for q, scores, found in zip(queries, tops.scores, tops.ids, strict=True):
        want = sorted(zip(-(matrix @ q), ids, strict=True))[:5]
        assert [(-s, i) for s, i in zip(scores, found, strict=True)] == [(int(s), int(i)) for s, i in want]
    # no score exceeds the bound of its block
    for b in blocks:
        assert (K.bounds(queries, b.high, b.low) >= (queries @ b.matrix.T).max(axis=1)).all()


def test_ranges_are_cut_by_components():
    rng = np.random.default_rng(1)
    pieces = [(rng.integers(-9, 9, (5000, 4)), np.arange(5000), np.ones(5000, dtype=bool)), (rng.integers(-9, 9, (10, 6)), np.arange(5000, 5010), np.ones(10, dtype=bool))]
    rows = list(K.range_rows(7, pieces, 50, 3))
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [("block", 7, 0, 4096), ("block", 7, 4096, 914), ("range", 7, 0, 5010), ("query", 7, 0, 101)]
    whole = np.zeros((5010, 6), dtype=np.int64)
    whole[:5000, :4], whole[5000:] = pieces[0][0], pieces[1][0]
    hits = rows[-1][-1]
    assert len(hits) == 303
    for q in (0, 2500, 5000):
        want = sorted((-int(whole[q] @ whole[j]), j) for j in range(5010) if j != q)[:3]
        assert [(-h["score"], h["vec_id"]) for h in hits if h["query_id"] == q] == want
