"""Whitened embeddings against a dense eigendecomposition."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cloakframe.llm import gkl_whitening as G
from cloakframe.llm import queries


def dense(vectors: list) -> tuple[list[int], list[list[int]], np.ndarray, np.ndarray]:
    """Usable rows, their x, and eigenvalues (falling) and eigenvectors of the fit list's covariance."""
    usable = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(vectors[i]) for i in usable), default=0)
    x = [[math.floor(64 * c) + 1_000_000 for c in vectors[i]] + [1_000_000] * (width - len(vectors[i])) for i in usable]
    distinct = np.array(sorted(set(map(tuple, x))), dtype=np.int64)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = (n * distinct - sums) / n
    values, found = np.linalg.eigh(centred.T @ centred / n)
    return usable, x, values[::-1], found[:, ::-1]


def check(rows: list, vectors: list, wanted: int = 16) -> None:
    usable, x, values, found = dense(vectors)
    distinct = sorted(set(map(tuple, x)))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    k = min(wanted, int((values > 1e-15 * values[0]).sum()))
    assert len(rows) == k * len(usable)
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert {c for _, c in got} == set(range(1, k + 1))
    for i in range(k):
        assert rows and {r.n for r in rows} == {n} and all(r.identity_error <= 1e-4 for r in rows)
        want = np.array([[n * a - s for a, s in zip(row, sums, strict=True)] for row in x]) @ found[:, i] / n / math.sqrt(values[i])
        mine = np.array([got[at, i + 1].pop().whitened for at in usable])
        if (k == len(values) or i + 1 < len(values)) and min((abs(values[i] - v) for j, v in enumerate(values) if j != i), default=1) > 1e-3 * values[i]:
            assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7
    assert {r.component: round(r.explained / (values[r.component - 1] / values.sum()), 8) for r in rows} == dict.fromkeys(range(1, k + 1), 1.0)
    away = {at: sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for at, row in zip(usable, x, strict=True)}
    assert all(r.deviation == (away[r.vec_id] if away[r.vec_id] < 1 << 63 else None) for r in rows)


def test_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    vectors = [None] * (max(r.vec_id for r in table) + 1)
    for r in table:
        vectors[r.vec_id] = r.embedding
    check(queries.op13_gkl_whitening(spark, sf).collect(), vectors)


@pytest.mark.parametrize("kind", ["odd", "low rank", "equal values", "large"])
def test_shapes(spark, kind):
    rng = np.random.default_rng(7)
    if kind == "odd":
        vectors = rng.normal(0, 2, (300, 7)).tolist() + [[1.0], [], [0.5, -3.0], None, [math.nan] * 7, [1.0, None], [math.inf] * 7]
        vectors += [vectors[0]] * 200 + [[*vectors[1], 0.0]]
    elif kind == "low rank":
        vectors = (rng.normal(0, 1, (200, 3)) @ np.array([[1.0, 2, 0, 1, 5], [0, 1, 1, 0, 2], [0, 0, 0, 0, 0]])).round().tolist()
    elif kind == "equal values":
        # two pairs of equal eigenvalues: one start alone sees one of each
        vectors = [[a, b, c, d] for a in (-3.0, 3.0) for b in (-3.0, 3.0) for c in (-1.0, 1.0) for d in (-1.0, 1.0)]
    else:
        vectors = (rng.normal(0, 1, (60, 4)) * [1e6, 1e4, 1e3, 1e3]).tolist() + [[0.0, 1e9, 0.0, 0.0]]
    df = spark.createDataFrame([(i, v, 1, b"x") for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, n int, x binary")
    check(G.whiten(df).collect(), vectors)


def test_nothing_to_whiten(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "vec_id bigint, embedding array<float>")
    assert G.whiten(df).count() == G.whiten(df.limit(0)).count() == 0
    assert G.whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_bidiagonalisation_of_a_spread_spectrum():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((200, 40)))[0]
    w = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    values = np.concatenate([np.geomspace(1e3, 1, 30), np.full(10, 0.5)])
    x, passes = q * values @ w.T, []

    def product(v):
        passes.append(1)
        u = x @ v
        return x.T @ u, float(u @ u)

    s, found = G.bidiagonalise(product, float((x * x).sum()), 40, 16)
    assert np.allclose(s, values[:16], rtol=1e-12) and np.abs(np.abs(np.einsum("ij,ij->j", found, w[:, :16])) - 1).max() < 1e-12
    assert len(passes) < 60
