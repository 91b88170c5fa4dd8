"""Sums over the rows of a table as matrices: every task reduces its rows by BLAS, the tasks' parts meet in a tree.

A column more costs a row and a column of a matrix, not hundreds of aggregate expressions. The driver
sees FAN parts at most, whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import durable

#: Parts that are joined at one place; rows to a product.
FAN, STRIP = 64, 4096
JOIN = {"sum": np.add, "max": np.fmax, "min": np.fmin}
PART = "id bigint, parts array<binary>"

Part = tuple[str, Callable[[np.ndarray], np.ndarray]]


def reduce_rows(df: DataFrame, columns: list[Column], parts: list[Part]) -> list[np.ndarray] | None:
    """For each (how to join, function of a matrix of rows) the joined result over all rows; null is NaN. None for an empty table."""
    rows = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    kinds = [kind for kind, _ in parts]

    def joined(one: list[np.ndarray] | None, two: list[np.ndarray]) -> list[np.ndarray]:
        return two if one is None else [JOIN[k](a, b) for k, a, b in zip(kinds, one, two, strict=True)]

    def as_batch(i: int, found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([i], pa.int64()), pa.array([[x.astype(np.float64).tobytes() for x in found]], pa.list_(pa.binary()))],
            names=["id", "parts"],
        )

    def as_arrays(stored: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(x) for x in stored]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for b in batches:
            matrix = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            for at in range(0, len(matrix), STRIP):
                whole = joined(whole, [np.asarray(f(matrix[at : at + STRIP])).ravel() for _, f in parts])
        if whole is not None:
            yield as_batch(TaskContext.get().partitionId(), whole)

    def further(table: pa.Table) -> pa.Table:
        whole = None
        for stored in table.column("parts").to_pylist():
            whole = joined(whole, as_arrays(stored))
        return pa.Table.from_batches([as_batch(table.column("id")[0].as_py() // FAN, whole)])

    # parts join in the order of their tasks; what a task reads may differ in the last bits of a sum only
    level = durable(rows.mapInArrow(first, PART))
    most = level.agg(F.max("id").alias("m")).first()["m"]
    while most is not None and most >= FAN:
        level = level.groupBy(F.floor(F.col("id") / FAN).alias("up")).applyInArrow(further, PART)
        most //= FAN
    whole = None
    for r in sorted(level.collect(), key=lambda r: r["id"]):
        whole = joined(whole, as_arrays(r["parts"]))
    return whole


def columns_summary(df: DataFrame, columns: list[Column]) -> dict[str, np.ndarray] | None:
    """n (all rows), count, mean, low and high of every column, NaN left out."""
    found = reduce_rows(
        df,
        columns,
        [
            ("sum", lambda x: np.array([len(x)])),
            ("sum", lambda x: (~np.isnan(x)).sum(axis=0)),
            ("sum", lambda x: np.nansum(x, axis=0)),
            ("min", lambda x: np.fmin.reduce(x, axis=0)),
            ("max", lambda x: np.fmax.reduce(x, axis=0)),
        ],
    )
    if found is None:
        return None
    n, count, total, low, high = found
    return {"n": int(n[0]), "count": count, "mean": np.divide(total, count, out=np.zeros_like(total), where=count > 0), "low": low, "high": high}


def pairwise_correlation(
    df: DataFrame,
    columns: list[Column],
    centre: np.ndarray,
    gaps: list[int],
    score: Callable[[np.ndarray], np.ndarray] | None = None,
) -> np.ndarray:
    """Correlations of every two columns over the rows that have both; NaN where one is constant there.

    `centre` lies near the means, `gaps` are the columns that lack values, `score` is put before all sums.
    """
    k = len(columns)

    def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = (x if score is None else score(x)) - centre
        held = ~np.isnan(y)
        return np.where(held, y, 0.0), held.astype(np.float64)

    def products(x: np.ndarray) -> np.ndarray:
        y, held = centred(x)
        return np.stack([y.T @ y, y.T @ held, (y * y).T @ held, held.T @ held])

    def extremes(x: np.ndarray, join: np.ufunc) -> np.ndarray:
        # row g: over the rows that have column g; rows of complete columns are all alike
        x = x if score is None else score(x)
        whole = join.reduce(x, axis=0)
        out = np.tile(whole, (k, 1))
        for g in gaps:
            some = x[~np.isnan(x[:, g])]
            out[g] = join.reduce(some, axis=0) if len(some) else np.nan
        return out

    found = reduce_rows(df, columns, [("sum", products), ("min", lambda x: extremes(x, np.fmin)), ("max", lambda x: extremes(x, np.fmax))])
    if found is None:
        return np.full((k, k), np.nan)
    xy, x, xx, n = found[0].reshape(4, k, k)
    spread = (found[2] - found[1]).reshape(k, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = xy - x * x.T / n
        # of the first column, over the rows that have the second
        var = xx - x * x / n
        out = cov / np.sqrt(var * var.T)
    # a square may vanish beside the spread of other columns
    alive = (n > 0) & (np.nan_to_num(spread.T) > 0) & (var > 0)
    return np.where(alive & alive.T, out, np.nan)
