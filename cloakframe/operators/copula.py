"""A synthesiser that keeps how columns go together: a Gaussian copula over the numeric columns.

Fit: the exact distribution of every numeric column, as knots of a bounded number, gives each value the normal
score of its middle rank; correlations of the scores come from one pass of matrix sums. Draw: normals hashed
from (row, column, seed) are mixed by the Cholesky factor and go back through the knots. Values depend on the source and on (row,
column, seed), never on partitioning. Other columns are drawn alone, by `synth.sample_categorical`, identifiers are made up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import gram
from ..functions.ranges import before, bounds, range_of
from ..sources.shared import durable
from . import synth
from .profile import numeric_columns, role_of

#: The most knots of a column.
KNOTS = 1024
#: Digits to which correlations are held, so that the last bits of sums do not reach the values.
DIGITS = 9


@dataclass
class Marginal:
    """A column's values at its knots with the share of rows up to each (`upto`) and up to its middle (`middle`)."""

    values: np.ndarray
    upto: np.ndarray
    middle: np.ndarray
    nulls: float
    whole: bool

    def scores(self) -> np.ndarray:
        return normal_of(self.middle)

    def value_of(self, z: np.ndarray) -> np.ndarray:
        """The values that go with normal scores: as observed if the knots are all there is, else between them."""
        if not len(self.values):
            return np.full(len(z), np.nan)
        if self.whole:
            return self.values[np.minimum(np.searchsorted(normal_of(self.upto), z), len(self.values) - 1)]
        return np.interp(z, self.scores(), self.values)


def normal_of(shares: np.ndarray) -> np.ndarray:
    """The normal scores of shares in (0, 1]."""
    inverse = NormalDist().inv_cdf
    return np.array([inverse(min(max(p, 1e-12), 1 - 1e-12)) for p in shares])


def marginal(df: DataFrame, column: str) -> Marginal:
    """The exact distribution of a column at up to KNOTS values: all of them, or those where a next share of the rows begins.

    Counts by value are summed in ranges of the values, so no task sees them all.
    """
    value = F.col(f"`{column}`").cast("double") + 0.0
    counts = durable(df.select(F.when(~F.isnan(value), value).alias("v")).groupBy("v").agg(F.count("*").alias("n")))
    size = counts.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("n"), F.count("v").alias("k")).first()
    if not size["n"]:
        return Marginal(np.zeros(0), np.zeros(0), np.zeros(0), 1.0, True)
    there = counts.where("v is not null")
    rows = there.withColumn("r", range_of(F.col("v"), bounds(there, "v")))
    inside = Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("in", F.sum("n").over(inside)).join(before(rows, "r", F.sum("n"), "ahead"), "r").select(
        "v",
        "n",
        (F.col("ahead") + F.col("in")).alias("upto"),
    )
    whole = size["k"] <= KNOTS
    if not whole:
        step = lambda c: F.floor(c * (KNOTS - 2) / size["n"])
        first, last = F.col("upto") == F.col("n"), F.col("upto") == size["n"]
        summed = summed.where(first | last | (step(F.col("upto")) != step(F.col("upto") - F.col("n"))))
    # at most KNOTS rows
    found = sorted((r["v"], r["n"], r["upto"]) for r in summed.collect())
    v, n, upto = (np.array(x, dtype=np.float64) for x in zip(*found, strict=True))
    return Marginal(v, upto / size["n"], (upto - n / 2) / size["n"], 1 - size["n"] / size["all"], whole)


@dataclass
class Copula:
    """A fitted copula: marginals by column and the Cholesky factor of their scores' correlations."""

    columns: list[str]
    marginals: list[Marginal]
    correlation: np.ndarray
    factor: np.ndarray


def fit(df: DataFrame, columns: list[str]) -> Copula:
    """Normal scores, their correlations (pairwise complete, 0 where undefined) and a factor of the nearest correlation matrix."""
    marginals = [marginal(df, c) for c in columns]
    knots = [(m.values, m.scores()) if len(m.values) else (np.zeros(1), np.zeros(1)) for m in marginals]

    def score(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.where(np.isnan(x[:, i]), np.nan, np.interp(x[:, i], v, z)) for i, (v, z) in enumerate(knots)])

    gaps = [i for i, m in enumerate(marginals) if m.nulls]
    found = gram.pairwise_correlation(df, [F.col(f"`{c}`").cast("double") for c in columns], np.zeros(len(columns)), gaps, score)
    found = np.nan_to_num(np.round(found, DIGITS))
    np.fill_diagonal(found, 1.0)
    # pairwise correlations need not fit together: negative eigenvalues are lifted, the diagonal is kept at 1
    values, vectors = np.linalg.eigh((found + found.T) / 2)
    lifted = (vectors * np.maximum(values, 1e-6)) @ vectors.T
    scale = np.sqrt(np.diag(lifted))
    return Copula(columns, marginals, found, np.linalg.cholesky(lifted / np.outer(scale, scale)))


def draw(rows: DataFrame, key: str, model: Copula, seed: synth.Seed) -> DataFrame:
    """`rows` and the model's columns as v0, v1, ..., doubles: one draw a row."""
    k = len(model.columns)
    hashed = [synth.normal(F.col(key), f"copula {c}", seed).alias(f"e{i}") for i, c in enumerate(model.columns)]
    lacking = [(synth.uniform(F.col(key), F.lit(f"gap {c}"), F.lit(seed)) < m.nulls).alias(f"g{i}") for i, (c, m) in enumerate(zip(model.columns, model.marginals, strict=True))]

    own, names = len(rows.columns), [*rows.columns, *[f"v{i}" for i in range(k)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns[own:]]
            z = np.column_stack(columns[:k]) @ model.factor.T if b.num_rows else np.zeros((0, k))
            made = [pa.array(m.value_of(z[:, i]), mask=columns[k + i].astype(bool)) for i, m in enumerate(model.marginals)]
            yield pa.RecordBatch.from_arrays([*b.columns[:own], *made], names=names)

    kinds = T.StructType([*rows.schema, *[T.StructField(f"v{i}", T.DoubleType()) for i in range(k)]])
    return rows.select("*", *hashed, *lacking).mapInArrow(run, kinds)


def draw_columns(rows: DataFrame, df: DataFrame, seed: synth.Seed, roles: dict[str, str] | None) -> DataFrame:
    """`rows` (with __row) and the columns of `df`; numbers from a copula."""
    roles = roles or {}
    numbers = [c for c in numeric_columns(df) if roles.get(c, role_of(c)) != "identifier"]
    if numbers:
        rows = draw(rows, "__row", fit(df, numbers), seed)
    for i, c in enumerate(numbers):
        kind, v = df.schema[c].dataType, F.when(~F.isnan(f"v{i}"), F.col(f"v{i}"))
        made = F.rint(v).cast(kind) if isinstance(kind, T.IntegralType) else v.cast(kind)
        rows = rows.withColumn(f"v{i}", made).withColumnRenamed(f"v{i}", f"__copula_{i}")
    for f in df.schema:
        if roles.get(f.name, role_of(f.name)) == "identifier":
            rows = rows.withColumn(f.name, synth.regenerate_identifier(f.name, F.col("__row"), seed))
        elif f.name not in numbers:
            rows = synth.sample_categorical(rows, "__row", df, f.name, seed)
    return rows.withColumnsRenamed({f"__copula_{i}": c for i, c in enumerate(numbers)})


def synthesize_copula(df: DataFrame, seed: int = 7, roles: dict[str, str] | None = None) -> DataFrame:
    """As many rows and the same columns; numbers keep their distributions, gaps and rank correlations."""
    rows = df.sparkSession.range(df.count()).withColumnRenamed("id", "__row")
    return draw_columns(rows, df, seed, roles).select(*[F.col(f"`{c}`") for c in df.columns])


def synthesize_copula_seeds(df: DataFrame, seeds: list[int], roles: dict[str, str] | None = None) -> DataFrame:
    """The tables of several seeds, told apart by __seed: one fit for all."""
    rows = draw_columns(synth.seeded_rows(df, seeds), df, F.col(synth.SEED), roles)
    return rows.select(synth.SEED, *[F.col(f"`{c}`") for c in df.columns])


NAME = "copula"
synth.register_synthesizer(synth.Synthesizer(NAME, synthesize_copula, generate_seeds=synthesize_copula_seeds))
