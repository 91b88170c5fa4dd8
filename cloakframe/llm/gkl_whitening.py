"""Embeddings whitened on their leading components, by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers x = floor(64 c) + 1000000. The fit list, each distinct x once, is stored as blocks of
rows; sums per dimension are exact. A step of the bidiagonalisation is one pass over the blocks: every
task centres its rows, forms its part u = Xv of the left vector and its part of X'u, and the parts are summed per
dimension, so that the driver sees vectors of the dimension only. A left vector is never stored. It is X times a
short combination of the right vectors, kept as its coefficients; its products with the earlier
left vectors, which full reorthogonalisation takes away, are dot products of these coefficients with the
earlier X'u. The right vectors are reorthogonalised against all earlier ones as well, both twice. Singular
values and vectors of the small bidiagonal matrix give deviations and components.

An exhausted space, or leading components that no longer change, are confirmed by a new start orthogonal to all
right vectors, which finds the other copies of a multiple value; two starts in a row that change nothing, or a space without a rest,
end the search.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; equal rows are
kept, each with its result. An entry that a shorter vector lacks counts as c = 0, so x = 1000000. Entries whose
x lies beyond 2^50 are held there. Components without variance (a deviation below 1e-9 of the largest) cannot be whitened and are not
returned; a fit list of one vector, or of none, gives no rows. A deviation that no long can hold is null. Columns beyond id and vector are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import durable

SCALE, OFFSET = 64, 1_000_000
MOST = 1 << 50
#: Entries to a block of the fit list; blocks to a task of a pass.
CELLS, PER_TASK = 1 << 18, 16
#: Relative size below which a rest, a residual or a deviation counts as nothing.
NOTHING, CONVERGED, FLAT = 1e-12, 1e-15, 1e-9


def to_integers(values: np.ndarray) -> np.ndarray:
    """x - OFFSET of entries."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def encode(row: np.ndarray) -> bytes:
    """Integers without the zeros at their end, in the smallest kind that holds them: equal bytes for equal x."""
    used = np.flatnonzero(row)
    row = row[: used[-1] + 1] if len(used) else row[:0]
    low, high = (int(row.min()), int(row.max())) if len(row) else (0, 0)
    size = next(k for k in (1, 2, 4, 8) if -(1 << 8 * k - 1) <= low and high < 1 << 8 * k - 1)
    return bytes([size]) + row.astype(f"<i{size}").tobytes()


def decode(code: bytes) -> np.ndarray:
    return np.frombuffer(code, dtype=f"<i{code[0]}", offset=1)


def padded(codes: list[bytes], width: int) -> np.ndarray:
    """Rows of integers at one width."""
    out = np.zeros((len(codes), width), dtype=np.int64)
    for i, code in enumerate(codes):
        row = decode(code)
        out[i, : len(row)] = row
    return out


def encoded(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, x: the usable rows, vectors as encoded integers."""
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vec")).where(F.col("vec").isNotNull() & finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column("vec")
            whole, ends = to_integers(vec.flatten().to_numpy(zero_copy_only=False)), np.cumsum(np.asarray(vec.value_lengths()))
            codes = [encode(row) for row in np.split(whole, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(codes, type=pa.binary())], names=["id", "x"])

    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("x", T.BinaryType())]))


def fit_blocks(rows: DataFrame) -> DataFrame:
    """n, width, kind, data, sums: the distinct x in blocks of one matrix each, with their sums per dimension; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, widest = [], 1

        def block() -> pa.RecordBatch:
            matrix, kind = padded(held, widest), f"<i{max(code[0] for code in held)}"
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([len(held)], pa.int64()),
                    pa.array([widest], pa.int32()),
                    pa.array([kind]),
                    pa.array([matrix.astype(kind).tobytes()], pa.binary()),
                    pa.array([matrix.sum(axis=0).tolist()], pa.list_(pa.int64())),
                ],
                names=["n", "width", "kind", "data", "sums"],
            )

        for b in batches:
            for code in b.column("x").to_pylist():
                width = max(1, (len(code) - 1) // code[0])
                if held and (len(held) + 1) * max(widest, width) > CELLS:
                    yield block()
                    held, widest = [], 1
                held.append(code)
                widest = max(widest, width)
        if held:
            yield block()

    return durable(rows.select("x").distinct().mapInArrow(run, "n bigint, width int, kind string, data binary, sums array<bigint>"))


@dataclass
class Fit:
    """The fit list's exact counts and sums, and the blocks that passes go over."""

    blocks: DataFrame
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        # quotients of whole numbers, correctly rounded
        return np.array([s / self.n for s in self.sums])

    def total(self, part, size: int) -> np.ndarray:
        """The sum over all centred blocks of `part`, a function of one block that gives `size` numbers."""
        mean = self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = np.zeros(size)
            for b in batches:
                for r in b.to_pylist():
                    rows = np.zeros((r["n"], len(mean)))
                    rows[:, : r["width"]] = np.frombuffer(r["data"], dtype=r["kind"]).reshape(r["n"], r["width"])
                    whole += part(rows - mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(whole)], names=["at", "value"])

        sums = self.blocks.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
        out = np.zeros(size)
        for r in sums.collect():
            out[r["at"]] = r["value"]
        return out

    def product(self, v: np.ndarray) -> tuple[np.ndarray, float]:
        """X'(Xv) and the squared length of Xv."""

        def part(rows: np.ndarray) -> np.ndarray:
            u = rows @ v
            return np.append(u @ rows, u @ u)

        found = self.total(part, len(v) + 1)
        return found[:-1], float(found[-1])


def fit(rows: DataFrame) -> Fit | None:
    """The fit list of encoded rows; none without rows."""
    blocks = fit_blocks(rows)
    size = blocks.agg(F.count("*").alias("blocks"), F.sum("n").alias("n"), F.max("width").alias("width")).first()
    if not size["blocks"]:
        return None
    sums = [0] * size["width"]
    for r in blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect():
        sums[r["pos"]] = int(r["s"])
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size["blocks"] // PER_TASK))
    return Fit(blocks.drop("sums").coalesce(tasks), size["n"], sums)


def without(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """v orthogonal to an orthonormal basis; twice is enough."""
    for _ in range(2 if basis else 0):
        q = np.array(basis)
        v = v - (q @ v) @ q
    return v


def bidiagonalise(product, trace: float, width: int, wanted: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular values of X (falling) and right singular vectors (columns), from products X'(Xv).

    trace: the squared length of X.
    """
    rng = np.random.default_rng(seed)
    right: list[np.ndarray] = []
    left: list[np.ndarray] = []  # coefficients: a left vector is X times these
    back: list[np.ndarray] = []  # X' times the left vectors
    diagonal: list[float] = []
    above: list[float] = []
    scale, confirmed, last = np.sqrt(trace), 0, None

    def fresh() -> np.ndarray | None:
        """A start in the row space, orthogonal to all right vectors; none if nothing is left."""
        whole = product(without(rng.standard_normal(width), right))[0]
        rest = without(whole, right)
        size = np.linalg.norm(rest)
        return None if len(right) >= width or size <= NOTHING * trace else rest / size

    def solved() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, s, q = np.linalg.svd(np.diag(diagonal) + np.diag(above[: len(diagonal) - 1], 1))
        return p, s, q

    v, beta = fresh(), 0.0
    while v is not None:
        right.append(v)
        c = v - beta * left[-1] if beta else v.copy()
        for _ in range(2):
            for z, w in zip(back, left, strict=True):
                c = c - (z @ c) * w
        z, square = product(c)
        alpha = np.sqrt(square)
        if alpha <= NOTHING * scale:
            right.pop()
            if above:
                above[-1] = 0.0
            v = None
        else:
            left.append(c / alpha)
            back.append(z / alpha)
            diagonal.append(alpha)
            rest = without(back[-1] - alpha * v, right)
            beta = float(np.linalg.norm(rest))
            v = rest / beta if beta > NOTHING * scale and len(right) < width else None
            p, s, _ = solved()
            k = min(wanted, len(s))
            if v is not None and len(s) >= wanted and (beta * np.abs(p[-1, :k]) <= CONVERGED * s[0]).all():
                v = None
            above.append(beta if v is not None else 0.0)
        if v is None and diagonal:
            leading = solved()[1][:wanted]
            same = last is not None and len(last) == len(leading) == wanted and np.allclose(leading, last, rtol=1e-13, atol=0)
            confirmed, last = confirmed + 1 if same else 0, leading
            v, beta = (None, 0.0) if confirmed == 2 else (fresh(), 0.0)
    if not diagonal:
        return np.zeros(0), np.zeros((width, 0))
    _, s, q = solved()
    k = min(wanted, int((s > FLAT * s[0]).sum()))
    return s[:k], (np.array(right).T @ q.T)[:, :k]


def deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n y - S)^2, exact."""
    most = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(len(sums), 1) < 1 << 63:
        gap = n * y - np.array(sums, dtype=np.int64)
        return np.einsum("ij,ij->i", gap, gap).tolist()
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in y]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", wanted: int = 16) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    rows = encoded(df, id_col, vec_col)
    kinds = T.StructType(
        [
            T.StructField(id_col, rows.schema["id"].dataType),
            *T.StructType.fromDDL("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"),
        ]
    )
    fitted = fit(rows)
    if fitted is None:
        return df.sparkSession.createDataFrame([], kinds)
    n, sums, mean, width = fitted.n, fitted.sums, fitted.mean, len(fitted.sums)
    trace = float(fitted.total(lambda x: np.array([np.einsum("ij,ij->", x, x)]), 1)[0])
    values, components = bidiagonalise(fitted.product, trace, width, wanted)
    count, spread = len(values), values**2 / n
    projection, explained = components / np.sqrt(spread), spread / (trace / n) if count else spread

    def gram(x: np.ndarray) -> np.ndarray:
        w = x @ projection
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    moments = fitted.total(gram, count * count + count) / n if count else np.zeros(0)
    means = moments[count * count :]
    error = float(np.abs(moments[: count * count].reshape(count, count) - np.outer(means, means) - np.eye(count)).max(initial=0))
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = padded(b.column("x").to_pylist(), width)
            repeated = pa.array(np.repeat(np.arange(len(y)), count))
            away = pa.array(deviations(y, n, sums), type=pa.int64()).take(repeated)
            number = lambda v, kind: pa.array(np.tile(v, len(y)), type=kind)
            white = pa.array(((y - mean) @ projection).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(repeated),
                    number(np.arange(1, count + 1), pa.int32()),
                    number(np.full(count, n), pa.int64()),
                    away,
                    white,
                    number(explained, pa.float64()),
                    number(np.full(count, error), pa.float64()),
                ],
                schema=arrow,
            )

    return rows.mapInArrow(run, kinds)
