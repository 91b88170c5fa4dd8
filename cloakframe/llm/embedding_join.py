"""Embedding near-duplicates by an exact metric range join over pivots.

On unit vectors a cosine of at least t is a distance of at most r = sqrt(2 - 2 t), so
near-duplicates are a range join in a metric space. Each vector's home is the cell of
its nearest pivot; it also visits the cells before its home (in the order of pivots)
that a neighbour within r could call home. By the triangle inequality that needs
d(x, p_j) - d(x, p_i) <= 2 r, and for unit vectors the distance to the plane between two
pivots sharpens it to (x.p_i - x.p_j) / |p_i - p_j| <= r. Two neighbours thus meet exactly
once, in the earlier of their homes, so cells join independently, in pairs of blocks of
bounded size: a cell that holds a third of all vectors is split over tasks, and equal
vectors are joined once.

Inside a block a pair is first bounded by its projections on a few directions and the
lengths of what these leave over, x.y <= Px.Py + |x - Px| |y - Py|, in single precision
with a margin above its error; what remains is decided in double precision.

Links are counted, not listed; each block hands on one edge for each linked vector and
the components of these edges are those of all links.

Vectors spread evenly over many dimensions are near no pivot and visit most cells; the
join stays exact, at the price of one bound for each pair.

Defined results: vectors that are null, zero or hold null or non-finite components link
with nothing, and vectors of different lengths not with each other; a null id is a row
of its own that is counted as a neighbour but has component null; repeated ids are
separate rows of one id; components of any finite size are scaled before they are
squared; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable
from .components import components

#: Vectors to a pivot, and the most pivots of one length; pivots are a bounded sample that is sent to tasks.
PER_PIVOT, MOST_PIVOTS = 8192, 2048
#: Vectors to a block, and the directions of the bound inside it.
BLOCK, DIRECTIONS = 8192, 16
#: Similarities this close to the threshold are computed again by themselves, in one fixed order.
NEAR = 1e-9
#: Pairs whose similarity is computed in double precision at one time.
PAIRS = 200_000


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its squares neither vanish nor overflow; exact."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)))


def usable(c):
    """Whether an array holds finite numbers only, one of them not zero."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def pivots_of(distinct: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """For every length, given with its count, a bounded sample: vectors of the smallest digests, none near another."""
    out = {}
    for size, n in sorted(sizes.items()):
        most = min(MOST_PIVOTS, max(1, n // PER_PIVOT))
        rows = distinct.where(F.size("vec") == size).orderBy("node").limit(4 * most).select("vec").collect()
        found = unit(np.array([r["vec"] for r in rows], dtype=np.float64))
        kept: list[int] = []
        for i in range(len(found)):
            if len(kept) < most and all(found[i] @ found[k] < 0.9 for k in kept):
                kept.append(i)
        out[size] = found[kept]
    return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix, without a Python object for each row."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return one.flatten().to_numpy(zero_copy_only=False).reshape(len(one), -1).astype(np.float64)


def deal(distinct: DataFrame, pivots: dict[int, np.ndarray], radius: float) -> DataFrame:
    """cell, home, node, copies, vec: each vector once at home and once for each earlier cell a neighbour may call home."""
    first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist(), strict=False))

    def cells(b: pa.RecordBatch, size: int) -> pa.RecordBatch:
        own = pivots[size]
        gaps = np.sqrt(np.maximum(2 - 2 * (own @ own.T), 0))
        np.fill_diagonal(gaps, np.inf)
        near = unit(matrix(b.column("vec"))) @ own.T
        home = near.argmax(axis=1)
        apart = (near[np.arange(len(home)), home][:, None] - near) / gaps[home]
        apart[np.arange(len(home)), home] = 0
        row, cell = np.nonzero((apart <= radius + NEAR) & (np.arange(len(own))[None] <= home[:, None]))
        kept = b.take(pa.array(row))
        columns = [pa.array((cell + first[size]).astype(np.int32)), pa.array(home[row] == cell), *(kept.column(c) for c in ("node", "copies", "vec"))]
        return pa.RecordBatch.from_arrays(columns, names=["cell", "home", "node", "copies", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.list_value_length(whole.column("vec")).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                rows = whole.take(pa.array(np.flatnonzero(sizes == size)))
                for at in range(0, rows.num_rows, 1024):
                    yield cells(rows.slice(at, 1024), int(size))

    kind = distinct.schema["vec"].dataType.simpleString()
    return distinct.select("node", "copies", "vec").mapInArrow(run, f"cell int, home boolean, node string, copies bigint, vec {kind}")


class Union:
    """Smallest member of each set of linked positions."""

    def __init__(self, n: int) -> None:
        self.top = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.top[a], self.top[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            np.minimum.at(self.top, np.maximum(x, y), np.minimum(x, y))
            while (again := self.top[self.top] != self.top).any():
                self.top[again] = self.top[self.top[again]]


def bounded(vectors: np.ndarray) -> np.ndarray:
    """Projections of unit vectors on DIRECTIONS fixed directions, and the length of what is left over, in single precision."""
    size = vectors.shape[1]
    if size <= 2 * DIRECTIONS:
        return vectors.astype(np.float32)
    basis = np.linalg.qr(np.random.default_rng(size).normal(size=(size, DIRECTIONS)))[0]
    on = vectors @ basis
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", on, on), 0))
    return np.concatenate([on, rest[:, None]], axis=1).astype(np.float32)


def close_pairs(raw_a: np.ndarray, raw_b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs at or above the threshold, strip by strip."""
    a, b = unit(raw_a), unit(raw_b)
    low_a, low_b = bounded(a), np.ascontiguousarray(bounded(b).T)
    margin = np.float32(threshold - 1e-5 - 4e-7 * a.shape[1])
    for top in range(0, len(a), 512):
        rows, columns = np.nonzero(low_a[top : top + 512] @ low_b >= margin)
        rows += top
        for at in range(0, len(rows), PAIRS):
            row, col = rows[at : at + PAIRS], columns[at : at + PAIRS]
            near = np.einsum("ij,ij->i", a[row], b[col])
            close = near >= threshold
            for i in np.flatnonzero(np.abs(near - threshold) < NEAR):
                close[i] = cosine(raw_a[row[i]], raw_b[col[i]]) >= threshold
            yield row[close], col[close]


def join_block(group: pa.Table, threshold: float, itself: bool) -> pa.Table:
    """node, links (rows linked to it in this block), other (a node of its set): a block (side 0) against another (side 1) or itself.

    Against itself each pair is taken once.
    """
    side = group.column("side").to_numpy()
    vectors, ids, copies = scaled(matrix(group.column("vec"))), group.column("node").to_numpy(zero_copy_only=False), group.column("copies").to_numpy()
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    two = one if itself else two
    sets, links = Union(len(ids)), np.zeros(len(ids), np.int64)
    if len(one) and len(two):
        for row, col in close_pairs(vectors[one], vectors[two], threshold):
            if itself:
                row, col = row[row < col], col[row < col]
            x, y = one[row], two[col]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            sets.link(x, y)
    linked = np.flatnonzero(links)
    return pa.table({"node": pa.array(ids[linked], pa.string()), "links": links[linked], "other": pa.array(ids[sets.top[linked]], pa.string())})


def join_cells(dealt: DataFrame, threshold: float) -> DataFrame:
    """The partial results of all pairs of blocks.

    The vectors at home in a cell form blocks 0 to h - 1, its visitors blocks h and on; a
    home block meets itself, the home blocks after it and all visitors' blocks.
    """
    counts = dealt.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("n"))
    plan = counts.select(
        "cell",
        (1 + F.floor(F.col("homes") / BLOCK)).cast("int").alias("h"),
        (1 + F.floor((F.col("n") - F.col("homes")) / BLOCK)).cast("int").alias("v"),
    )
    # one row a pivot, so broadcast it is bounded
    rows = dealt.join(F.broadcast(plan), "cell")
    deals = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    rows = rows.withColumn("b", F.when(F.col("home"), deals("h")).otherwise(F.col("h") + deals("v")))
    after = F.sequence(F.lit(0), F.col("h") + F.col("v") - 1)
    # as the first of a pair it meets blocks from its own on, as the second those before it
    as_first = F.transform(
        F.filter(after, lambda j: F.col("home") & (j >= F.col("b"))), lambda j: F.struct(F.col("b").alias("i"), j.alias("j"), F.lit(0).alias("side"))
    )
    as_second = F.transform(
        F.filter(after, lambda i: (i < F.col("h")) & (i < F.col("b"))), lambda i: F.struct(
            i.alias("i"),
            F.col("b").alias("j"),
            F.lit(1).alias("side"),
        )
    )
    pairs = rows.select("cell", F.inline(F.concat(as_first, as_second)), "node", "copies", "vec")
    return pairs.groupBy("cell", "i", "j").applyInArrow(
        lambda key, g: join_block(g, threshold, key[1] == key[2]), "node string, links bigint, other string"
    )


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """id, n_links, component_id, kept for every row; see the module's text for the method."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    vec = F.col(vector_col)
    kind = df.schema[vector_col].dataType
    if not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        vec = vec.cast("array<double>")
    rows = df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.when(usable(vec), F.transform(vec, lambda x: x + F.lit(0).cast(x_type(kind)))).alias("vec"),
    )
    # equal vectors are one node, named by 128 bits of digests (ids may repeat or be null)
    name = F.concat(F.lpad(F.hex(F.xxhash64("vec")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), F.col("vec"))), 16, "0"))
    rows = durable(rows.withColumn("node", F.when(F.col("vec").isNotNull(), name)))
    distinct = durable(rows.where("vec is not null").groupBy("node", "vec").agg(F.count("*").alias("copies"), F.min("id").alias("smallest")))
    # one row a length of vectors
    sizes = {r["size"]: r["count"] for r in distinct.groupBy(F.size("vec").alias("size")).count().collect()}
    if not sizes:
        return rows.select(
            F.col("id").alias(id_col),
            F.lit(0).cast("bigint").alias("n_links"),
            F.col("id").alias("component_id"),
            F.col("id").isNotNull().alias("kept"),
        )
    if distinct.groupBy("node").count().where("count > 1").limit(1).count():
        raise ValueError("two vectors share all 128 bits of their digests")
    dealt = durable(deal(distinct, pivots_of(distinct, sizes), math.sqrt(2 - 2 * threshold)))
    found = durable(join_cells(dealt, threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    tops = components(found.select("node", "other"), "node", "other").select(F.col("id").alias("node"), F.col("component").alias("top"))
    named = distinct.select("node", "copies", "smallest").join(tops, "node", "left").withColumn("top", F.coalesce("top", "node"))
    best = named.groupBy("top").agg(F.min("smallest").alias("component_id"))
    answer = durable(
        named.join(best, "top").join(links, "node", "left").select(
            F.col("node").alias("d"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            "component_id",
        )
    )
    out = rows.join(answer, F.col("node") == F.col("d"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def x_type(kind: T.ArrayType) -> str:
    """The kind of number that vectors are kept in."""
    return "float" if isinstance(kind.elementType, T.FloatType) else "double"
