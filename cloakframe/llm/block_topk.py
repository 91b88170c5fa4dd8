"""Exact top-k inner products over vectors of integers, by blocks of documents with bounds.

Terms are the dimensions, a document's weights its components floor(256 x). Documents are
put into an order (by width, signs of their leading components, id), so that neighbours
are alike, and cut into ranges, a range into blocks. A block is a forward index (the matrix of its
documents) and, for each term, its highest and lowest weight. The sum over terms of query weight times the
better of these is what no score in the block exceeds. A query takes blocks in falling order of
that bound and stops at the first below its k-th score; equal bounds are looked at, because ties go to the smaller id.

Ranges are built where Spark's range partitioning puts their documents, and the queries among
them search their own range at once: that gives every query a k-th score. The ranges' bounds
(one row a range) go to the queries in bounded lists; a query is sent to those ranges only that
can still improve on it. There, chunks of queries and the blocks of a range meet in one group of bounded size.

Defined results: vectors that are null or hold null or non-finite components are neither queries
nor candidates. A missing component counts as 0, so vectors of unlike lengths meet over the shorter. Equal scores go by id, null ids last;
rows equal in id and vector are candidates each, and a query's own row alone is left out. A null id is never a query. Components
whose products could exceed a long are held at the largest value that cannot. An empty table gives no rows. Columns beyond
id and vector are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import durable

SCALE = 256
#: Documents to a block, and components to a range and to a chunk of queries (131,072 vectors of 64).
BLOCK, CELLS = 4096, 1 << 23
#: Ranges whose bounds are held at one time, and queries scored against a block at one time.
RANGES, STEP = 4096, 512
#: Leading components whose signs make the order.
SIGNS = 16
#: The score of nothing.
NONE = -(1 << 63) + 1

INDEX = "kind string, part bigint, start int, n int, width int, cell string, data binary, ids binary, known binary, high binary, low binary, kth binary, at binary, found array<struct<at:int,query_id:bigint,vec_id:bigint,score:bigint>>"
SENT = "part bigint, home bigint, n int, width int, cell string, data binary, ids binary, kth binary, at binary"
HIT = "home bigint, at int, query_id bigint, vec_id bigint, score bigint"


def pack(matrix: np.ndarray) -> tuple[str, bytes]:
    """Integers in the smallest kind that holds them."""
    low, high = (int(matrix.min()), int(matrix.max())) if matrix.size else (0, 0)
    kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, matrix.astype(kind).tobytes()


def unpack(kind: str, data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(rows, width).astype(np.int64)


@dataclass
class Block:
    """A forward index, sorted by id, with the highest and lowest weight of each term."""

    start: int
    matrix: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    high: np.ndarray
    low: np.ndarray
    most: int = field(init=False)

    def __post_init__(self) -> None:
        self.most = int(max(np.abs(self.high).max(initial=0), np.abs(self.low).max(initial=0)))
        self.real = self.matrix.astype(np.float64)


def make_block(start: int, matrix: np.ndarray, ids: np.ndarray, known: np.ndarray) -> tuple[Block, np.ndarray]:
    """A block of documents, and where each of them stood."""
    order = np.lexsort((ids, ~known))
    matrix = matrix[order]
    return Block(start, matrix, ids[order], known[order], matrix.max(axis=0), matrix.min(axis=0)), order


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What no score of a query reaches beyond, in doubles with room for their rounding."""
    width = min(queries.shape[1], len(high))
    q, top, bottom = (x.astype(np.float64) for x in (queries[:, :width], high[:width], low[:width]))
    room = np.abs(q) @ np.maximum(np.abs(top), np.abs(bottom)) * (width * 2.0**-50)
    return np.maximum(q, 0) @ top + np.minimum(q, 0) @ bottom + room


class Tops:
    """The k best of every query so far: score falling, then known ids before unknown, then id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((queries, k), NONE, dtype=np.int64)
        self.ids = np.zeros((queries, k), dtype=np.int64)
        self.known = np.zeros((queries, k), dtype=bool)
        self.kth = np.full(queries, NONE, dtype=np.int64)

    def offer(self, who: np.ndarray, scores: np.ndarray, block: Block, most: int) -> None:
        """Scores of queries `who` with all documents of a block; none beyond `most`."""
        live = np.flatnonzero(scores.max(axis=1) >= self.kth[who])
        if not len(live):
            return
        who, scores, n = who[live], scores[live], scores.shape[1]
        if n <= self.k:
            best = np.broadcast_to(np.arange(n), scores.shape)
        elif (most + 1) * n < 1 << 62:
            # one number for score and place, so that a partial sort breaks ties by id
            key = np.where(scores == NONE, np.iinfo(np.int64).min, scores * n + np.arange(n - 1, -1, -1))
            best = np.argpartition(key, n - self.k, axis=1)[:, n - self.k :]
        else:
            best = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        joined = [np.concatenate(x, axis=1) for x in ((self.scores[who], np.take_along_axis(scores, best, 1)), (self.ids[who], block.ids[best]), (self.known[who], block.known[best]))]
        order = np.lexsort((joined[1], ~joined[2], -joined[0]), axis=-1)[:, : self.k]
        for mine, all_of in zip((self.scores, self.ids, self.known), joined, strict=True):
            mine[who] = np.take_along_axis(all_of, order, 1)
        self.kth[who] = np.maximum(self.kth[who], self.scores[who, -1])


def search(queries: np.ndarray, blocks: list[Block], tops: Tops, own: np.ndarray | None = None) -> int:
    """Each query takes the blocks by falling bound until one is below its k-th score; returns the block visits made.

    own: the place of each query among the documents, by block start; that row is left out.
    """
    reach = np.stack([bounds(queries, b.high, b.low) for b in blocks], axis=1)
    order, at, visits = np.argsort(-reach, axis=1, kind="stable"), np.arange(len(queries)), 0
    live, most_q = np.ones(len(queries), dtype=bool), int(np.abs(queries).max(initial=0))
    for turn in range(len(blocks)):
        chosen = order[:, turn]
        live &= reach[at, chosen] >= tops.kth
        if not live.any():
            break
        for i in np.unique(chosen[live]):
            block, whole = blocks[i], np.flatnonzero(live & (chosen == i))
            width = min(queries.shape[1], block.matrix.shape[1])
            most = most_q * block.most * max(width, 1)
            for s in range(0, len(whole), STEP):
                who = whole[s : s + STEP]
                visits += len(who)
                if most < 1 << 53:
                    scores = (queries[who, :width].astype(np.float64) @ block.real[:, :width].T).astype(np.int64)
                else:
                    scores = queries[who, :width] @ block.matrix[:, :width].T
                if own is not None:
                    place = own[who] - block.start
                    inside = np.flatnonzero((place >= 0) & (place < len(block.ids)))
                    scores[inside, place[inside]] = NONE
                tops.offer(who, scores, block, most)
    return visits


def found(tops: Tops, at: np.ndarray, ids: np.ndarray) -> list[tuple]:
    """(place, query id, id, score) of what was found."""
    rows, ranks = np.nonzero(tops.scores != NONE)
    columns = (at[rows], ids[rows], tops.ids[rows, ranks], tops.scores[rows, ranks])
    known = tops.known[rows, ranks]
    return [(int(a), int(q), int(v) if ok else None, int(s)) for a, q, v, s, ok in zip(*columns, known, strict=True)]


def whole_numbers(values: np.ndarray, width: int) -> np.ndarray:
    """floor(256 x), held where products of `width` of them fit in a long."""
    most = math.isqrt((1 << 62) // max(width, 1))
    return np.clip(np.floor(values.astype(np.float64).reshape(-1, width) * SCALE), -most, most).astype(np.int64)


def range_rows(part: int, pieces: list[tuple], every: int, k: int) -> Iterator[tuple]:
    """The rows of the index for one range: its blocks, its bounds, and its queries with what they find in it."""
    width, n = max(x.shape[1] for x, _, _ in pieces), sum(len(x) for x, _, _ in pieces)
    matrix, at = np.zeros((n, width), dtype=np.int64), 0
    for x, _, _ in pieces:
        matrix[at : at + len(x), : x.shape[1]] = x
        at += len(x)
    ids, known = (np.concatenate([p[i] for p in pieces]) for i in (1, 2))
    blocks = []
    for start in range(0, n, BLOCK):
        block, order = make_block(start, *(x[start : start + BLOCK] for x in (matrix, ids, known)))
        for x, sorted_x in zip((matrix, ids, known), (block.matrix, block.ids, block.known), strict=True):
            x[start : start + BLOCK] = sorted_x
        blocks.append(block)
        kind, data = pack(block.matrix)
        yield (
            "block",
            part,
            start,
            len(block.ids),
            width,
            kind,
            data,
            block.ids.tobytes(),
            block.known.tobytes(),
            block.high.tobytes(),
            block.low.tobytes(),
            None,
            None,
            None,
        )
    yield ("range", part, 0, n, width, None, None, None, None, matrix.max(axis=0).tobytes(), matrix.min(axis=0).tobytes(), None, None, None)
    own = np.flatnonzero(known & (ids % every == 0))
    if len(own):
        tops = Tops(len(own), k)
        search(matrix[own], blocks, tops, own)
        kind, data = pack(matrix[own])
        hits = [dict(zip(("at", "query_id", "vec_id", "score"), h, strict=True)) for h in found(tops, own, ids[own])]
        yield (
            "query",
            part,
            0,
            len(own),
            width,
            kind,
            data,
            ids[own].tobytes(),
            None,
            None,
            None,
            tops.kth.tobytes(),
            own.astype(np.int32).tobytes(),
            hits,
        )


def arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def batch_of(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)


def build(df: DataFrame, id_col: str, vec_col: str, every: int, k: int) -> DataFrame:
    """The index, stored: rows of kind block, range and query."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").alias("vec")).where(F.col("vec").isNotNull() & finite)
    signs = F.array_join(F.transform(F.slice("vec", 1, SIGNS), lambda x: F.when(x < 0, "0").otherwise("1")), "")
    rows = rows.select(F.size("vec").alias("width"), signs.alias("signs"), "id", "vec")
    counted = rows.agg(F.sum("width")).first()[0] or 0
    most = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * counted // CELLS))
    order, kinds = ["width", "signs", "id"], arrow(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pieces, n, widest = TaskContext.get().partitionId() << 24, [], 0, 0
        for b in batches:
            widths = b.column("width").to_numpy()
            known = np.asarray(b.column("id").is_valid())
            ids, values = b.column("id").fill_null(0).to_numpy(zero_copy_only=False), b.column("vec").flatten().to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(widths), 0
            while at < len(widths):
                w = int(widths[at])
                run_end = at + int(np.argmax(widths[at:] != w)) if (widths[at:] != w).any() else len(widths)
                if n and (n + 1) * max(widest, w) > CELLS:
                    for row in range_rows(part, pieces, every, k):
                        yield batch_of([row], kinds)
                    part, pieces, n, widest = part + 1, [], 0, 0
                widest = max(widest, w)
                end = min(run_end, at + max(1, CELLS // max(widest, 1) - n))
                first = int(ends[at - 1]) if at else 0
                matrix = whole_numbers(values[first : int(ends[end - 1])], w) if w else np.zeros((end - at, 0), dtype=np.int64)
                pieces.append((matrix, ids[at:end], known[at:end]))
                n, at = n + end - at, end
        if n:
            for row in range_rows(part, pieces, every, k):
                yield batch_of([row], kinds)

    return durable(rows.repartitionByRange(int(most), *order).sortWithinPartitions(*order).mapInArrow(run, INDEX))


def sendings(queries: DataFrame, ranges: list, vectors: bool) -> DataFrame:
    """Rows (range, queries that can still improve there), for ranges of a bounded list; without `vectors`, only which meet."""
    lists = [(r["part"], np.frombuffer(r["high"], dtype=np.int64), np.frombuffer(r["low"], dtype=np.int64)) for r in ranges]
    kinds = arrow(SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q in b.to_pylist():
                matrix = unpack(q["cell"], q["data"], q["n"], q["width"])
                at, ids, kth = (np.frombuffer(q[c], dtype=d) for c, d in (("at", np.int32), ("ids", np.int64), ("kth", np.int64)))
                for part, high, low in lists:
                    who = np.flatnonzero(bounds(matrix, high, low) >= kth) if part != q["part"] else []
                    if len(who):
                        kind, data = pack(matrix[who]) if vectors else (None, None)
                        more = [x[who].tobytes() if vectors else None for x in (ids, kth, at)]
                        yield batch_of([(part, q["part"], len(who), q["width"], kind, data, *more)], kinds)

    return queries.mapInArrow(run, SENT)


def score_chunk(blocks: pa.Table, sent: pa.Table, k: int, kinds: pa.Schema) -> pa.Table:
    """One chunk of queries through the blocks of one range."""
    if not (blocks.num_rows and sent.num_rows):
        return pa.Table.from_batches([batch_of([], kinds)])
    made = []
    for b in sorted(blocks.to_pylist(), key=lambda b: b["start"]):
        arrays = [np.frombuffer(b[c], dtype=d) for c, d in (("ids", np.int64), ("known", bool), ("high", np.int64), ("low", np.int64))]
        made.append(Block(b["start"], unpack(b["cell"], b["data"], b["n"], b["width"]), *arrays))
    out = []
    for q in sent.to_pylist():
        tops = Tops(q["n"], k)
        # what a query has found at home bounds what it needs here
        tops.kth = np.frombuffer(q["kth"], dtype=np.int64).copy()
        search(unpack(q["cell"], q["data"], q["n"], q["width"]), made, tops)
        at, ids = np.frombuffer(q["at"], dtype=np.int32), np.frombuffer(q["ids"], dtype=np.int64)
        out += [(q["home"], *hit) for hit in found(tops, at, ids)]
    return pa.Table.from_batches([batch_of(out, kinds)])


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row whose id is divisible by `every`."""
    index = build(df, id_col, vec_col, every, k)
    queries, ranges = index.where("kind = 'query'"), index.where("kind = 'range'")
    hits = queries.select(F.col("part").alias("home"), F.inline("found"))
    counted = index.agg(
        F.count(F.when(F.col("kind") == "range", 1)).alias("ranges"),
        F.sum(F.when(F.col("kind") == "query", F.col("n") * F.greatest("width", F.lit(1)))).alias("cells"),
    ).first()
    chunks, lists = -(-(counted["cells"] or 0) // CELLS), -(-counted["ranges"] // RANGES)
    chunk = F.pmod(F.hash("home"), F.lit(max(chunks, 1)))

    kinds = arrow(HIT)

    def run(blocks: pa.Table, sent: pa.Table) -> pa.Table:
        return score_chunk(blocks, sent, k, kinds)

    for i in range(lists if chunks else 0):
        # at most twice RANGES rows or so of a few hundred bytes
        some = ranges.where(F.pmod(F.xxhash64("part"), F.lit(lists)) == i).select("part", "high", "low").collect()
        meet = sendings(
            queries.select("part", "n", "width", "cell", "data", "ids", "kth", "at"),
            some,
            False,
        ).select("part", chunk.alias("chunk")).distinct()
        blocks = index.where("kind = 'block'").join(meet, "part").select(
            "part",
            "chunk",
            "start",
            "n",
            "width",
            "cell",
            "data",
            "ids",
            "known",
            "high",
            "low",
        )
        sent = sendings(queries.select("part", "n", "width", "cell", "data", "ids", "kth", "at"), some, True).withColumn("chunk", chunk)
        hits = hits.unionByName(blocks.groupBy("part", "chunk").cogroup(sent.groupBy("part", "chunk")).applyInArrow(run, HIT))
    best = Window.partitionBy("home", "at").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
