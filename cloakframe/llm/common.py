"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.lazy import SLICE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of spark.checkpoint.dir.

    The session must name that folder; there is no other that executors are sure to share.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None:
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


class Remembered(dict):
    """A task's memory of results by text, bounded by the bytes of its keys and values, not by their number."""

    def __init__(self, most: int = 32 << 20) -> None:
        super().__init__()
        self.most, self.held = most, 0

    def keep(self, key, value, size: int):
        """Remember `value`; one that takes more than a thousandth of the bound is passed on only."""
        if size * 1000 <= self.most:
            # about what an entry takes beside its contents
            self.held += size + 150
            if self.held > self.most:
                self.clear()
                self.held = size + 150
            self[key] = value
        return value


def text_or_empty(column: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, comma-joined, in the given order."""
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def by_size(side: DataFrame, weight=None, bound: int = 50_000) -> DataFrame:
    """`side`, to be broadcast if its rows (and what `weight` adds for each) stay within the bound; else joined by a shuffle."""
    if weight is None:
        return F.broadcast(side) if side.limit(bound + 1).count() <= bound else side
    total = side.agg((F.count("*") + F.coalesce(F.sum(weight), F.lit(0))).alias("n")).first()["n"]
    return F.broadcast(side) if total <= bound else side


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[str], tuple]], fields: str) -> DataFrame:
    """Apply a function of the whole text to every row, in Arrow batches; ids pass unchanged.

    `make` runs once in each task and returns the function; `fields` is the DDL of
    what the function returns. Results leave by SLICE rows, so those of a batch are never
    held beside it. Other columns of the input never enter the plan.
    """
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    added = T.StructType.fromDDL(fields)
    kinds = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, max(len(b), 1), SLICE)):
            # one text at a time: a batch of very long texts is never held twice
            values = [f(t.as_py()) for t in b.column("text")]
            columns = list(zip(*values, strict=True)) if values else [[] for _ in added]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(c, type=k.type) for c, k in zip(columns, kinds, strict=True))],
                names=["id", *added.names],
            )

    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), *added])).withColumnRenamed("id", id_col)
