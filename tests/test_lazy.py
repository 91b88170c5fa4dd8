"""Functions over series are given few rows at a time, whatever the batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cloakframe.functions import lazy


def test_results_leave_slice_by_slice(spark):
    """The rows a function holds at one time do not grow with the batch, and stay in order, also if there are none."""
    size = lazy.vectorised("int")(lambda x: pd.Series([len(x)] * len(x)))
    pair = lazy.vectorised("struct<n:int,s:bigint>")(lambda x, y: pd.DataFrame({"n": [len(x)] * len(x), "s": x + y}))

    @lazy.vectorised("bigint")
    def plus(batches):
        for b in batches:
            assert len(b) <= lazy.SLICE
            yield b + 1

    @lazy.vectorised("bigint")
    def sums(batches):
        for x, y in batches:
            assert len(x) == len(y) <= lazy.SLICE
            yield x + y

    rows = spark.range(0, 1000, 1, 1).select("id", sums("id", "id").alias("d"), size("id").alias("n"), plus("id").alias("p"), pair("id", F.col("id") * 2).alias("q"))
    got = rows.collect()
    assert max(r.n for r in got) == max(r.q.n for r in got) == lazy.SLICE
    assert [(r.d, r.p, r.q.s) for r in got] == [(2 * r.id, r.id + 1, 3 * r.id) for r in got]
    assert rows.where("id < 0").count() == 0
