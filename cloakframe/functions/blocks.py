"""Two tables that meet by key, for tests that are no equality: small keys by lists, crowded ones in pairs of blocks.

The right side's rows are counted by key. Keys of up to SMALL rows become one list each, which every row of the
left meets by a plain join and tests by array functions: all in the JVM, a row out for a row in. A
key with more is dealt over blocks of bounded size on either side; each pair of blocks is one
group of a task, so no task holds a key that a third of all rows share, and no row is made for a pair.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import durable

#: Rows to a block; rows of a key that are tested as a list; crowded keys that are broadcast.
BLOCK, SMALL, FEW = 4096, 256, 50_000


def crowded(right: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with more than SMALL rows, at most rows / SMALL of them; None if there are none."""
    many = durable(right.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select(*keys))
    n = many.count()
    return None if not n else F.broadcast(many) if n <= FEW else many


def with_lists(left: DataFrame, right: DataFrame, keys: list[str], many: DataFrame | None) -> DataFrame:
    """Rows of `left` with keys that are not crowded, and `near`, the rows of `right` with that key (an array of structs, empty if none)."""
    values = F.struct(*[c for c in right.columns if c not in keys])
    if many is not None:
        left, right = left.join(many, keys, "left_anti"), right.join(many, keys, "left_anti")
    lists = right.groupBy(*keys).agg(F.collect_list(values).alias("near"))
    joined = left.join(lists, keys, "left")
    return joined.withColumn("near", F.coalesce("near", F.array().cast(lists.schema["near"].dataType)))


def meet(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    test: Callable[[pa.Table, pa.Table], pa.Table],
    fields: str,
    size: int | None = None,
    part: str = "all",
) -> DataFrame:
    """What `test` makes of every pair of blocks of `left` and `right` rows with equal keys. The rows of either side are distinct.

    part: "all" blocks of `right`, only its "first" block of every key, or the "rest". Rows
    of `left` whose key `right` lacks reach the test with an empty table of `right` in part first or all.

    The work goes by pairs, not by bytes, so the pairs of blocks are dealt over the session's shuffle
    partitions by number: a few megabytes of rows would else be merged into one task with all their pairs.
    """
    size = size or BLOCK
    sizes = lambda df, name: df.groupBy(*keys).agg((1 + F.floor(F.count("*") / size)).cast("int").alias(name))
    plan = sizes(left, "__l").join(sizes(right, "__r"), keys, "left").withColumn("__r", F.coalesce("__r", F.lit(1)))
    rows = lambda df, n: df.join(plan, keys).withColumn("__d", F.pmod(F.xxhash64(F.struct(*df.columns)), F.col(n)).cast("int"))
    wanted = {
        "all": F.sequence(F.lit(0), F.col("__r") - 1),
        "first": F.array(F.lit(0)),
        "rest": F.when(F.col("__r") > 1, F.sequence(F.lit(1), F.col("__r") - 1)),
    }[part]
    one = rows(left, "__l").withColumn("__i", F.col("__d")).withColumn("__j", F.explode(wanted))
    two = rows(right, "__r").withColumn("__j", F.col("__d")).where({"all": F.lit(True), "first": F.col("__j") == 0, "rest": F.col("__j") > 0}[part])
    two = two.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__l") - 1)))
    by = [*keys, "__i", "__j"]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one, two = one.select(*by, *[c for c in left.columns if c not in keys]), two.select(*by, *[c for c in right.columns if c not in keys])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return test(a, b)

    return one.repartition(tasks, *by).groupBy(*by).cogroup(two.repartition(tasks, *by).groupBy(*by)).applyInArrow(run, fields)
