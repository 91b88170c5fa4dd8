"""Profiles from sketches that are stored by part of a table and merged for any parts of it.

A part (a day, a source, a file) is read once: counts, a HyperLogLog sketch of the values and a KLL
sketch of the numbers (or the lengths of texts) of every column, all in one pass of plain aggregates, whatever the number of columns. A profile of any
set of parts, or of parts added later, merges a few kilobytes a part and column.

Defined results: null values are counted, not sketched; NaN and infinities count as values but have no
rank. A part may be null. An empty table has no parts, and a profile of no parts has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of the sketches, as powers of two: relative errors of about 0.8 % of a distinct count and 0.4 % of the rows of a rank.
HLL_SIZE, KLL_SIZE = 14, 800


def ranked(df: DataFrame, column: str) -> Column:
    """What a column's quantiles are over: numbers as doubles, lengths of texts; null for other kinds."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.NumericType):
        v = c.cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return F.length(c).cast("double") if isinstance(kind, T.StringType) else F.lit(None).cast("double")


def column_sketches(df: DataFrame, *by: Column) -> DataFrame:
    """part (a struct of `by`), name, dtype, n, non_null, distinct_sketch, rank_sketch for every part and column, from one pass."""
    part = F.struct(*[c.alias(f"p{i}") for i, c in enumerate(by)]) if by else F.struct(F.lit(0).alias("p0"))
    values: list[Column] = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        values += [
            F.count(col).alias(f"c{i}"),
            F.hll_sketch_agg(col.cast("string"), F.lit(HLL_SIZE)).alias(f"h{i}"),
            F.kll_sketch_agg_double(ranked(df, c), F.lit(KLL_SIZE)).alias(f"k{i}"),
        ]
    wide = df.groupBy(part.alias("part")).agg(*values)
    each = [
        F.struct(
            F.lit(c).alias("name"),
            F.lit(t).alias("dtype"),
            "n",
            F.col(f"c{i}").alias("non_null"),
            F.col(f"h{i}").alias("distinct_sketch"),
            F.col(f"k{i}").alias("rank_sketch"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return wide.select("part", F.inline(F.array(*each)))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """name, dtype (by the columns of `by`), n, non_null and both sketches of all given parts together: sketches again."""
    keys = [*by, "name", "dtype"]
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("non_null").alias("non_null"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("rank_sketch", F.lit(KLL_SIZE)).alias("rank_sketch"),
    )


def estimates(sketches: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.9)) -> DataFrame:
    """name, dtype, n, non_null, unique, unique_ratio, quantiles (null where nothing is ranked) of merged sketches."""
    ranked_n = F.kll_sketch_get_n_double("rank_sketch")
    at = F.kll_sketch_get_quantile_double("rank_sketch", F.array(*map(F.lit, quantiles)))
    unique = F.least(F.hll_sketch_estimate("distinct_sketch"), F.col("non_null"))
    out = sketches.withColumns({"unique": F.when(F.col("non_null") > 0, unique).otherwise(0), "quantiles": F.when(ranked_n > 0, at)})
    ratio = F.round(F.col("unique") / F.greatest(F.col("non_null"), F.lit(1)), 6)
    return out.withColumn("unique_ratio", ratio).drop("distinct_sketch", "rank_sketch")
