"""Running sums and neighbours over a whole order, without one task that sees all rows.

Values are dealt over ranges whose bounds are quantiles of the column, at most
`RANGES` numbers. Windows run inside ranges; a small table with one row a range
carries what lies before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def bounds(df: DataFrame, column: str, count: int = RANGES) -> list[float]:
    """Quantiles of a numeric column: a bounded list."""
    found = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    return sorted(set(found.stat.approxQuantile("v", [i / count for i in range(1, count)], 0.25 / count)))


def key_bounds(df: DataFrame, column: str, count: int) -> list:
    """Cuts of a column of any kind that has an order, text among them: from a sample of 64 values a range, drawn by digests."""
    drawn = df.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(column), column).limit(64 * count).collect()
    values = sorted(r[0] for r in drawn)
    return sorted({values[len(values) * i // count] for i in range(1, count)}) if values else []


def order_bounds(df: DataFrame, columns: list[str], count: int) -> list[Column]:
    """Cuts of the order of several columns, nulls first, as structs: from a sample of 64 rows a range, drawn by digests."""
    if count < 2:
        return []
    rows = df.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(64 * count).orderBy(*columns).collect()
    picked = dict.fromkeys(tuple(rows[len(rows) * i // count]) for i in range(1, count)) if rows else {}
    kinds = {c: df.schema[c].dataType for c in columns}
    return [F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(columns, cut, strict=True)]) for cut in picked]


def order_range(columns: list[str], limits: list[Column]) -> Column:
    """How many cuts of `order_bounds` are at most a row."""
    if not limits:
        return F.lit(0)
    own = F.struct(*columns)
    return F.size(F.filter(F.array(*limits), lambda b: b <= own))


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a numeric column (the mean of the middle two), null and NaN left out.

    Values are counted by range first; only those of the one or two middle ranges are ordered.
    """
    values = df.select(F.col(f"`{column}`").cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count("*").alias("n"))
    limits = bounds(values, "v")
    rows = values.withColumn("r", range_of(F.col("v"), limits))
    # one row a range
    sums = sorted((x["r"], x["n"]) for x in rows.groupBy("r").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sums)
    if not total:
        return None
    found = []
    for rank in {(total - 1) // 2, total // 2}:
        ahead = 0
        for r, n in sums:
            if rank < ahead + n:
                break
            ahead += n
        upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        inside = rows.where(F.col("r") == r).withColumn("upto", F.sum("n").over(upto))
        found.append(inside.where(F.col("upto") > rank - ahead).agg(F.min("v").alias("v")).first()["v"])
    return sum(found) / len(found)


def range_of(c: Column, limits: list[float]) -> Column:
    """How many bounds are at most c: found through the sorted bounds, in the JVM."""
    if not limits:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, limits)), lambda b: b <= c))


#: Bounds that are compared one by one.
STEP = 32


def place_of(c: Column, limits: list[list[float]], which: Column) -> Column:
    """As `range_of`, among the list of bounds that `which` names (from 0): first through every STEP-th bound, then through the STEP behind it."""
    each = lambda x: F.split(F.lit(",".join(map(repr, x))), ",").cast("array<double>") if x else F.array().cast("array<double>")
    pick = lambda lists: F.get(F.array(*map(each, lists)), which)
    ahead = F.size(F.filter(pick([x[STEP - 1 :: STEP] for x in limits]), lambda b: b <= c)) * STEP
    return ahead + F.size(F.filter(F.slice(pick(limits), ahead + 1, STEP), lambda b: b <= c))


def before(df: DataFrame, range_col: str, total: Column, name: str, *keys: str) -> DataFrame:
    """keys, range and the sum of `total` over all ranges before it."""
    sums = df.groupBy(*keys, range_col).agg(total.alias("__t"))
    w = Window.partitionBy(*keys).orderBy(range_col).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, range_col, F.coalesce(F.sum("__t").over(w), F.lit(0)).alias(name))
