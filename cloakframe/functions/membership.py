"""Left joins that move only rows that may find a partner.

A bitmap of one bit for each of a bounded number of hash values is made by partial aggregates of the keys of the
smaller side and broadcast; rows whose bit is not set pass where they are read. Rows whose
bit is set, those with a partner and a small share of others, are joined by a shuffle. A
side that is small by count is broadcast itself, so that no row moves at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of a side that is broadcast whole; bits for each key; the most bits of a bitmap (32 MB).
FEW, FEW_BYTES, BITS, MOST_BITS = 20_000, 8 << 20, 16, 1 << 28
#: Bits to a row of a bitmap, as Spark's bitmap functions lay them out.
ROW_BITS = 32_768


def place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap(side: DataFrame, key: str, bits: int) -> DataFrame:
    """bucket, bits: one row of 4 KB for each ROW_BITS hash values that occur."""
    at = side.select(place(F.col(key), bits).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def is_set(bits: Column, at: Column) -> Column:
    """Whether a bit of a bitmap's row is 1; false where there is no row."""
    position = F.bitmap_bit_position(at)
    byte = F.substr(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.coalesce(F.try_mod(F.floor(value / F.pow(F.lit(2), position % 8)), F.lit(2)) == 1, F.lit(False))


def bits_for(keys: int) -> int:
    """The size of a bitmap for so many keys."""
    bits = ROW_BITS
    while bits < MOST_BITS and bits < BITS * keys:
        bits *= 2
    return bits


def marked(rows: DataFrame, side: DataFrame, key: str, keys: int) -> tuple[DataFrame, Column]:
    """`rows` with a column __bits, and whether a row's key may be among the `keys` keys of `side`."""
    bits = bits_for(keys)
    map_ = F.broadcast(bitmap(side, key, bits).withColumnsRenamed({"bucket": "__bucket", "bits": "__bits"}))
    at = place(F.col(key), bits)
    out = rows.join(map_, F.bitmap_bucket_number(at) == F.col("__bucket"), "left").drop("__bucket")
    return out, is_set(F.col("__bits"), at) & F.col(key).isNotNull()


def of_kind(side: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """`side` with its key in the kind that `rows` has: hashes depend on it."""
    return side.withColumn(key, F.col(key).try_cast(rows.schema[key].dataType))


def may_hold(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """The rows whose key `side` (one row a key) has, and perhaps a small share of others; no row moves."""
    side = of_kind(side.select(key), key, rows)
    n = side.count()
    if n <= FEW:
        return rows.join(F.broadcast(side), key, "left_semi")
    out, may = marked(rows, side, key, n)
    return out.where(may).drop("__bits")


def left_join(rows: DataFrame, side: DataFrame, key: str, weight: Column) -> DataFrame:
    """`rows` with the columns of `side`, which has one row a key; null keys have no partner.

    weight: about how many bytes a row of `side` takes.
    """
    side = of_kind(side, key, rows)
    size = side.agg(F.count("*").alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("bytes")).first()
    if size["n"] <= FEW and size["bytes"] <= FEW_BYTES:
        return rows.join(F.broadcast(side), key, "left")
    both, may = marked(rows, side, key, size["n"])
    moved = both.where(may).drop("__bits").join(side, key, "left")
    kinds = dict(side.dtypes)
    stay = both.where(~may).drop("__bits").withColumns({c: F.lit(None).cast(kinds[c]) for c in side.columns if c != key})
    return moved.unionByName(stay)
