"""Keys that compare as text, keyed digests, and rounding."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "<NA>"


def as_key(c: Column | str) -> Column:
    """The value as text; null equals null, and the text <NA>."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def key_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only `columns`, as keys."""
    return df.select(*[as_key(c).alias(c) for c in columns])


def rate(part: Column, whole: Column) -> Column:
    """part / whole rounded to 6 places; 0 where whole is 0."""
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def hmac_hex(secret: bytes, message: str) -> str:
    return hmac.digest(secret, message.encode("utf-8"), "sha256").hex()


def keyed_digest(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lowercase hex; null stays null.

    The secret travels inside the function's code to the workers, never as a literal of a
    plan, which explain, the web page and event logs would show.
    """
    digest = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else hmac_hex(secret, t)), "string")
    return digest(message)


def identifier_key(entity: Column, value: Column) -> Column:
    """E-mail addresses and postcodes ignore case; other entities are compared verbatim.

    On what the patterns of these two allow, this is Python's case folding: beside ASCII, a
    pattern that ignores case takes the long s (U+017F) and the Kelvin sign only.
    """
    return F.when(entity.isin("EMAIL", "POSTCODE"), F.translate(F.lower(value), "\u017f", "s")).otherwise(value)


#: Digits of the digests by which a tree's leaves, and the parts above them, are grouped.
LEVELS = (6, 4, 2)


def tree_digest(df: DataFrame, line: Column) -> str:
    """One SHA-256 over the sorted lines of a table, by way of digests of parts of parts: no task sees all rows.

    The first parts go by six digits of each line's digest, so that parts stay small.
    """
    rows = df.select(F.sha2(line, 256).alias("d"))
    for digits in LEVELS:
        rows = rows.groupBy(F.substring("d", 1, digits).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ","), 256).alias("d"))
        # a part keeps its place in the tree: its prefix goes before its digest
        rows = rows.select(F.concat("p", "d").alias("d"))
    parts = sorted(r["d"] for r in rows.collect())
    return hashlib.sha256(",".join(parts).encode()).hexdigest()
