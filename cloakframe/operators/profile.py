"""Column roles and table profiles."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P

ROLES = ("identifier", "quasi_identifier", "sensitive", "general", "free_text")
STRATEGY = {
    "identifier": "regenerate",
    "free_text": "block_v0_1",
    "quasi_identifier": "joint_synthesis",
    "sensitive": "joint_synthesis",
    "general": "joint_synthesis",
}


@dataclass(frozen=True)
class PrivacyProfile:
    """Thresholds that guards and audits use."""

    name: str
    min_dataset: int
    min_group: int
    rare_k: int
    max_near_copy: float
    row_level_allowed: bool = False


PROFILES = {
    p.name: p for p in (
        PrivacyProfile("research", 10, 5, 5, 0.02),
        PrivacyProfile("clinical", 30, 10, 10, 0.01),
        PrivacyProfile("enterprise", 20, 10, 10, 0.015),
    )
}


#: The rules by name, in the order in which they decide.
NAME_RULES = (("identifier", P.IDENTIFIER_NAMES), ("quasi_identifier", P.QUASI_NAMES), ("sensitive", P.SENSITIVE_NAMES))


def roles_of(names: DataFrame, long: Column | None = None) -> DataFrame:
    """`names` (name, ...) with role and strategy; `long` says which columns hold free text, which comes after identifiers."""
    low = F.lower(F.trim("name"))
    fits = [F.when(F.exists(F.array(*map(F.lit, patterns)), lambda p: F.rlike(low, p)), role) for role, patterns in NAME_RULES]
    if long is not None:
        fits.insert(1, F.when(long, "free_text"))
    strategy = F.create_map(*[F.lit(x) for kv in STRATEGY.items() for x in kv])
    return names.withColumn("role", F.coalesce(*fits, F.lit("general"))).withColumn("strategy", strategy[F.col("role")])


def classify_columns(df: DataFrame) -> DataFrame:
    """name, role, strategy by column name alone, computed over the schema as a table."""
    return roles_of(df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string"))


@lru_cache(maxsize=4096)
def role_of(name: str) -> str:
    """The role of one column's name, where a plan has to know it; as classify_columns gives it."""
    spoken = name.strip().lower()
    return next((role for role, patterns in NAME_RULES if re.compile("|".join(f"(?:{p})" for p in patterns)).search(spoken)), "general")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    """Booleans do not count as numbers here."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def unpivoted(row: DataFrame, columns: list[str], fields: dict[str, str], name: str = "name") -> DataFrame:
    """One row a column from one wide row whose columns are called field__column."""
    each = [F.struct(F.lit(c).alias(name), *[F.col(f"`{f}__{c}`").cast(kind).alias(f) for f, kind in fields.items()]) for c in columns]
    return row.select(F.inline(F.array(*each))) if each else row.sparkSession.createDataFrame(
        [],
        f"{name} string, " + ", ".join(f"{f} {k}" for f, k in fields.items()),
    )


def free_text_columns(df: DataFrame) -> DataFrame:
    """name, mean_length, p90_length, free_text of every string column, from one aggregate."""
    columns = string_columns(df)
    size = lambda c: F.length(F.col(f"`{c}`"))
    wide = df.agg(
        F.lit(1),
        *[x for c in columns for x in (F.avg(size(c)).alias(f"mean_length__{c}"), F.percentile(size(c), 0.9).alias(f"p90_length__{c}"))],
    )
    out = unpivoted(wide, columns, {"mean_length": "double", "p90_length": "double"})
    return out.withColumn("free_text", F.coalesce((F.col("mean_length") > 60) | (F.col("p90_length") > 160), F.lit(False)))


def profile_table(df: DataFrame, approximate: float | None = None) -> DataFrame:
    """name, dtype, role, strategy, non_null, unique, unique_ratio for every column, from one pass of aggregates.

    Exact distinct counts shuffle the distinct values of every column; `approximate`, a
    relative error, counts by sketches instead, which wide or large tables need.
    """
    texts = string_columns(df)
    values = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        unique = F.count_distinct(col) if approximate is None else F.approx_count_distinct(col, approximate)
        values += [F.count(col).alias(f"non_null__{c}"), unique.alias(f"unique__{c}")]
        size = F.length(col) if c in texts else F.lit(None).cast("int")
        values += [F.avg(size).alias(f"mean_length__{c}"), F.percentile(size, 0.9).alias(f"p90_length__{c}")]
    fields = {"non_null": "bigint", "unique": "bigint", "mean_length": "double", "p90_length": "double"}
    out = unpivoted(df.agg(*values), df.columns, fields)
    kinds = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    out = roles_of(out, F.coalesce((F.col("mean_length") > 60) | (F.col("p90_length") > 160), F.lit(False)))
    ratio = F.round(F.col("unique") / F.greatest(F.col("non_null"), F.lit(1)), 6)
    return out.select("name", kinds[F.col("name")].alias("dtype"), "role", "strategy", "non_null", "unique", ratio.alias("unique_ratio"))


def role_counts(profile: DataFrame) -> DataFrame:
    """role, columns for every role; roles without columns have 0."""
    domain = profile.sparkSession.createDataFrame([(r,) for r in ROLES], "role string")
    return domain.join(
        profile.groupBy("role").agg(F.count("*").alias("columns")),
        "role",
        "left",
    ).select("role", F.coalesce("columns", F.lit(0)).cast("bigint").alias("columns"))


def drop_identifiers(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Without the columns that are identifiers by name, or by `roles`."""
    roles = roles or {}
    return df.select(*[f"`{c}`" for c in df.columns if roles.get(c, role_of(c)) != "identifier"])
