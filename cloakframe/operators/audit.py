"""What a synthetic table shares with its source."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.keys import as_key, key_columns
from ..functions.ranges import exact_median
from ..sources.shared import durable
from .profile import PROFILES, PrivacyProfile, free_text_columns, numeric_columns, role_of

#: Rows whose distances are held at one time.
STRIP = 256
#: Codes of an audit, in their order.
CODES = (
    "backend_not_approved",
    "profile_disallows_row_level",
    "exact_row_overlap",
    "identifier_overlap",
    "rare_quasi_overlap",
    "free_text_present",
    "near_copy_rate",
)


def columns_of(df: DataFrame, role: str, roles: dict[str, str] | None = None) -> list[str]:
    roles = roles or {}
    return [c for c in df.columns if roles.get(c, role_of(c)) == role]


def counted(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def shared_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct rows of `left` whose keys `right` has; null equals null.

    Both sides grow with the table and compress well, so Spark would take them for small enough
    to broadcast by their shuffled bytes, through the driver: they are merged, never broadcast.
    """
    same = [F.lit(True), *[F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]]
    return left.distinct().alias("l").join(right.distinct().hint("merge").alias("r"), same, "left_semi")


def exact_row_overlap(raw: DataFrame, syn: DataFrame) -> DataFrame:
    """exact_row_overlap: distinct rows that both tables have, on shared columns; null equals null."""
    shared = [c for c in raw.columns if c in syn.columns]
    keys = [f"k{i}" for i in range(len(shared))]
    return counted(shared_rows(key_columns(raw, shared).toDF(*keys), key_columns(syn, shared).toDF(*keys), keys), "exact_row_overlap")


def identifier_overlap(raw: DataFrame, syn: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """identifier_overlap: distinct shared values, summed over identifier columns; nulls do not count."""
    shared = [c for c in columns_of(raw, "identifier", roles) if c in syn.columns]
    if not shared:
        return raw.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("identifier_overlap"))
    values = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in shared]))).where("v is not null")
    return counted(shared_rows(values(raw), values(syn), ["c", "v"]), "identifier_overlap")


def quasi_columns(raw: DataFrame, syn: DataFrame, quasi: list[str] | None, roles: dict[str, str] | None) -> list[str]:
    return [c for c in (quasi if quasi is not None else columns_of(raw, "quasi_identifier", roles)) if c in raw.columns and c in syn.columns]


def quasi_combo_overlap(raw: DataFrame, syn: DataFrame, quasi: list[str] | None = None, roles: dict[str, str] | None = None) -> DataFrame:
    """quasi_combo_overlap: distinct combinations of quasi-identifiers that both tables have."""
    shared = quasi_columns(raw, syn, quasi, roles)
    if not shared:
        return raw.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("quasi_combo_overlap"))
    keys = [f"k{i}" for i in range(len(shared))]
    return counted(shared_rows(key_columns(raw, shared).toDF(*keys), key_columns(syn, shared).toDF(*keys), keys), "quasi_combo_overlap")


def rare_quasi_overlap(raw: DataFrame, syn: DataFrame, k: int, quasi: list[str] | None = None, roles: dict[str, str] | None = None) -> DataFrame:
    """rare_quasi_overlap: combinations with fewer than k source rows that the synthetic table has too."""
    shared = quasi_columns(raw, syn, quasi, roles)
    if not shared:
        return raw.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("rare_quasi_overlap"))
    keys = [f"k{i}" for i in range(len(shared))]
    rare = key_columns(raw, shared).toDF(*keys).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") < k)
    return counted(shared_rows(rare.select(*keys), key_columns(syn, shared).toDF(*keys), keys), "rare_quasi_overlap")


def is_near(a: pa.Table, b: pa.Table, limit: float) -> pa.Table:
    """id, near: for every row of a block whether one of the other block's is nearer than the limit."""
    x, y = (np.stack(t.column("z").to_pylist()) if t.num_rows else np.zeros((0, 1)) for t in (a, b))
    near = np.zeros(len(x), bool)
    for at in range(0, len(x) if len(y) else 0, STRIP):
        apart = np.zeros((len(x[at : at + STRIP]), len(y)))
        for i in range(x.shape[1]):
            apart += (x[at : at + STRIP, i, None] - y[None, :, i]) ** 2
        near[at : at + STRIP] = (np.sqrt(apart) < limit).any(axis=1)
    return pa.table({"id": a.column("id"), "near": near})


def crowded_copies(made: DataFrame, real: DataFrame, bins: list[str], limit: float) -> DataFrame:
    """The columns of `made` that are neither bins nor places, and near, of distinct synthetic rows in crowded bins: the first block of a bin first, others only for rows without a hit."""
    made = durable(made.withColumn("id", F.monotonically_increasing_id()))
    test = lambda a, b: is_near(a, b, limit)
    asked, fields = made.select(*bins, "id", "z"), "id bigint, near boolean"
    first = durable(blocks.meet(asked, real, bins, test, fields, part="first"))
    todo = first.groupBy("id").agg(F.bool_or("near").alias("near")).where("not near").select("id")
    rest = blocks.meet(asked.join(todo, "id", "left_semi"), real, bins, test, fields, part="rest")
    hits = first.unionByName(rest).groupBy("id").agg(F.bool_or("near").alias("near"))
    return made.join(hits, "id").drop("id", "z", *bins)


def near_copy_rate(
    raw: DataFrame,
    syn: DataFrame,
    columns: list[str] | None = None,
    roles: dict[str, str] | None = None,
    sample: float | None = None,
    seed: int = 0,
    tag: str | None = None,
) -> DataFrame:
    """near_copy_rate (by `tag`, a column of `syn`): the share of synthetic rows nearer to a source row than the threshold; null without columns.

    Exact: rows are binned by the threshold in up to three of the dimensions (those with
    most distinct values) and each synthetic row meets the source rows of its own and the
    neighbouring bins only: as a list where they are few, else in blocks. Equal rows meet once. `sample` takes a seeded share of either side.
    """
    roles = roles or {}
    by = [F.col(tag).alias("__tag")] if tag else []
    cols = columns or [c for c in numeric_columns(raw) if c in numeric_columns(syn) and roles.get(c, role_of(c)) != "identifier"]
    if not cols:
        if tag:
            return syn.select(tag).distinct().select(tag, F.lit(None).cast("double").alias("near_copy_rate"))
        return raw.sparkSession.range(1).select(F.lit(None).cast("double").alias("near_copy_rate"))
    number = lambda c: F.col(f"`{c}`").cast("double")
    gaps = lambda df: df.agg(*[F.count_if(number(c).isNull()).alias(str(i)) for i, c in enumerate(cols)]).first()
    counts = raw.agg(*[F.approx_count_distinct(number(c)).alias(str(i)) for i, c in enumerate(cols)]).first()
    lacking = [a or b for a, b in zip(gaps(raw), gaps(syn), strict=True)]
    # medians only fill gaps
    middle = [exact_median(raw, c) if n else None for c, n in zip(cols, lacking, strict=True)]
    filled = lambda c, i: F.coalesce(number(c), F.lit(middle[i])) if lacking[i] else number(c)
    stats = raw.agg(*[x for i, c in enumerate(cols) for x in (F.avg(filled(c, i)).alias(f"m{i}"), F.stddev_pop(filled(c, i)).alias(f"s{i}"))]).first()
    z = F.array(*[(filled(c, i) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) + 0.0 for i, c in enumerate(cols)]).alias("z")
    real, made = raw.select(z), syn.select(*by, z)
    if sample is not None:
        pick = lambda df: df.where(F.pmod(F.xxhash64(F.lit(seed), "z"), F.lit(1_000_000)) < int(sample * 1_000_000))
        real, made = pick(real), pick(made)
    limit = max(0.05 * math.sqrt(len(cols)), 0.05)
    binned = sorted(range(len(cols)), key=lambda i: -counts[str(i)])[:3]
    bins = [f"b{i}" for i in binned]
    bin_ = lambda i: F.floor(F.col("z")[i] / limit)
    # a source row stands in its own bin and those beside it; a synthetic row asks its own bin only
    real = real.distinct()
    for i in binned:
        real = real.withColumn(f"b{i}", F.explode(F.array(bin_(i) - 1, bin_(i), bin_(i) + 1)))
    tags = ["__tag"] * len(by)
    made = made.groupBy(*tags, "z").agg(F.count("*").alias("n")).withColumns({f"b{i}": bin_(i) for i in binned})
    many = blocks.crowded(real, bins)
    apart = lambda y: F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col("z")[i] - y["z"][i], 2) for i in range(len(cols))]))
    told = blocks.with_lists(made, real, bins, many).select(*tags, "n", F.exists("near", lambda y: apart(y) < limit).alias("near"))
    if many is not None:
        told = told.unionByName(crowded_copies(made.join(many, bins, "left_semi"), real.join(many, bins, "left_semi"), bins, limit))
    out = told.groupBy(*tags).agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("near"), F.col("n"))), F.lit(0)).alias("near"))
    return out.select(
        *[F.col(t).alias(tag) for t in tags],
        F.when(F.col("all") > 0, F.round(F.col("near") / F.col("all"), 6)).alias("near_copy_rate"),
    )


def shared_by_tag(raw: DataFrame, syn: DataFrame, tag: str, name: str) -> DataFrame:
    """tag, name: how many distinct rows of `syn` (tag, k0, k1, ...) `raw` (k0, k1, ...) has, for tags that share any."""
    return shared_rows(syn, raw, raw.columns).groupBy(tag).agg(F.count("*").alias(name))


def audit_tagged(
    raw: DataFrame,
    syn: DataFrame,
    tag: str,
    approved: bool = False,
    profile: PrivacyProfile = PROFILES["research"],
    roles: dict[str, str] | None = None,
) -> DataFrame:
    """tag, the measures of `audit_release` and passed, for every synthetic table in `syn`, which `tag` tells apart: all in the same joins."""
    roles = roles or {}
    made = syn.drop(tag)
    own = F.col(f"`{tag}`")

    def keyed(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
        return df.select(*more, *[as_key(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(columns)])

    shared = [c for c in raw.columns if c in made.columns]
    named = [c for c in columns_of(raw, "identifier", roles) if c in made.columns]
    quasi = quasi_columns(raw, made, None, roles)
    parts = [shared_by_tag(keyed(raw, shared), keyed(syn, shared, own), tag, "exact_row_overlap")]
    if named:
        values = lambda df, *more: df.select(*more, F.inline(F.array(*[F.struct(F.lit(c).alias("k0"), F.col(f"`{c}`").cast("string").alias("k1")) for c in named]))).where("k1 is not null")
        parts.append(shared_by_tag(values(raw), values(syn, own), tag, "identifier_overlap"))
    if quasi:
        combos = keyed(raw, quasi)
        rare = combos.groupBy(*combos.columns).agg(F.count("*").alias("n")).where(F.col("n") < profile.rare_k).drop("n")
        parts += [shared_by_tag(keyed(df, quasi) if df is raw else df, keyed(syn, quasi, own), tag, n) for df, n in ((raw, "quasi_combo_overlap"), (rare, "rare_quasi_overlap"))]
    out = syn.select(own).distinct()
    for part in [*parts, near_copy_rate(raw, syn, roles=roles, tag=tag)]:
        out = out.join(part, tag, "left")
    counts = ("exact_row_overlap", "identifier_overlap", "quasi_combo_overlap", "rare_quasi_overlap")
    out = out.select(tag, *[(F.coalesce(c, F.lit(0)) if c in out.columns else F.lit(0)).cast("bigint").alias(c) for c in counts], "near_copy_rate")
    texts = free_text_names(raw, roles)
    none = [F.col(c) == 0 for c in ("exact_row_overlap", "identifier_overlap", "rare_quasi_overlap")]
    near = ~F.coalesce(F.col("near_copy_rate") > profile.max_near_copy, F.lit(False))
    return out.crossJoin(F.broadcast(texts)).withColumn(
        "passed",
        reduce(lambda a, b: a & b, [F.lit(approved), F.lit(profile.row_level_allowed), *none, near, F.size("free_text_columns") == 0]),
    )


def free_text_names(raw: DataFrame, roles: dict[str, str]) -> DataFrame:
    """free_text_columns: one row with the sorted names of columns of free text, by content or by `roles`."""
    named = [c for c in raw.columns if roles.get(c) == "free_text"]
    found = free_text_columns(raw).where("free_text").agg(F.sort_array(F.collect_list("name")).alias("n"))
    plain = [c for c in raw.columns if role_of(c) != "identifier" and c not in roles]
    texts = F.array_sort(
        F.array_union(
            F.filter("n", lambda x: x.isin(plain)) if plain else F.array().cast("array<string>"),
            F.array(*map(F.lit, named)).cast("array<string>"),
        )
    )
    return found.select(texts.alias("free_text_columns"))


def audit_release(
    raw: DataFrame,
    syn: DataFrame,
    approved: bool = False,
    profile: PrivacyProfile = PROFILES["research"],
    quasi: list[str] | None = None,
    roles: dict[str, str] | None = None,
) -> DataFrame:
    """One row: all measures, free_text_columns, reason_codes and passed."""
    one = exact_row_overlap(raw, syn)
    for part in (
        identifier_overlap(raw, syn, roles),
        quasi_combo_overlap(raw, syn, quasi, roles),
        rare_quasi_overlap(raw, syn, profile.rare_k, quasi, roles),
        near_copy_rate(raw, syn, roles=roles),
    ):
        one = one.crossJoin(part)
    one = one.crossJoin(free_text_names(raw, roles or {}))
    flags = (
        F.lit(not approved),
        F.lit(not profile.row_level_allowed),
        F.col("exact_row_overlap") > 0,
        F.col("identifier_overlap") > 0,
        F.col("rare_quasi_overlap") > 0,
        F.size("free_text_columns") > 0,
        F.coalesce(F.col("near_copy_rate") > profile.max_near_copy, F.lit(False)),
    )
    codes = F.array_compact(F.array(*[F.when(f, F.lit(c)) for f, c in zip(flags, CODES, strict=True)]))
    return one.withColumn("backend_approved", F.lit(approved)).withColumn("reason_codes", codes).withColumn("passed", F.size("reason_codes") == 0)
