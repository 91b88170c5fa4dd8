"""Exact statistics with small-cell rules, and aggregates that limit disclosure."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gram
from . import pii
from .profile import PrivacyProfile, numeric_columns, role_of, unpivoted

RESEARCH = PrivacyProfile("research", 10, 5, 5, 0.02)


class GuardError(ValueError):
    """A dataset or a column that the rules refuse."""


def safe_columns(df: DataFrame, roles: dict[str, str] | None = None) -> list[str]:
    """Numeric columns that are no identifiers."""
    roles = roles or {}
    return [c for c in numeric_columns(df) if roles.get(c, role_of(c)) != "identifier"]


def guarded(df: DataFrame, n: int, least: int) -> None:
    if n < least:
        raise GuardError(f"the dataset has {n} rows; {least} are needed")


def describe_numeric(df: DataFrame, profile: PrivacyProfile = RESEARCH, roles: dict[str, str] | None = None) -> DataFrame:
    """name, n_rows, n, mean, std, min, max for every safe column, from one aggregate."""
    columns = safe_columns(df, roles)
    values = [F.count("*").alias("n_rows")]
    for c in columns:
        col = F.col(f"`{c}`").cast("double")
        values += [
            F.count(col).alias(f"n__{c}"),
            F.avg(col).alias(f"mean__{c}"),
            F.stddev_samp(col).alias(f"std__{c}"),
            F.min(col).alias(f"min__{c}"),
            F.max(col).alias(f"max__{c}"),
        ]
    row = df.agg(*values).first()
    guarded(df, row["n_rows"], profile.min_dataset)
    one = df.sparkSession.createDataFrame([row.asDict()], df.limit(0).agg(*values).schema)
    out = unpivoted(
        one.withColumns({f"n_rows__{c}": F.col("n_rows") for c in columns}),
        columns,
        {"n_rows": "bigint", "n": "bigint", "mean": "double", "std": "double", "min": "double", "max": "double"},
    )
    return out


def correlation_matrix(df: DataFrame, profile: PrivacyProfile = RESEARCH, roles: dict[str, str] | None = None) -> DataFrame:
    """a, b, correlation (pairwise complete, rounded to 6, null if undefined) for all pairs a <= b.

    One pass takes means and extrema, a second products of centred values, as matrices; NaN counts as missing.
    """
    columns = safe_columns(df, roles)
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    first = gram.columns_summary(df, values) if len(columns) > 1 else None
    guarded(df, df.count() if first is None else first["n"], profile.min_dataset)
    schema = "a string, b string, correlation double"
    if first is None:
        return df.sparkSession.createDataFrame([], schema)
    gaps = [i for i, n in enumerate(first["count"]) if n < first["n"]]
    found = gram.pairwise_correlation(df, values, first["mean"], gaps)
    rows = [(a, b, None if math.isnan(found[i, j]) else round(float(found[i, j]), 6)) for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    return df.sparkSession.createDataFrame(rows, schema)


def group_summary(df: DataFrame, group_by: str, value: str, profile: PrivacyProfile = RESEARCH, roles: dict[str, str] | None = None) -> DataFrame:
    """group, n, mean, std by group; groups with fewer than the least size of values are left out; null is a group."""
    roles = roles or {}
    for c in (group_by, value):
        if roles.get(c, role_of(c)) == "identifier":
            raise GuardError(f"{c} is an identifier")
    if value not in numeric_columns(df):
        raise GuardError(f"{value} is not numeric")
    v = F.col(value).cast("double")
    out = df.groupBy(F.col(group_by).alias("group")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    return out.where(F.col("n") >= profile.min_group)


def rare_level_guard(df: DataFrame, column: str, profile: PrivacyProfile = RESEARCH, most: int = 50) -> DataFrame:
    """column, levels, smallest, allowed: too many levels or one below the least group size (null is a level) forbid a predictor."""
    sizes = df.groupBy(column).count()
    out = sizes.agg(F.count("*").alias("levels"), F.coalesce(F.min("count"), F.lit(0)).alias("smallest"))
    return out.select(
        F.lit(column).alias("column"),
        "levels",
        "smallest",
        ((F.col("levels") <= most) & (F.col("smallest") >= profile.min_group)).alias("allowed"),
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's rule."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's distribution."""
    x = df / (df + t * t)
    if x >= 1:
        return 1.0
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_quantile(p: float, df: float) -> float:
    """The t with P(|T| > t) = 2 (1 - p), by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


def ols(df: DataFrame, outcome: str, predictors: list[str], profile: PrivacyProfile = RESEARCH, roles: dict[str, str] | None = None) -> DataFrame:
    """term, coef, se, statistic, p, ci_low, ci_high, nobs, r2, adj_r2 on complete cases.

    Text predictors become indicators of their levels (first of the sorted left out);
    the guard on rare levels applies. Sums of products are one matrix of (terms + 1)^2
    numbers, reduced by BLAS in every task, and the normal equations are solved from those.
    """
    roles, numeric = roles or {}, numeric_columns(df)
    for c in (outcome, *predictors):
        if roles.get(c, role_of(c)) == "identifier":
            raise GuardError(f"{c} is an identifier")
    if outcome not in numeric:
        raise GuardError(f"{outcome} is not numeric")
    terms, columns = ["const"], [F.lit(1.0)]
    for c in predictors:
        if c in numeric:
            terms.append(c)
            columns.append(F.col(f"`{c}`").cast("double"))
            continue
        if not rare_level_guard(df, c, profile).first()["allowed"]:
            raise GuardError(f"{c} has too many or too rare levels")
        # at most 50 levels, by the guard
        levels = sorted(r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().collect())
        for level in levels[1:]:
            terms.append(f"{c}[{level}]")
            columns.append(F.when(F.col(c) == level, 1.0).otherwise(0.0))
    complete, k = df.dropna(subset=[outcome, *predictors]), len(terms)
    every = [*columns, F.col(f"`{outcome}`").cast("double")]
    # centred on the means of one earlier pass, for sums that keep their digits
    means = gram.columns_summary(complete, every)
    n = means["n"] if means else 0
    guarded(df, n, max(profile.min_dataset, k + 1))
    centre = np.where(np.arange(k + 1) == 0, 0.0, means["mean"])
    products = gram.reduce_rows(complete, every, [("sum", lambda x: (x - centre).T @ (x - centre))])[0].reshape(k + 1, k + 1)
    right, yy = products[:k, k], products[k, k]
    inverse = np.linalg.inv(products[:k, :k])
    beta = inverse @ right
    rest = n - k
    residual = max(yy - beta @ right, 0.0)
    # back from centred predictors to the intercept of the plain ones
    shift = np.eye(k)
    shift[0, 1:] = -centre[1:k]
    beta, cov = shift @ beta, shift @ inverse @ shift.T * residual / rest
    beta[0] += centre[k]
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    r2 = 1 - residual / yy if yy else float("nan")
    wide = t_quantile(0.975, rest)
    rows = []
    for i, term in enumerate(terms):
        t = beta[i] / se[i] if se[i] else float("nan")
        rows.append(
            (
                term,
                float(beta[i]),
                float(se[i]),
                float(t),
                float(t_two_sided(t, rest)) if se[i] else None,
                float(beta[i] - wide * se[i]),
                float(beta[i] + wide * se[i]),
                n,
                float(r2),
                float(1 - (1 - r2) * (n - 1) / rest),
            )
        )
    schema = "term string, coef double, se double, statistic double, p double, ci_low double, ci_high double, nobs bigint, r2 double, adj_r2 double"
    return df.sparkSession.createDataFrame(rows, schema)


#: The columns of a release whose texts are ranges of counts.
RANGED = ("n_rows_bucket", "n_bucket")


def without_ranges(released: DataFrame) -> DataFrame:
    """`released` as scans see it: ranges of counts, as `release_safe_describe` writes them, are numbers and no texts.

    Written out, a range of ten thousand rows or more reads like a phone number. Whatever else stands in these columns is scanned.
    """
    def shown(c: str) -> Column:
        low, high = (F.regexp_extract(c, r"^([0-9]+)-([0-9]+)$", i).try_cast("bigint") for i in (1, 2))
        wide = high - low + 1
        return F.when(~F.coalesce((wide >= 10) & (F.try_mod(low, wide) == 0), F.lit(False)), F.col(c))

    return released.withColumns({c: shown(c) for c in RANGED if c in released.columns})


def release_safe_describe(described: DataFrame, least: int, bucket: int, decimals: int = 2) -> DataFrame:
    """name, n_rows_bucket, n_bucket, mean, std: no extrema, counts in ranges, rounded; refuses if nothing is left."""
    if least < 2 or not 0 <= decimals <= 6:
        raise ValueError("at least 2 values and 0 to 6 decimals")
    step = max(10, int(bucket))
    lower = lambda c: F.floor(F.col(c) / step) * step
    ranged = lambda c: F.concat_ws("-", lower(c).cast("string"), (lower(c) + step - 1).cast("string"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    out = described.where((F.col("n") >= least) & (F.col("n_rows") >= least) & finite("mean") & finite("std"))
    out = out.select(
        "name",
        ranged("n_rows").alias("n_rows_bucket"),
        ranged("n").alias("n_bucket"),
        F.round("mean", decimals).alias("mean"),
        F.round("std", decimals).alias("std"),
    )
    if not out.limit(1).count():
        raise GuardError("no column has enough values for a release")
    return out


def aggregate_pii_guard(result: DataFrame) -> DataFrame:
    """`result` if neither its names nor its texts hold direct identifiers; else an error that gives counts only."""
    hits = pii.scan_structured(without_ranges(result)).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("n")).first()["n"]
    if hits:
        raise GuardError(f"{hits} direct identifier pattern(s) in an aggregate result")
    return result
