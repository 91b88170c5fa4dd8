"""Experiment records and their summaries."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import durable
from .audit import audit_tagged
from .synth import SEED, synthesize_seeds

# The metrics of each benchmark that a comparison shows.
PRIMARY = {
    "membership-v0": ("auc",),
    "longitudinal-linkage-v0": ("linkage_rate", "precision"),
    "fuzzy-longitudinal-v0": ("linkage_rate", "precision"),
    "k-anonymity-v0": ("min_class", "unique_rate", "below_k_rate"),
    "quasi-k-anonymity-v0": ("min_class", "unique_rate", "below_k_rate"),
}


#: The least rows of an experiment's table.
LEAST_ROWS = 20


def suite_problems(suite: str, seeds: list, experiments: list[dict]) -> list[str]:
    """What is wrong with a suite's settings, as codes: name, seeds, and each experiment's id, kind and rows."""
    whole = lambda x: type(x) is int
    times = Counter(e.get("id") for e in experiments)
    found = {
        "no_suite_name": not (isinstance(suite, str) and suite.strip()),
        "no_seeds": not seeds,
        "seed_not_whole": any(not whole(s) for s in seeds),
        "seed_repeated": len({str(s) for s in seeds}) < len(seeds),
        "no_experiments": not experiments,
        "experiment_without_id": any(not isinstance(i, str) or not i for i in times),
        "experiment_id_repeated": any(n > 1 for n in times.values()),
        "unknown_kind": any(e.get("kind", "audit") != "audit" for e in experiments),
        "too_few_rows": any(not whole(e.get("rows", LEAST_ROWS)) or e.get("rows", LEAST_ROWS) < LEAST_ROWS for e in experiments),
    }
    return [code for code, wrong in found.items() if wrong]


def run_suite(tables: dict[str, DataFrame], suite: str, seeds: list[int], experiments: list[dict]) -> DataFrame:
    """The records of every experiment (id, table, roles) under every seed; refused if the settings are wrong."""
    if problems := suite_problems(suite, seeds, experiments):
        raise ValueError(", ".join(problems))
    out = None
    for e in experiments:
        one = run_seed_suite(tables[e["table"]], e["id"], seeds, roles=e.get("roles"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("suite", F.lit(suite))


def run_seed_suite(df: DataFrame, experiment: str, seeds: list[int], backend: str = "demo", roles: dict[str, str] | None = None) -> DataFrame:
    """experiment_id, seed, metrics (a map) for every seed: synthesis and the audit of its result, all seeds in the same jobs."""
    if len(set(seeds)) != len(seeds) or not all(isinstance(s, int) and not isinstance(s, bool) for s in seeds) or not seeds:
        raise ValueError("seeds are distinct whole numbers")
    if df.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ValueError("an experiment needs 20 rows at least")
    names = ("exact_row_overlap", "identifier_overlap", "quasi_combo_overlap", "rare_quasi_overlap", "near_copy_rate")
    # stored, because every measure reads it
    made = durable(synthesize_seeds(df, backend, seeds, roles))
    audits = audit_tagged(df, made, SEED, roles=roles)
    metrics = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))], F.lit("audit_passed"), F.col("passed").cast("double"))
    return audits.select(
        F.lit(experiment).alias("experiment_id"),
        F.col(SEED).cast("int").alias("seed"),
        F.map_filter(metrics, lambda k, v: v.isNotNull()).alias("metrics"),
    ).orderBy(F.array_position(F.array(*map(F.lit, seeds)), F.col("seed")))


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """experiment_id, metric, n, mean, sd (0 for one run), ci_low, ci_high; the duration counts as a metric."""
    duration = F.create_map(F.lit("duration_seconds"), F.col("duration_seconds").cast("double"))
    values = runs.select("experiment_id", F.explode(F.map_concat("metrics", duration)).alias("metric", "v")).where("v is not null")
    out = values.groupBy("experiment_id", "metric").agg(
        F.count("*").alias("n"),
        F.avg("v").alias("m"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("s"),
    )
    half = 1.96 * F.col("s") / F.sqrt("n")
    return out.select(
        "experiment_id",
        "metric",
        "n",
        F.round("m", 8).alias("mean"),
        F.round("s", 8).alias("sd"),
        F.round(F.col("m") - half, 8).alias("ci_low"),
        F.round(F.col("m") + half, 8).alias("ci_high"),
    )


def comparison_table(results: DataFrame) -> DataFrame:
    """benchmark, metric, value: the primary metrics of known benchmarks, else the first four by name."""
    table = results.sparkSession.createDataFrame([(b, m) for b, each in PRIMARY.items() for m in each], "benchmark string, metric string")
    values = results.select("benchmark", F.explode("metrics").alias("metric", "value"))
    known = values.join(F.broadcast(table), ["benchmark", "metric"], "left_semi")
    others = values.join(F.broadcast(table), "benchmark", "left_anti")
    w = Window.partitionBy("benchmark").orderBy("metric")
    return known.unionByName(others.withColumn("__n", F.row_number().over(w)).where("__n <= 4").drop("__n")).select("benchmark", "metric", "value")


def boundary_summary(records: DataFrame) -> DataFrame:
    """baseline, cases, attack_success_rate, authorised_success_rate, accuracy of records (baseline, expected, observed)."""
    attack, wanted = F.col("expected") == "deny", F.col("expected") == "allow"
    through = F.col("observed") == "allow"
    share = lambda part, whole: F.round(F.try_divide(F.count_if(part), F.count_if(whole)), 6)
    return records.groupBy("baseline").agg(
        F.count("*").alias("cases"),
        share(attack & through, attack).alias("attack_success_rate"),
        share(wanted & through, wanted).alias("authorised_success_rate"),
        F.round(F.avg((F.col("expected") == F.col("observed")).cast("int")), 6).alias("accuracy"),
    )
