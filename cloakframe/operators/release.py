"""Release decisions, approvals and artifact checks as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.keys import tree_digest
from ..sources.tables import stage_release
from .pii import scan_table
from .profile import PROFILES, PrivacyProfile, drop_identifiers
from .stats import GuardError, aggregate_pii_guard, describe_numeric, release_safe_describe

# Purposes and their disclosure modes.
PURPOSES = {
    "schema_only": ("schema", "columns", "types", "inspect"),
    "synthetic": ("explore", "distribution", "prototype", "code_generation", "visualize"),
    "local_exact": ("describe", "correlation", "group_summary", "regression", "exact_statistics"),
}
#: What to do about a code, in the order in which it is told; the last line is always told.
ACTIONS = (
    ("exact_row_overlap", "synthesise again, more strongly, until no source row is copied"),
    ("identifier_overlap", "leave direct identifiers out of synthesis and make them up or drop them"),
    ("rare_quasi_overlap", "generalise or suppress rare combinations of quasi-identifiers and audit again"),
    ("near_copy_rate", "add noise or generalise until near copies are below the threshold"),
    ("free_text_present", "send free text through the local text path or drop it from row-level candidates"),
    ("backend_not_approved", "keep rows local until the backend has evidence for release"),
    ("profile_disallows_row_level", "have a policy reviewed before row-level release is enabled"),
    ("direct_pii_detected", "remove or generalise every identity or contact cue that is left"),
    ("source_number_reuse", "replace exact numbers, dates and codes by broad descriptions"),
    ("character_ngram_reuse", "rewrite more abstractly, without the source's phrasing"),
    ("distinctive_token_reuse", "generalise distinctive names, rare terms, places and roles"),
    ("output_too_short", "say more, without adding identity cues"),
)
LAST_ACTION = "continue with the aggregate fallback where row-level release is not justified"


def decide_release(requests: DataFrame) -> DataFrame:
    """requests (release_class, audit_passed, aggregate_validated) with allow and reason; the default is to deny."""
    c, passed = F.col("release_class"), F.col("audit_passed")
    validated = F.coalesce("aggregate_validated", F.lit(False))
    reason = (
        F.when(c.isin("raw", "pseudonymized"), "source_rows_stay_local")
        .when((c == "aggregate") & validated, "aggregate_validated")
        .when(c == "aggregate", "aggregate_not_validated")
        .when((c == "synthetic") & passed.isNull(), "audit_missing")
        .when((c == "synthetic") & ~passed, "audit_failed")
        .when(c == "synthetic", "rows_locked_by_policy")
        .otherwise("no_rule")
    )
    return requests.withColumn("allow", (reason == "aggregate_validated")).withColumn("reason", reason)


def route_purpose(df: DataFrame, purpose_col: str) -> DataFrame:
    """`df` with the normalised purpose and its mode; unknown purposes are blocked."""
    table = df.sparkSession.createDataFrame([(p, m) for m, each in PURPOSES.items() for p in each], "__p string, mode string")
    named = df.withColumn("purpose_key", F.regexp_replace(F.lower(F.trim(purpose_col)), "[- ]", "_"))
    return named.join(
        F.broadcast(table),
        F.col("purpose_key") == F.col("__p"),
        "left",
    ).drop("__p").withColumn("mode", F.coalesce("mode", F.lit("block")))


def next_actions(df: DataFrame, id_col: str, codes_col: str) -> DataFrame:
    """id, actions: what each reason code asks for, in a fixed order, and the constant last one."""
    table = df.sparkSession.createDataFrame([(c, i, a) for i, (c, a) in enumerate(ACTIONS)], "code string, rank int, action string")
    told = df.select(id_col, F.explode(F.array_distinct(codes_col)).alias("code")).join(F.broadcast(table), "code")
    lists = told.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "action"))), lambda x: x["action"]).alias("a"))
    return df.select(id_col).join(lists, id_col, "left").select(
        id_col,
        F.concat(F.coalesce("a", F.array().cast("array<string>")), F.array(F.lit(LAST_ACTION))).alias("actions"),
    )


def evaluate_row_release(
    evidence: DataFrame,
    near: float = P.MAX_NEAR_COPY,
    auc: float = P.MAX_AUC,
    uplift: float = P.MAX_UPLIFT,
    linkage: float = P.MAX_LINKAGE,
) -> DataFrame:
    """`evidence` with failed_conditions, criteria_satisfied and release_allowed, which is always false."""
    if not all(0 <= x <= 1 for x in (near, auc, uplift, linkage)):
        raise ValueError("thresholds lie between 0 and 1")
    code = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    limited = lambda c, most, missing, name: F.when(F.col(c).isNull(), F.lit(missing)).when(F.col(c) > most, F.lit(name))
    checks = [
        code(~F.col("backend_approved"), "backend_not_approved"),
        code(F.col("direct_pii_hits") != 0, "direct_pii_detected"),
        code(F.col("exact_row_overlap") != 0, "exact_row_overlap"),
        code(F.col("identifier_overlap") != 0, "identifier_overlap"),
        code(F.col("rare_quasi_overlap") != 0, "rare_quasi_overlap"),
        limited("near_copy_rate", near, "near_copy_evidence_missing", "near_copy_rate"),
        limited("membership_max_auc", auc, "membership_evidence_missing", "membership_attack_signal"),
        limited("attribute_inference_uplift", uplift, "attribute_inference_evidence_missing", "attribute_inference_signal"),
        limited("longitudinal_linkage_rate", linkage, "longitudinal_evidence_missing", "longitudinal_linkage_signal"),
        code(~F.col("benchmark_reproducible"), "benchmark_not_reproducible"),
        code(~F.col("policy_reviewed"), "policy_not_reviewed"),
        code(~F.col("human_review_recorded"), "human_review_missing"),
    ]
    out = evidence.withColumn("failed_conditions", F.array_compact(F.array(*checks)))
    return out.withColumn("criteria_satisfied", F.size("failed_conditions") == 0).withColumn("release_allowed", F.lit(False))


FLAGS = ("backend_approved", "benchmark_reproducible", "policy_reviewed", "human_review_recorded")
COUNTS = ("direct_pii_hits", "exact_row_overlap", "identifier_overlap", "rare_quasi_overlap")
RATES = {"near_copy_rate": 0.0, "membership_max_auc": 0.0, "attribute_inference_uplift": -1.0, "longitudinal_linkage_rate": 0.0}


def validate_evidence(lines: DataFrame, json_col: str) -> DataFrame:
    """`lines` with reject_reason: strict types, no missing or unknown fields, counts and rates in range; null if valid."""
    obj, fields = F.col(json_col), (*FLAGS, *COUNTS, *RATES)
    keys = F.json_object_keys(obj)
    # what a field's JSON type is shows in how it is written
    written = lambda f: F.regexp_extract(obj, rf'"{f}"\s*:\s*("[^"]*"|[^,}}\s]+)', 1)
    reason = F.when(keys.isNull(), "malformed").when(
        F.size(F.array_except(F.array(*map(F.lit, fields)), keys)) > 0,
        "missing_field",
    ).when(F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) > 0, "unknown_field")
    for f in FLAGS:
        reason = reason.when(~written(f).isin("true", "false"), f"{f}_not_boolean")
    for f in COUNTS:
        reason = reason.when(~written(f).rlike(r"^[0-9]+$"), f"{f}_not_a_count")
    for f, least in RATES.items():
        value = written(f).try_cast("double")
        reason = reason.when(
            (written(f) != "null") & (~written(f).rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$") | value.isNull() | (value < least) | (value > 1)),
            f"{f}_out_of_range",
        )
    return lines.withColumn("reject_reason", reason)


def final_scan_gate(df: DataFrame, allow: bool, roles: dict[str, str] | None = None) -> DataFrame:
    """allow, pii_hits, passed of one payload after its identifier columns are dropped."""
    hits = scan_table(drop_identifiers(df, roles)).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("pii_hits"))
    return hits.select(F.lit(allow).alias("allow"), "pii_hits", (F.lit(allow) & (F.col("pii_hits") == 0)).alias("passed"))


LOCAL = "status string, release_class string, reason string"


def resolve_release(
    df: DataFrame,
    staged: bool,
    profile: PrivacyProfile = PROFILES["research"],
    decimals: int = 2,
    folder: str | None = None,
) -> DataFrame:
    """name, ..., status, reason: row-level if staged, else the aggregate fallback, else LOCAL_ONLY with what stopped it.

    With a folder, the fallback is staged there: a payload that its final scan clears, and the manifest.
    """
    spark = df.sparkSession
    if staged:
        return spark.createDataFrame([("READY", "row_level", None)], LOCAL)
    try:
        out = aggregate_pii_guard(release_safe_describe(describe_numeric(df, profile), profile.min_group, profile.min_group, decimals))
    except GuardError as e:
        return spark.createDataFrame([("LOCAL_ONLY", None, str(e))], LOCAL)
    if folder is not None and not stage_release(out, True, folder).first()["allow_after_final_scan"]:
        return spark.createDataFrame([("LOCAL_ONLY", None, "the final scan found direct identifiers")], LOCAL)
    return out.withColumn("status", F.lit("READY")).withColumn("release_class", F.lit("aggregate")).withColumn("reason", F.lit(None).cast("string"))


def issue_approvals(artifacts: DataFrame, manifests: DataFrame, purpose: str) -> DataFrame:
    """artifacts (dir, name, sha256) that a manifest of their directory clears, with the purpose."""
    if not purpose.strip():
        raise ValueError("an approval needs a purpose")
    clear = manifests.where(F.col("allow") & F.col("allow_after_final_scan") & (F.col("release_class") == "aggregate") & F.col("final_scan.passed"))
    on = [artifacts["dir"] == clear["dir"], artifacts["name"] == clear["artifact"], artifacts["sha256"] == clear["artifact_sha256"]]
    return artifacts.join(clear, on, "left_semi").withColumn("purpose", F.lit(purpose.strip()))


def match_approvals(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """requests (path, sha256, purpose) with decision, reason and the latest matching approval_id."""
    w = Window.partitionBy("path", "sha256", "purpose").orderBy(F.col("ledger_pos").desc())
    latest = ledger.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("path", "sha256", "purpose", "approval_id")
    out = requests.join(latest, ["path", "sha256", "purpose"], "left")
    found = F.col("approval_id").isNotNull()
    return out.withColumn("decision", F.when(found, "allow").otherwise("deny")).withColumn(
        "reason",
        F.when(found, "approved").otherwise("no_matching_approval"),
    )


def list_approved(ledger: DataFrame, current: DataFrame, purpose: str) -> DataFrame:
    """path, sha256 whose most recent approval for a purpose still equals the file's present digest."""
    last = ledger.where(F.col("purpose") == purpose).groupBy("path").agg(F.max_by("sha256", "ledger_pos").alias("sha256"))
    return last.join(current.select("path", "sha256"), ["path", "sha256"], "left_semi")


def access_events(matched: DataFrame, at: str) -> DataFrame:
    """Event rows of matched requests; no payload is in them."""
    return matched.select(F.lit(at).cast("timestamp").alias("at"), "path", "purpose", "decision", "reason", "approval_id")


def verify_artifacts(manifest: DataFrame, actual: DataFrame, set_sha256: str | None = None) -> DataFrame:
    """path, problem (null if sound) for every manifest row, against actual (path, sha256, bytes).

    With the digest of the whole set, a last row without a path tells whether the manifest is that set: rows
    taken out or added show there.
    """
    p = F.col("path")
    outside = p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)") | p.rlike(r"^[A-Za-z]:")
    joined = manifest.join(actual.select("path", F.col("sha256").alias("__sha"), F.col("bytes").alias("__bytes")), "path", "left")
    problem = (
        F.when(p.isNull() | F.col("sha256").isNull() | ~F.col("sha256").rlike("^[0-9a-f]{64}$") | (F.col("bytes") < 0), "invalid_artifact_record")
        .when(outside, "path_outside_run")
        .when(F.col("__sha").isNull(), "missing")
        .when((F.col("__sha") != F.col("sha256")) | (F.col("__bytes") != F.col("bytes")), "sha256_mismatch")
    )
    out = joined.select("path", problem.alias("problem"))
    if set_sha256 is None:
        return out
    same = set_digest(manifest).first()["set_sha256"] == set_sha256
    return out.unionByName(manifest.sparkSession.createDataFrame([(None, None if same else "set_mismatch")], "path string, problem string"))


def set_digest(artifacts: DataFrame) -> DataFrame:
    """set_sha256: one digest over the set of (path, sha256, bytes), whatever their order; see keys.tree_digest."""
    line = F.concat_ws("\0", "path", "sha256", F.col("bytes").cast("string"))
    return artifacts.sparkSession.createDataFrame([(tree_digest(artifacts, line),)], "set_sha256 string")
