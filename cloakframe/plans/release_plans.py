"""Release decisions, ledgers, requests, experiments and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import experiments, release, requests
from ..sources.shared import new_folder
from ..streaming import streams
from . import attack_plans
from .base import SQL, query, table
from .text_plans import COUNTS_SQL, ENTITIES, SECRET, docs


def chosen(values: tuple, i) -> F.Column:
    """The value that a row's number picks."""
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def chosen_sql(values: tuple, i: str) -> str:
    return f"(['{"', '".join(values)}'])[CAST({i} % {len(values)} AS INTEGER) + 1]"


CLASSES = ("raw", "pseudonymized", "aggregate", "synthetic", "other")


@query(
    f"""WITH r AS (SELECT doc_id, {chosen_sql(CLASSES, 'doc_id')} AS c, quality = 1 AS passed, toxic = 0 AS valid FROM labels),
    d AS (SELECT doc_id, CASE WHEN c IN ('raw', 'pseudonymized') THEN 'source_rows_stay_local' WHEN c = 'aggregate' AND valid THEN 'aggregate_validated' WHEN c = 'aggregate' THEN 'aggregate_not_validated'
      WHEN c = 'synthetic' AND passed IS NULL THEN 'audit_missing' WHEN c = 'synthetic' AND NOT passed THEN 'audit_failed' WHEN c = 'synthetic' THEN 'rows_locked_by_policy' ELSE 'no_rule' END AS reason FROM r)
    SELECT doc_id, reason = 'aggregate_validated' AS allow, reason FROM d"""
)
def h2_decide_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(
        "doc_id",
        chosen(CLASSES, F.col("doc_id")).alias("release_class"),
        (F.col("quality") == 1).alias("audit_passed"),
        (F.col("toxic") == 0).alias("aggregate_validated"),
    )
    return release.decide_release(rows).select("doc_id", "allow", "reason")


PURPOSES = (" Schema", "explore", "code generation", "Group-Summary", "share", "describe ")


@query(f"SELECT doc_id, (['schema_only', 'synthetic', 'synthetic', 'local_exact', 'block', 'local_exact'])[CAST(doc_id % {len(PURPOSES)} AS INTEGER) + 1] AS mode FROM documents")
def h3_route_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", chosen(PURPOSES, F.col("doc_id")).alias("purpose"))
    return release.route_purpose(rows, "purpose").select("doc_id", "mode")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, 'READY' AS status, 'aggregate' AS release_class, true AS staged FROM customer" for c in ("c_custkey", "c_nationkey", "c_acctbal")))
def h4_resolve_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregate fallback over the whole table, staged with its manifest."""
    folder = new_folder(spark, "fallback")
    out = release.resolve_release(table(spark, sf_dir, "customer"), staged=False, folder=folder)
    manifest = spark.read.json(f"{folder}/manifest").select(F.col("allow_after_final_scan").alias("staged"))
    payload = spark.read.json(f"{folder}/payload").select("name")
    return out.join(payload, "name").crossJoin(F.broadcast(manifest)).select("name", "mean", "std", "status", "release_class", "staged")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    some = lambda n, over: F.when(i % n != 0, (i % over).cast("double") / 100)
    return docs(spark, sf_dir).select(
        "doc_id",
        (i % 2 == 0).alias("backend_approved"),
        (i % 3).alias("direct_pii_hits"),
        F.lit(0).cast("bigint").alias("exact_row_overlap"),
        (i % 2).alias("identifier_overlap"),
        F.lit(0).cast("bigint").alias("rare_quasi_overlap"),
        some(5, 3).alias("near_copy_rate"),
        some(7, 90).alias("membership_max_auc"),
        some(11, 20).alias("attribute_inference_uplift"),
        some(13, 9).alias("longitudinal_linkage_rate"),
        F.lit(True).alias("benchmark_reproducible"),
        (i % 5 > 0).alias("policy_reviewed"),
        F.lit(True).alias("human_review_recorded"),
    )


def limited_sql(n: int, over: int, limit: float, missing: str, name: str) -> str:
    return f"CASE WHEN doc_id % {n} = 0 THEN '{missing}' WHEN (doc_id % {over}) / 100.0 > {limit} THEN '{name}' END"


FAILED = f"""array_to_string(list_filter([CASE WHEN doc_id % 2 <> 0 THEN 'backend_not_approved' END, CASE WHEN doc_id % 3 <> 0 THEN 'direct_pii_detected' END, CASE WHEN doc_id % 2 <> 0 THEN 'identifier_overlap' END,
    {limited_sql(5, 3, P.MAX_NEAR_COPY, 'near_copy_evidence_missing', 'near_copy_rate')}, {
        limited_sql(7, 90, P.MAX_AUC, 'membership_evidence_missing', 'membership_attack_signal')
    },
    {
        limited_sql(11, 20, P.MAX_UPLIFT, 'attribute_inference_evidence_missing', 'attribute_inference_signal')
    }, {limited_sql(13, 9, P.MAX_LINKAGE, 'longitudinal_evidence_missing', 'longitudinal_linkage_signal')},
    CASE WHEN doc_id % 5 = 0 THEN 'policy_not_reviewed' END], lambda x: x IS NOT NULL), ',')"""


@query(f"SELECT doc_id, {FAILED} AS failed, {FAILED} = '' AS criteria_satisfied, false AS release_allowed FROM documents")
def h6_evaluate_row_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.evaluate_row_release(evidence(spark, sf_dir)).select(
        "doc_id",
        F.array_join("failed_conditions", ",").alias("failed"),
        "criteria_satisfied",
        "release_allowed",
    )


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'unknown_field' WHEN doc_id % 4 = 2 THEN 'policy_reviewed_not_boolean' WHEN doc_id % 4 = 3 THEN 'direct_pii_hits_not_a_count' END AS reject_reason FROM documents"""
)
def h7_validate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, i = evidence(spark, sf_dir), F.col("doc_id") % 4
    fields = [c for c in rows.columns if c != "doc_id"]
    sound = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    text = (
        F.when(i == 1, F.regexp_replace(sound, r"^\{", '{"extra":1,'))
        .when(i == 2, F.regexp_replace(sound, r'"policy_reviewed":(true|false)', '"policy_reviewed":"yes"'))
        .when(i == 3, F.regexp_replace(sound, r'"direct_pii_hits":[0-9]+', '"direct_pii_hits":-1'))
        .otherwise(sound)
    )
    return release.validate_evidence(rows.select("doc_id", text.alias("json")), "json").select("doc_id", "reject_reason")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of evidence, as the audits and attacks measure it on the splits of customer and part."""
    one = attack_plans.f1_exact_row_overlap(spark, sf_dir)
    for part in (
        attack_plans.f2_identifier_overlap(spark, sf_dir),
        attack_plans.f4_rare_quasi_overlap(spark, sf_dir),
        attack_plans.f5_near_copy_rate(spark, sf_dir),
        attack_plans.f7_membership_auc(spark, sf_dir).withColumnRenamed("auc", "membership_max_auc"),
        attack_plans.f13_attribute_inference(spark, sf_dir).select(F.col("uplift").alias("attribute_inference_uplift")),
        attack_plans.f14_longitudinal_linkage(spark, sf_dir).select(F.col("linkage_rate").alias("longitudinal_linkage_rate")),
        release.final_scan_gate(table(spark, sf_dir, "customer"), True).select(F.col("pii_hits").alias("direct_pii_hits")),
    ):
        # every side has one row
        one = one.crossJoin(F.broadcast(part))
    return one.withColumns({f: F.lit(f != "policy_reviewed") for f in release.FLAGS})


def one_of(name: str, column: str, alias: str) -> str:
    return f"(SELECT {column} AS {alias} FROM ({SQL[name]}))"


MEASURED = " CROSS JOIN ".join(
    one_of(*x)
    for x in (
        ("f1_exact_row_overlap", "exact_row_overlap", "exact_rows"),
        ("f2_identifier_overlap", "identifier_overlap", "identifiers"),
        ("f4_rare_quasi_overlap", "rare_quasi_overlap", "rare"),
        ("f5_near_copy_rate", "near_copy_rate", "near"),
        ("f7_membership_auc", "auc", "auc"),
        ("f13_attribute_inference", "uplift", "uplift"),
        ("f14_longitudinal_linkage", "linkage_rate", "linkage"),
    )
)
MEASURED_FAILED = f"""array_to_string(list_filter([CASE WHEN exact_rows <> 0 THEN 'exact_row_overlap' END, CASE WHEN identifiers <> 0 THEN 'identifier_overlap' END, CASE WHEN rare <> 0 THEN 'rare_quasi_overlap' END,
    CASE WHEN near IS NULL THEN 'near_copy_evidence_missing' WHEN near > {P.MAX_NEAR_COPY} THEN 'near_copy_rate' END, CASE WHEN auc IS NULL THEN 'membership_evidence_missing' WHEN auc > {P.MAX_AUC} THEN 'membership_attack_signal' END,
    CASE WHEN uplift IS NULL THEN 'attribute_inference_evidence_missing' WHEN uplift > {P.MAX_UPLIFT} THEN 'attribute_inference_signal' END,
    CASE WHEN linkage IS NULL THEN 'longitudinal_evidence_missing' WHEN linkage > {P.MAX_LINKAGE} THEN 'longitudinal_linkage_signal' END, 'policy_not_reviewed'], lambda x: x IS NOT NULL), ',')"""


@query(f"SELECT {MEASURED_FAILED} AS failed, false AS criteria_satisfied, CAST(NULL AS VARCHAR) AS reject_reason, auc AS membership_max_auc, near AS near_copy_rate FROM {MEASURED}")
def h6_evaluate_measured_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What F1 to F14 measure, validated as JSON (H7) and evaluated (H6)."""
    row = measured(spark, sf_dir)
    fields = [*release.FLAGS, *release.COUNTS, *release.RATES]
    told = release.validate_evidence(row.withColumn("json", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})), "json")
    return release.evaluate_row_release(told).select(
        F.array_join("failed_conditions", ",").alias("failed"),
        "criteria_satisfied",
        "reject_reason",
        "membership_max_auc",
        "near_copy_rate",
    )


@query("SELECT true AS allow, CAST(0 AS BIGINT) AS pii_hits, count(*) > 0 AS passed FROM customer")
def h8_final_scan_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.final_scan_gate(table(spark, sf_dir, "customer"), True)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: (dir, name, path, sha256, bytes)."""
    d = docs(spark, sf_dir)
    return d.select(
        "doc_id",
        F.col("source").alias("dir"),
        F.concat(F.lit("doc-"), "doc_id").alias("name"),
        F.concat_ws("/", "source", F.concat(F.lit("doc-"), "doc_id")).alias("path"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )


ELIGIBLE = "doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0"


@query(f"SELECT 'doc-' || doc_id AS name, source AS dir, 'teaching' AS purpose FROM documents WHERE {ELIGIBLE}")
def h9_issue_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, i = artifacts(spark, sf_dir), F.col("doc_id")
    sha = F.when(i % 7 == 0, F.lit("0" * 64)).otherwise(F.col("sha256"))
    scan = F.struct((i % 5 != 0).alias("passed"))
    manifests = files.select(
        "dir",
        F.col("name").alias("artifact"),
        sha.alias("artifact_sha256"),
        F.lit(True).alias("allow"),
        (i % 2 == 0).alias("allow_after_final_scan"),
        F.when(i % 3 != 0, "aggregate").otherwise("synthetic").alias("release_class"),
        scan.alias("final_scan"),
    )
    return release.issue_approvals(files, manifests, " teaching ").select("name", "dir", "purpose")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records for every document whose number 3 divides: the second has another digest if 2 divides it too."""
    files = artifacts(spark, sf_dir).where("doc_id % 3 = 0")
    first = files.select("doc_id", "path", "sha256", F.lit("teaching").alias("purpose"), (F.col("doc_id") * 2).alias("ledger_pos"))
    again = first.select(
        "doc_id",
        "path",
        F.when(F.col("doc_id") % 2 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"),
        "purpose",
        (F.col("ledger_pos") + 1).alias("ledger_pos"),
    )
    return first.unionByName(again).withColumn("approval_id", F.concat(F.lit("a-"), F.col("ledger_pos").cast("string")))


@query("SELECT source || '/doc-' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'allow' ELSE 'deny' END AS decision, CASE WHEN doc_id % 3 = 0 THEN 'a-' || (doc_id * 2 + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END) END AS approval_id FROM documents")
def h10_match_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = artifacts(spark, sf_dir).select("path", "sha256", F.lit("teaching").alias("purpose"))
    return release.match_approvals(asked, ledger(spark, sf_dir)).select("path", "decision", "approval_id")


@query("SELECT source || '/doc-' || doc_id AS path FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0")
def h11_list_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.list_approved(ledger(spark, sf_dir), artifacts(spark, sf_dir), "teaching").select("path")


@query("SELECT CAST('2026-01-01 00:00:00' AS TIMESTAMP) AS \"at\", source || '/doc-' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'approved' ELSE 'no_matching_approval' END AS reason FROM documents")
def h12_access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = artifacts(spark, sf_dir).select("path", "sha256", F.lit("teaching").alias("purpose"))
    return release.access_events(
        release.match_approvals(asked, ledger(spark, sf_dir)),
        "2026-01-01 00:00:00",
    ).select(F.col("at").cast("timestamp_ntz").alias("at"), "path", "reason")


@query(
    """SELECT CASE WHEN doc_id % 5 = 0 THEN '../' || source || '/doc-' || doc_id ELSE source || '/doc-' || doc_id END AS path,
    CASE WHEN doc_id % 5 = 0 THEN 'path_outside_run' WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 2 = 0 THEN 'sha256_mismatch' END AS problem FROM documents"""
)
def h13_verify_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, i = artifacts(spark, sf_dir), F.col("doc_id")
    manifest = files.withColumn(
        "path",
        F.when(i % 5 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path")),
    ).withColumn("sha256", F.when(i % 2 == 0, F.md5("sha256")).otherwise(F.col("sha256")))
    manifest = manifest.withColumn(
        "sha256",
        F.when(F.length("sha256") == 32, F.concat("sha256", "sha256")).otherwise(F.col("sha256")),
    ).select("path", "sha256", "bytes")
    return release.verify_artifacts(manifest, files.where("doc_id % 3 <> 0").select("path", "sha256", "bytes"))


@query(
    """SELECT problem, count(*) AS n FROM (SELECT CAST(NULL AS VARCHAR) AS problem FROM documents UNION ALL SELECT NULL
    UNION ALL SELECT NULL FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'set_mismatch') GROUP BY problem"""
)
def h13_verify_whole_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest that is whole, and one that lost every seventh row: each row is sound, the set is not."""
    files = artifacts(spark, sf_dir).select("doc_id", "path", "sha256", "bytes")
    whole = files.drop("doc_id")
    digest = release.set_digest(whole).first()["set_sha256"]
    both = release.verify_artifacts(whole, whole, digest).unionByName(
        release.verify_artifacts(files.where("doc_id % 7 <> 0").drop("doc_id"), whole, digest)
    )
    return both.groupBy("problem").agg(F.count("*").alias("n"))


HOST_SQL = r"nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '.'), '')"


@query(
    f"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, {HOST_SQL} AS host FROM pages)
    SELECT page_id, scheme, host, CASE scheme WHEN 'https' THEN 443 ELSE 80 END AS port, 'CUSTOM_OR_UNKNOWN_ENDPOINT' AS classification, true AS relay_possible, scheme || '://' || host AS endpoint FROM h"""
)
def i1_classify_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.classify_endpoints(table(spark, sf_dir, "pages").select("page_id", "url"), "url").select(
        "page_id",
        "scheme",
        "host",
        "port",
        "classification",
        "relay_possible",
        "endpoint",
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` as requests: the page is the body, a header and a query parameter carry a credential."""
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"))
    head = F.when(
        F.col("page_id") % 2 == 0,
        F.array(pair(" Authorization", "hidden"), pair("Content-Type", "Text/HTML; charset=utf-8")),
    ).otherwise(F.array(pair("accept", "*/*")))
    url = F.concat("url", F.when(F.col("url").contains("#"), "").when(F.col("url").contains("?"), "&access_token=1").otherwise("?code=2&x=1"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.lit("get").alias("method"),
        url.alias("url"),
        head.alias("headers"),
        F.array(F.struct(F.lit("s").alias("name"))).alias("cookies"),
        F.col("html").alias("body"),
    )


ASKED = f"""(SELECT page_id, {HOST_SQL} AS host, strlen(html) AS body_bytes, {' + '.join(ENTITIES)} AS pii_hits, CASE WHEN page_id % 2 = 0 THEN 'authorization' ELSE '' END AS sensitive_headers,
    CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN 'access_token' ELSE 'code' END AS sensitive_query,
    CASE WHEN page_id % 2 = 0 THEN 'text/html' END AS content_type FROM (SELECT page_id, url, html, {COUNTS_SQL} FROM (SELECT *, html AS text FROM pages)))"""


@query(f"SELECT page_id, host, 'GET' AS method, content_type, body_bytes, pii_hits, sensitive_headers, sensitive_query, CAST(1 AS BIGINT) AS cookies FROM {ASKED}")
def i2_inspect_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = requests.inspect_requests(asked(spark, sf_dir))
    return out.select(
        "page_id",
        "host",
        "method",
        "content_type",
        "body_bytes",
        "pii_hits",
        F.array_join("sensitive_headers", ",").alias("sensitive_headers"),
        F.array_join("sensitive_query", ",").alias("sensitive_query"),
        "cookies",
    )


@query(
    f"""SELECT count(*) AS entries, count(DISTINCT host) AS hosts, CAST(sum(body_bytes) AS BIGINT) AS body_bytes, CAST(sum(pii_hits) AS BIGINT) AS pii_hits,
    count(*) FILTER (sensitive_headers <> '') AS with_sensitive_headers, count(*) FILTER (sensitive_query <> '') AS with_sensitive_query FROM {ASKED}"""
)
def i3_summarize_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = requests.summarize_requests(requests.inspect_requests(asked(spark, sf_dir)))
    return out.drop("with_secret_fields")


@query(f"SELECT host, count(*) AS entries FROM {ASKED} GROUP BY host")
def i3_distinct_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.distinct_hosts(requests.inspect_requests(asked(spark, sf_dir)))


@query(
    """WITH r AS (SELECT source, doc_id % 3 = 0 AS approved FROM documents), d AS (SELECT source, bool_or(approved) AS open FROM r GROUP BY source),
    c AS (SELECT 'ledger' AS baseline, approved AS wanted, approved AS given FROM r UNION ALL SELECT 'directory', approved, open FROM r JOIN d USING (source))
    SELECT baseline, count(*) AS cases, round(count(*) FILTER (NOT wanted AND given) / CAST(nullif(count(*) FILTER (NOT wanted), 0) AS DOUBLE), 6) AS attack_success_rate,
    round(count(*) FILTER (wanted AND given) / CAST(nullif(count(*) FILTER (wanted), 0) AS DOUBLE), 6) AS authorised_success_rate, round(avg(CASE WHEN wanted = given THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM c GROUP BY baseline"""
)
def k4_boundary_of_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of H10 against which files were approved, beside a baseline that opens every directory with an approved file."""
    files = artifacts(spark, sf_dir).select("path", "dir", F.when(F.col("doc_id") % 3 == 0, "allow").otherwise("deny").alias("expected"))
    decided = files.join(h10_match_approvals(spark, sf_dir), "path")
    opened = decided.groupBy("dir").agg(F.max(F.col("decision") == "allow").alias("open"))
    by_folder = decided.join(opened, "dir").select(
        F.lit("directory").alias("baseline"),
        "expected",
        F.when(F.col("open"), "allow").otherwise("deny").alias("observed"),
    )
    return experiments.boundary_summary(
        decided.select(F.lit("ledger").alias("baseline"), "expected", F.col("decision").alias("observed")).unionByName(by_folder)
    )


@query()
def k1_run_seed_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer")
    return experiments.run_seed_suite(
        people,
        "demo",
        [7, 17],
        roles={"c_mktsegment": "quasi_identifier", "c_nationkey": "quasi_identifier", "c_custkey": "identifier"},
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select(
        F.col("source").alias("experiment_id"),
        (F.col("doc_id") % 100).alias("duration_seconds"),
        F.create_map(F.lit("auc"), F.col("n_chars") % 101 / 100, F.lit("passed"), (F.col("doc_id") % 2).cast("double")).alias("metrics"),
    )


@query(
    """WITH v AS (SELECT source AS experiment_id, 'auc' AS metric, (n_chars % 101) / 100.0 AS v FROM documents UNION ALL SELECT source, 'passed', CAST(doc_id % 2 AS DOUBLE) FROM documents
      UNION ALL SELECT source, 'duration_seconds', CAST(doc_id % 100 AS DOUBLE) FROM documents),
    s AS (SELECT experiment_id, metric, count(*) AS n, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM v GROUP BY ALL)
    SELECT experiment_id, metric, n, round(round(m, 8), 6) AS mean, round(round(s, 8), 6) AS sd, round(round(m - 1.96 * s / sqrt(n), 8), 6) AS ci_low, round(round(m + 1.96 * s / sqrt(n), 8), 6) AS ci_high FROM s"""
)
def k2_aggregate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = experiments.aggregate_runs(runs(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "ci_low", "ci_high")})


@query(
    """SELECT b AS benchmark, metric, value FROM (SELECT lang, CASE lang WHEN 'en' THEN 'membership-v0' WHEN 'fr' THEN 'k-anonymity-v0' ELSE lang END AS b, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY lang) d,
    (SELECT unnest(['auc', 'min_class', 'm1', 'm2', 'm3']) AS metric, unnest([1.0, 2.0, 3.0, 4.0, 5.0]) AS f) m, LATERAL (SELECT n * f AS value)
    WHERE CASE lang WHEN 'en' THEN metric = 'auc' WHEN 'fr' THEN metric = 'min_class' ELSE metric <> 'min_class' END"""
)
def k3_comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("lang") == "en", "membership-v0").when(F.col("lang") == "fr", "k-anonymity-v0").otherwise(F.col("lang"))
    counts = docs(spark, sf_dir).groupBy(name.alias("benchmark")).agg(F.count("*").cast("double").alias("n"))
    metrics = F.create_map(*[x for i, m in enumerate(("auc", "min_class", "m1", "m2", "m3")) for x in (F.lit(m), F.col("n") * (i + 1))])
    return experiments.comparison_table(counts.select("benchmark", metrics.alias("metrics")))


@query(
    """WITH r AS (SELECT source AS baseline, CASE WHEN doc_id % 2 = 0 THEN 'allow' ELSE 'deny' END AS expected, CASE WHEN doc_id % 3 = 0 THEN 'allow' ELSE 'deny' END AS observed FROM documents)
    SELECT baseline, count(*) AS cases, round(count(*) FILTER (expected = 'deny' AND observed = 'allow') / CAST(nullif(count(*) FILTER (expected = 'deny'), 0) AS DOUBLE), 6) AS attack_success_rate,
    round(count(*) FILTER (expected = 'allow' AND observed = 'allow') / CAST(nullif(count(*) FILTER (expected = 'allow'), 0) AS DOUBLE), 6) AS authorised_success_rate,
    round(avg(CASE WHEN expected = observed THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM r GROUP BY baseline"""
)
def k4_boundary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda n: F.when(F.col("doc_id") % n == 0, "allow").otherwise("deny")
    return experiments.boundary_summary(
        docs(spark, sf_dir).select(F.col("source").alias("baseline"), said(2).alias("expected"), said(3).alias("observed"))
    )


@query()
def l1_stream_pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, d = new_folder(spark, "stream"), docs(spark, sf_dir).select("doc_id", "text")
    for i in range(3):
        d.where(F.col("doc_id") % 3 == i).write.mode("append").parquet(f"{folder}/in")
    arriving = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 50).parquet(f"{folder}/in")
    streams.stream_pseudonymize(arriving, "doc_id", "text", folder, SECRET).awaitTermination()
    return spark.read.parquet(f"{folder}/documents").select("doc_id", "text")


@query(
    f"""WITH r AS (SELECT TIMESTAMP '2024-03-01 00:00:00' + INTERVAL 7 MINUTE * page_id AS ts, * FROM {ASKED})
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, 'CUSTOM_OR_UNKNOWN_ENDPOINT' AS classification, count(*) AS entries, CAST(sum(body_bytes) AS BIGINT) AS body_bytes, CAST(sum(pii_hits) AS BIGINT) AS pii_hits,
    count(*) FILTER (sensitive_headers <> '') AS with_sensitive_headers, count(*) FILTER (sensitive_query <> '') AS with_sensitive_query
    FROM r WHERE host IS NOT NULL AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM r) GROUP BY 1, 2"""
)
def l2_stream_request_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures arrive with a time each; every fifth is captured twice."""
    folder, rows = new_folder(spark, "monitor"), asked(spark, sf_dir)
    timed = rows.withColumn("ts", F.timestamp_add("MINUTE", F.col("page_id") * 7, F.lit("2024-03-01 00:00:00").cast("timestamp")))
    timed.unionByName(timed.where("page_id % 5 = 0")).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    streams.stream_request_monitor(arriving, "ts", "page_id", "1 hour", "2 hours", folder).awaitTermination()
    # the last windows stay open
    out = spark.read.parquet(f"{folder}/totals").drop("batch", "with_secret_fields")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT source || '/doc-' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'allow' ELSE 'deny' END AS decision FROM documents")
def l3_stream_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "access")
    artifacts(spark, sf_dir).select("path", "sha256", F.lit("teaching").alias("purpose")).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema("path string, sha256 string, purpose string").parquet(f"{folder}/in")
    streams.stream_access_log(arriving, ledger(spark, sf_dir), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/events").select("path", "decision")


