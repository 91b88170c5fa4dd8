"""Sources and sinks, profiles, statistics and synthesis over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import copula, profile, sketches, stats, synth
from ..sources import tables
from ..sources.shared import durable, new_folder
from .base import query, table


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
def a1_read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").agg(
        F.count("*").alias("n"),
        F.sum("l_linenumber").alias("lines"),
    )


@query("SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM part GROUP BY p_brand")
def a2_write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{new_folder(spark, 'tables')}/part.csv"
    tables.write_table(table(spark, sf_dir, "part"), place)
    return tables.read_table(spark, place).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").cast("bigint").alias("sizes"))


#: Documents to a file of the corpus that a3 writes and reads.
LINES_PER_FILE = 200


@query("SELECT 'text' AS kind, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(text)) + count(*) AS BIGINT) AS characters FROM documents")
def a3_read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a line; a file is a row of the corpus and is held whole, so files hold so many lines at most, whatever the table's size."""
    place = new_folder(spark, "corpus")
    lines = table(spark, sf_dir, "documents").select(F.translate("text", "\n\r", "  "))
    lines.write.option("maxRecordsPerFile", LINES_PER_FILE).text(place)
    files = tables.read_corpus(spark, place)
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return files.groupBy("kind").agg(F.sum(lines).cast("bigint").alias("lines"), F.sum(F.length("text")).cast("bigint").alias("characters"))


def captures(spark: SparkSession, sf_dir: str) -> str:
    """`pages` as request captures, twenty requests to a file."""
    place = new_folder(spark, "captures")
    head = F.array(
        F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html; charset=utf-8").alias("value")),
        F.struct(F.lit("Authorization").alias("name"), F.lit("hidden").alias("value")),
    )
    cookies = F.array(F.struct(F.lit("session").alias("name")))
    request = F.struct(
        F.lit("post").alias("method"),
        "url",
        head.alias("headers"),
        cookies.alias("cookies"),
        F.struct(F.col("html").alias("text")).alias("postData"),
    )
    entries = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 20).alias("capture")).agg(
        F.collect_list(F.struct(request.alias("request"))).alias("entries")
    )
    entries.select("capture", F.to_json(F.struct(F.struct("entries").alias("log"))).alias("value")).write.partitionBy("capture").text(place)
    return place


@query("SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS body_chars FROM pages GROUP BY 1")
def a4_read_har(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read_har(spark, captures(spark, sf_dir))
    return rows.groupBy(F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme")).agg(
        F.count("*").alias("n"),
        F.sum(F.length("body")).cast("bigint").alias("body_chars"),
    )


@query(
    """SELECT CASE WHEN role = 'system' THEN 'missing:text' WHEN turn = 0 THEN 'duplicate_key' ELSE 'valid' END AS outcome,
    CAST(sum(CASE WHEN turn = 0 AND role <> 'system' THEN 2 WHEN turn = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM conversations GROUP BY 1"""
)
def a5_read_jsonl_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = new_folder(spark, "lines")
    said = table(spark, sf_dir, "conversations")
    rows = said.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        "role",
        F.when(F.col("role") != "system", F.col("text")).alias("text"),
        "turn",
    )
    rows.unionByName(rows.where("turn = 0")).drop("turn").write.json(place)
    valid, rejects = tables.read_jsonl_checked(spark, place, "id string, role string, text string", "id", ("role", "text"))
    both = valid.select(F.lit("valid").alias("outcome")).unionByName(rejects.select(F.col("reason").alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"))


@query()
def a6_artifact_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.artifact_digests(spark, sf_dir)


@query("SELECT 'payload' AS artifact, true AS allow, true AS allow_after_final_scan, true AS passed, CAST(0 AS BIGINT) AS pii_hits")
def a7_stage_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    manifest = tables.stage_release(counts, True, new_folder(spark, "release"))
    return manifest.select("artifact", "allow", "allow_after_final_scan", "final_scan.passed", "final_scan.pii_hits")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def a8_append_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = new_folder(spark, "ledger")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    tables.append_ledger(rows.where("doc_id % 2 = 0"), place)
    tables.append_ledger(rows.where("doc_id % 2 <> 0"), place)
    return spark.read.schema("doc_id bigint, source string").json(place).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT source AS experiment_id, CAST(count(*) AS DOUBLE) AS documents, CAST(max(n_chars) AS DOUBLE) AS longest FROM documents GROUP BY source")
def a9_write_run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = new_folder(spark, "runs")
    by_source = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").cast("double").alias("a"),
        F.max("n_chars").cast("double").alias("b"),
        F.min("text").alias("text"),
    )
    runs = by_source.select(
        F.col("source").alias("experiment_id"),
        F.create_map(F.lit("documents"), "a", F.lit("longest"), "b").alias("metrics"),
        "text",
    )
    tables.write_run_records(runs, place)
    back = spark.read.schema("experiment_id string, metrics map<string,double>, text string").json(place)
    return back.where("text is null").select(
        "experiment_id",
        F.col("metrics")["documents"].alias("documents"),
        F.col("metrics")["longest"].alias("longest"),
    )


def name_case(name: str, text: str = "false") -> str:
    """The ordered name rules as SQL."""
    hit = lambda each: " OR ".join(f"regexp_matches({name}, '{p}')" for p in each)
    return f"CASE WHEN {hit(P.IDENTIFIER_NAMES)} THEN 'identifier' WHEN {text} THEN 'free_text' WHEN {hit(P.QUASI_NAMES)} THEN 'quasi_identifier' WHEN {hit(P.SENSITIVE_NAMES)} THEN 'sensitive' ELSE 'general' END"


STRATEGY_SQL = "CASE role WHEN 'identifier' THEN 'regenerate' WHEN 'free_text' THEN 'block_v0_1' ELSE 'joint_synthesis' END"
LINEITEM = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
)


@query(f"SELECT name, role, {STRATEGY_SQL} AS strategy FROM (SELECT name, {name_case('name')} AS role FROM (SELECT unnest({list(LINEITEM)}) AS name))")
def b1_classify_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.classify_columns(table(spark, sf_dir, "lineitem"))


LENGTHS = " UNION ALL ".join(
    f"SELECT '{c}' AS name, avg(length({c})) AS m, quantile_cont(length({c}), 0.9) AS p FROM documents" for c in ("text", "lang", "source")
)


@query(f"SELECT name, round(m, 6) AS mean_length, CAST(p AS DOUBLE) AS p90_length, coalesce(m > 60 OR p > 160, false) AS free_text FROM ({LENGTHS})")
def b2_free_text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.free_text_columns(table(spark, sf_dir, "documents")).withColumn("mean_length", F.round("mean_length", 6))


def profile_sql(name: str, columns: dict[str, str], texts: tuple[str, ...]) -> str:
    one = lambda c: f"SELECT '{c}' AS name, '{columns[c]}' AS dtype, count({c}) AS non_null, count(DISTINCT {c}) AS uniq, " + (f"coalesce(avg(length({c})) > 60 OR quantile_cont(length({c}), 0.9) > 160, false)" if c in texts else "false") + f" AS long FROM {name}"
    inner = " UNION ALL ".join(map(one, columns))
    return f"SELECT name, dtype, role, {STRATEGY_SQL} AS strategy, non_null, uniq AS \"unique\", round(uniq / CAST(greatest(non_null, 1) AS DOUBLE), 6) AS unique_ratio FROM (SELECT *, {name_case('name', 'long')} AS role FROM ({inner}))"


CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
DOCUMENTS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


@query(profile_sql("customer", CUSTOMER, ("c_name", "c_mktsegment")))
def b3_profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_table(table(spark, sf_dir, "customer"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count({c}) AS non_null, true AS unique_close, CAST(count(DISTINCT year(l_shipdate)) AS BIGINT) AS parts FROM lineitem" for c in LINEITEM))
def b3_sketched_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by year of shipment, merged: counts, and whether distinct counts are within 3 % of the exact ones."""
    rows = table(spark, sf_dir, "lineitem")
    stored = durable(sketches.column_sketches(rows, F.year("l_shipdate")))
    found = sketches.estimates(sketches.merged(stored)).join(stored.groupBy("name").agg(F.count("*").alias("parts")), "name")
    exact = profile.profile_table(rows).select("name", F.col("unique").alias("exact"))
    return found.join(exact, "name").select(
        "name",
        "n",
        "non_null",
        (F.abs(F.col("unique") - F.col("exact")) <= 0.03 * F.col("exact")).alias("unique_close"),
        "parts",
    )


@query(f"SELECT role, CAST(count(name) AS BIGINT) AS columns FROM (SELECT unnest({list(profile.ROLES)}) AS role) d LEFT JOIN ({profile_sql('documents', DOCUMENTS, ('text', 'lang', 'source'))}) p USING (role) GROUP BY role")
def b3_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.role_counts(profile.profile_table(table(spark, sf_dir, "documents")))


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def b6_drop_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.drop_identifiers(table(spark, sf_dir, "customer"))


NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS n_rows, count({c}) AS n, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in NUMBERS
)


@query(f"SELECT name, n_rows, n, round(mean, 4) AS mean, round(std, 4) AS std, min, max FROM ({DESCRIBE})")
def e1_describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.describe_numeric(table(spark, sf_dir, "lineitem"))
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 4) AS correlation FROM lineitem" for a, b in PAIRS))
def e2_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlation_matrix(table(spark, sf_dir, "lineitem")).withColumn("correlation", F.round("correlation", 4) + 0.0)


GROUPS = 'SELECT c_nationkey AS "group", count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std FROM customer GROUP BY 1 HAVING count(c_acctbal) >= 5'


@query(GROUPS)
def e3_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.group_summary(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal")
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


OLS = """WITH s AS (SELECT regr_slope(p_retailprice, p_size) AS b1, regr_intercept(p_retailprice, p_size) AS b0, regr_count(p_retailprice, p_size) AS n,
  regr_r2(p_retailprice, p_size) AS r2, regr_syy(p_retailprice, p_size) AS syy, regr_sxx(p_retailprice, p_size) AS sxx, regr_avgx(p_retailprice, p_size) AS mx FROM part),
r AS (SELECT *, syy * (1 - r2) / (n - 2) AS v FROM s),
t AS (SELECT 'const' AS term, b0 AS coef, sqrt(v * (1.0 / n + mx * mx / sxx)) AS se, n, r2 FROM r UNION ALL SELECT 'p_size', b1, sqrt(v / sxx), n, r2 FROM r) """


@query(OLS + "SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, n AS nobs, round(r2, 4) AS r2 FROM t")
def e4_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.ols(table(spark, sf_dir, "part"), "p_retailprice", ["p_size"])
    return out.select("term", F.round("coef", 4).alias("coef"), F.round("se", 4).alias("se"), "nobs", F.round("r2", 4).alias("r2"))


@query(
    """WITH g AS (SELECT c_mktsegment AS level, avg(c_nationkey) AS mx, avg(c_acctbal) AS my, count(*) AS n FROM customer GROUP BY 1),
    b AS (SELECT sum((c_nationkey - mx) * (c_acctbal - my)) / sum((c_nationkey - mx) ** 2) AS slope FROM customer JOIN g ON level = c_mktsegment),
    base AS (SELECT my - slope * mx AS const FROM g, b ORDER BY level LIMIT 1)
    SELECT 'const' AS term, round(const, 4) AS coef, (SELECT count(*) FROM customer) AS nobs FROM base
    UNION ALL SELECT 'c_nationkey', round(slope, 4), (SELECT count(*) FROM customer) FROM b
    UNION ALL SELECT 'c_mktsegment[' || level || ']', round(my - slope * mx - const, 4), (SELECT count(*) FROM customer) FROM g, b, base WHERE level > (SELECT min(level) FROM g)"""
)
def e4_ols_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number and the levels of a text together: slopes within groups, by SQL."""
    out = stats.ols(table(spark, sf_dir, "customer"), "c_acctbal", ["c_nationkey", "c_mktsegment"])
    return out.select("term", F.round("coef", 4).alias("coef"), "nobs")


@query("SELECT 'c_mktsegment' AS \"column\", count(*) AS levels, min(n) AS smallest, count(*) <= 50 AND min(n) >= 5 AS allowed FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)")
def e5_rare_level_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rare_level_guard(table(spark, sf_dir, "customer"), "c_mktsegment")


@query(OLS + "SELECT term, round(coef / se, 3) AS statistic, n AS nobs FROM t")
def e6_second_engine_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ols(table(spark, sf_dir, "part"), "p_retailprice", ["p_size"]).select("term", F.round("statistic", 3).alias("statistic"), "nobs")


SAFE = f"SELECT name, CAST(n_rows // 10 * 10 AS VARCHAR) || '-' || CAST(n_rows // 10 * 10 + 9 AS VARCHAR) AS n_rows_bucket, CAST(n // 10 * 10 AS VARCHAR) || '-' || CAST(n // 10 * 10 + 9 AS VARCHAR) AS n_bucket, round(mean, 2) AS mean, round(std, 2) AS std FROM ({DESCRIBE})"


@query(SAFE)
def e7_release_safe_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.release_safe_describe(stats.describe_numeric(table(spark, sf_dir, "lineitem")), 5, 5)


@query(GROUPS)
def e8_aggregate_pii_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.aggregate_pii_guard(e3_group_summary(spark, sf_dir))


def draw_sql(key: str, column: str, *more: str) -> str:
    """SQL: a number in (0, 1) from the MD5 of key, column and seed 7."""
    said = " || '|' || ".join([f"CAST({key} AS VARCHAR)", f"'{column}'", "'7'", *[f"'{m}'" for m in more]])
    return f"((CAST(('0x' || substr(md5({said}), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


def number_sql(key: str, column: str) -> str:
    """SQL: a column of customer drawn around its mean, from a row of statistics called s."""
    normal = f"sqrt(-2 * ln({draw_sql(key, column, 'a')})) * cos(2 * pi() * {draw_sql(key, column, 'b')})"
    pad = f"greatest((hi_{column} - lo_{column}) * 0.05, sd_{column} * 0.05)"
    return f"least(greatest(mean_{column} + sd_{column} * {normal}, lo_{column} - {pad}), hi_{column} + {pad})"


def statistics_sql(*columns: str) -> str:
    return "SELECT " + ", ".join(
        f"avg({c}) AS mean_{c}, stddev_pop({c}) AS sd_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in columns
    ) + " FROM customer"


SEGMENTS_SQL = """SELECT v, (upto - n - 1) / whole AS lo, upto / whole AS hi FROM (SELECT v, n, CAST(sum(n + 1) OVER (ORDER BY v) AS DOUBLE) AS upto, CAST(sum(n + 1) OVER () AS DOUBLE) AS whole
    FROM (SELECT c_mktsegment AS v, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1))"""


@query(f"WITH s AS ({statistics_sql('c_acctbal')}) SELECT c_custkey, round({number_sql('c_custkey', 'c_acctbal')}, 6) AS c_acctbal FROM customer, s")
def g1_sample_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "customer")
    return synth.sample_numeric(source.select("c_custkey"), "c_custkey", source, "c_acctbal", 7).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query(f"WITH t AS ({SEGMENTS_SQL}) SELECT c_custkey, v AS c_mktsegment FROM (SELECT c_custkey, {draw_sql('c_custkey', 'c_mktsegment')} AS u FROM customer) JOIN t ON u >= lo AND u < hi")
def g2_sample_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "customer")
    return synth.sample_categorical(source.select("c_custkey"), "c_custkey", source, "c_mktsegment", 7)


@query(
    """SELECT c_custkey, printf('synthetic-7-%d@example.invalid', c_custkey) AS email, printf('+00-000-%04d-%04d', (c_custkey + 7) % 10000, c_custkey % 10000) AS phone,
    printf('Synthetic Address %d', c_custkey + 1) AS address, printf('SYN-0007-%06d', c_custkey + 1) AS other FROM customer"""
)
def g3_regenerate_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    made = {"email": "email", "phone": "phone", "address": "address", "other": "record_id"}
    return table(spark, sf_dir, "customer").select("c_custkey", *[synth.regenerate_identifier(n, i, 7).alias(c) for c, n in made.items()])


NAME_SQL = "({})[CAST(({}) % {} AS INTEGER) + 1]"
GIVEN_SQL, FAMILY_SQL = NAME_SQL.format(list(synth.GIVEN), "i + 7", len(synth.GIVEN)), NAME_SQL.format(
    list(synth.FAMILY),
    f"i // {len(synth.GIVEN)} + 7",
    len(synth.FAMILY),
)


@query(
    f"""WITH s AS ({statistics_sql('c_custkey', 'c_nationkey', 'c_acctbal')}), t AS ({SEGMENTS_SQL}), r AS (SELECT unnest(range((SELECT count(*) FROM customer))) AS i)
    SELECT CAST(round_even({number_sql('i', 'c_custkey')}, 0) AS BIGINT) AS c_custkey, {GIVEN_SQL} || ' ' || {FAMILY_SQL} AS c_name, CAST(round_even({number_sql('i', 'c_nationkey')}, 0) AS INTEGER) AS c_nationkey,
    round({number_sql('i', 'c_acctbal')}, 6) AS c_acctbal, v AS c_mktsegment FROM r, s JOIN t ON {draw_sql('i', 'c_mktsegment')} >= lo AND {draw_sql('i', 'c_mktsegment')} < hi"""
)
def g4_synthesize_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.synthesize_table(table(spark, sf_dir, "customer"), 7).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query()
def g5_registered_synthesizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copula over what the plug-in may see of lineitem: no identifiers."""
    return synth.synthesize(table(spark, sf_dir, "lineitem"), copula.NAME, 7)


@query("SELECT c_custkey, substr(md5('split|' || CAST(c_custkey AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') AS member FROM customer")
def g7_split_members_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.split_members_holdout(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "member")


@query("SELECT c_custkey, least(c_acctbal + 1.5, 9000.0) AS c_acctbal FROM customer")
def g8_drift_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.drift_snapshot(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": (1.5, 9000.0)})
