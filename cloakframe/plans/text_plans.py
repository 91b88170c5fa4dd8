"""Scans, pseudonymisation and text audits over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, pii
from ..operators import pii as scans
from ..operators import pseudonymize as ps
from ..operators import release, text_audit
from ..sources.shared import durable
from .base import SQL, query, table

SECRET = b"a key that only the driver holds"

# The counts in SQL, whose patterns have no look-behind: the boundary before a match is consumed.
EMAIL_SQL = r"len(regexp_extract_all(text, '(?i)(?:^|[^\p{L}\p{N}_.+-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})'))"
PHONE_SQL = r"len(list_filter(list_transform(regexp_extract_all(text, '(?:^|[^\p{Nd}])(\+?\d[\d ()-]{7,}\d)', 1), lambda x: trim(x)), lambda x: NOT regexp_full_match(x, '\d{4}[-/]\d{1,2}[-/]\d{1,2}') AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= 9))"
ID_SQL = r"len(regexp_extract_all(text, '(?:^|[^\d])(\d{17}[\dXx])(?:[^\d]|$)'))"
POSTCODE_SQL = r"len(regexp_extract_all(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:GIR ?0AA|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})(?:[^\p{L}\p{N}_]|$)'))"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_SQL = rf"len(list_filter(list_transform(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_:])([0-9A-Fa-f:.]{{3,}})', 1), lambda x: trim(x, '.')), lambda x: regexp_full_match(x, '{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}')))"
COUNTS_SQL = f"CAST({EMAIL_SQL} AS BIGINT) AS email, CAST({PHONE_SQL} AS BIGINT) AS phone, CAST({ID_SQL} AS BIGINT) AS cn_national_id, CAST({POSTCODE_SQL} AS BIGINT) AS uk_postcode, CAST({IP_SQL} AS BIGINT) AS ip_address"
SCANNED = f"(SELECT doc_id, text, {COUNTS_SQL} FROM documents)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, email FROM {SCANNED}")
def c1_email_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", pii.email_count(F.col("text")).cast("bigint").alias("email"))


@query(f"SELECT doc_id, phone FROM {SCANNED}")
def c2_phone_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", pii.phone_count(F.col("text")).cast("bigint").alias("phone"))


@query(f"SELECT doc_id, cn_national_id FROM {SCANNED}")
def c3_national_id_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", pii.national_id_count(F.col("text")).cast("bigint").alias("cn_national_id"))


@query(f"SELECT doc_id, uk_postcode FROM {SCANNED}")
def c4_postcode_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", pii.postcode_count(F.col("text")).cast("bigint").alias("uk_postcode"))


@query(f"SELECT doc_id, ip_address FROM {SCANNED}")
def c5_ip_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", pii.ip_count(F.col("text")).cast("bigint").alias("ip_address"))


ENTITIES = ("email", "phone", "cn_national_id", "uk_postcode", "ip_address")


@query("SELECT 'text' AS \"column\", entity, hits FROM (" + " UNION ALL ".join(f"SELECT '{e}' AS entity, CAST(sum({e}) AS BIGINT) AS hits FROM {SCANNED}" for e in ENTITIES) + ") WHERE hits > 0")
def c6_scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_table(docs(spark, sf_dir))


@query(f"SELECT doc_id, {', '.join(ENTITIES)}, {' + '.join(ENTITIES)} AS total FROM {SCANNED}")
def c7_scan_text_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_text_column(docs(spark, sf_dir), "doc_id", "text")


LEAVES_SQL = """(SELECT text FROM documents UNION ALL SELECT source FROM documents
    UNION ALL SELECT atom ->> '$' FROM events, LATERAL (SELECT atom, type FROM json_tree(props)) WHERE type = 'VARCHAR'
    UNION ALL SELECT key FROM events, LATERAL (SELECT key, fullkey FROM json_tree(props)) WHERE key IS NOT NULL AND NOT ends_with(fullkey, ']'))"""


@query("SELECT entity, hits FROM (" + " UNION ALL ".join(f"SELECT '{e}' AS entity, CAST(sum({e}) AS BIGINT) AS hits FROM (SELECT {COUNTS_SQL} FROM {LEAVES_SQL})" for e in ENTITIES) + ") WHERE hits > 0")
def c8_scan_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = docs(spark, sf_dir).select(
        F.struct("text", F.map_from_arrays(F.array(F.lit("source")), F.array("source")).alias("about")).alias("payload")
    )
    props = table(spark, sf_dir, "events").select("props")
    both = scans.scan_structured(nested).unionByName(scans.scan_structured(props, ("props",)))
    return both.groupBy("entity").agg(F.sum("hits").alias("hits"))


@query()
def c9_identifier_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(
        "doc_id",
        F.explode(scans.identifier_spans(F.col("text"))).alias("s"),
    ).select("doc_id", "s.start", "s.end", "s.entity")


TAG_SQL = (
    (r"(?i)(^|[^\p{L}\p{N}_.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", r"\1[EMAIL]"),
    (r"(^|[^\p{Nd}])\+?\d[\d ()-]{7,}\d", r"\1[PHONE]"),
    (r"(^|[^\d])\d{17}[\dXx]([^\d]|$)", r"\1[NATIONAL_ID]\2"),
    (r"(?i)(^|[^\p{L}\p{N}_])(?:GIR ?0AA|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})([^\p{L}\p{N}_]|$)", r"\1[POSTCODE]\2"),
)
LOOSE = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
LOOSE_SQL = (rf"(^|[^\d]){LOOSE}(?:\.{LOOSE}){{3}}([^\d]|$)", r"\1[IP_ADDRESS]\2")
TOKEN_SQL = (
    r"(^|[^\p{L}\p{N}_:.])(\.*)(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.*)([^\p{L}\p{N}_:.]|$)",
    r"\1\2[IP_ADDRESS]\3\4",
)


def tagged_sql(text: str, *last: tuple[str, str]) -> str:
    """Tags instead of identifiers, kind by kind, in SQL without look-around: boundaries are kept by groups."""
    for pattern, tag in (*TAG_SQL, *last):
        text = f"regexp_replace({text}, '{pattern}', '{tag}', 'g')"
    return text


@query(f"SELECT doc_id, {tagged_sql('text', LOOSE_SQL)} AS text FROM documents")
def c10_redact_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", pii.redact_preview(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {tagged_sql('text', TOKEN_SQL)} AS text FROM documents")
def c11_redact_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", scans.redact_baseline(F.col("text")).alias("text"))


@query(f"SELECT doc_id, length(text) AS characters, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS lines, {' + '.join(ENTITIES)} AS pii_hits, false AS release_allowed FROM {SCANNED}")
def c12_inspect_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.inspect_texts(docs(spark, sf_dir), "doc_id", "text")


def card_numbers():
    """A detector: whole runs of digits, perhaps with single blanks or hyphens between, 13 to 19 of them with the right check digit."""
    import re

    run = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}")

    def checked(digits: str) -> bool:
        doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0

    def detect(text: str) -> dict[str, int]:
        runs = (re.sub("[ -]", "", m[0]) for m in run.finditer(text))
        n = sum(len(digits) < 20 and checked(digits) for digits in runs)
        return {"card_number": n} if n else {}

    return detect


CARD_SQL = r"""SELECT sum(n) AS hits FROM (SELECT len(list_filter(list_transform(regexp_extract_all(text, '(?:^|[^0-9])([0-9](?:[ -]?[0-9]){12,})', 1), lambda x: regexp_replace(x, '[ -]', '', 'g')),
    lambda d: length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[length(d) - i + 1] AS INTEGER)
      WHEN CAST(d[length(d) - i + 1] AS INTEGER) > 4 THEN CAST(d[length(d) - i + 1] AS INTEGER) * 2 - 9 ELSE CAST(d[length(d) - i + 1] AS INTEGER) * 2 END)) % 10 = 0)) AS n FROM documents)"""


@query(f"SELECT 'text' AS \"column\", 'card_number' AS entity, CAST(hits AS BIGINT) AS hits FROM ({CARD_SQL}) WHERE hits > 0")
def c13_scan_with_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_with_detector(docs(spark, sf_dir), card_numbers, ["text"])


def rule_sql(name: str, pattern: str) -> str:
    return f"SELECT '{name}' AS rule, source, CAST(sum(n) AS BIGINT) AS findings, count(*) AS records FROM (SELECT source, len(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}')) AS n FROM documents) WHERE n > 0 GROUP BY source"


@query(" UNION ALL ".join(rule_sql(n, p) for n, p in scans.SECRET_RULES.items()))
def c14_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_secrets(docs(spark, sf_dir), "source", "text")


@query()
def d1_pseudonymize_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.pseudonymize_per_document(docs(spark, sf_dir).select("doc_id", "text"), "text")


@query()
def d2_pseudonymize_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.pseudonymize_corpus(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text", secret=SECRET)[0]


@query(
    r"""SELECT doc_id, 'EMAIL' AS entity, lower(v) AS key FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^\p{L}\p{N}_.+-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})', 1)) AS v FROM documents)"""
)
def d3_identifier_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses found in the texts, as labels compare them."""
    spans = docs(spark, sf_dir).select(
        "doc_id",
        F.explode(scans.identifier_spans(F.upper("text"))).alias("s"),
    ).select("doc_id", "s.*").where("entity = 'EMAIL'")
    return spans.select("doc_id", "entity", keys.identifier_key(F.col("entity"), F.col("value")).alias("key"))


ADDRESSES_SQL = r"""(SELECT doc_id, lower(v) AS v FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^\p{L}\p{N}_.+-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})', 1)) AS v FROM documents))"""
COUNTED_SQL = f"SELECT 'EMAIL' AS entity, count(DISTINCT v) AS labels, count(*) AS replaced, count(DISTINCT doc_id) AS rows FROM {ADDRESSES_SQL}"


def label_counts(texts: DataFrame) -> DataFrame:
    """entity, labels, replaced, rows of addresses in rewritten texts."""
    said = F.regexp_extract_all("text", F.lit(r"\[(EMAIL)_[0-9]{3,}\]"), F.lit(0))
    each = texts.select("doc_id", F.explode(said).alias("label"))
    return each.agg(
        F.lit("EMAIL").alias("entity"),
        F.count_distinct("label").alias("labels"),
        F.count("*").alias("replaced"),
        F.count_distinct("doc_id").alias("rows"),
    )


@query(COUNTED_SQL)
def d2_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many labels as addresses, each at every place of its address."""
    return label_counts(d2_pseudonymize_corpus(spark, sf_dir))


@query(COUNTED_SQL)
def d15_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_counts(d15_pseudonymize_table(spark, sf_dir))


def hmac_sql(secret: bytes, message: str) -> str:
    """HMAC-SHA256 in SQL, for a key of up to 64 bytes."""
    pad = lambda x: "".join(f"\\x{b ^ x:02X}" for b in secret.ljust(64, bytes(1)))
    return f"sha256('{pad(0x5C)}'::BLOB || unhex(sha256('{pad(0x36)}'::BLOB || encode({message}))))"


@query(f"SELECT doc_id, {hmac_sql(SECRET, "'SOURCE' || chr(0) || source")} AS digest FROM documents")
def d4_keyed_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", keys.keyed_digest(SECRET, F.concat_ws("\0", F.lit("SOURCE"), "source")).alias("digest"))


def sources_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("entity", F.upper("lang"))
    return rows.groupBy("entity", F.md5("source").alias("digest")).agg(F.min("doc_id").alias("doc")).withColumn("start", F.lit(0))


@query(
    """WITH f AS (SELECT upper(lang) AS entity, md5(source) AS digest, min(doc_id) AS doc FROM documents GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY doc % 2, doc) AS seq FROM f)
    SELECT entity, digest, '[' || entity || '_' || CASE WHEN seq < 1000 THEN lpad(CAST(seq AS VARCHAR), 3, '0') ELSE CAST(seq AS VARCHAR) END || ']' AS label, seq FROM r"""
)
def d5_extend_entity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = sources_first(spark, sf_dir)
    known = durable(ps.numbered(first.where("doc % 2 = 0")))
    return ps.extend_entity_map(known, first)


@query("SELECT count(*) AS rows, true AS verified, false AS verified_by_other_key, false AS verified_after_removal FROM (SELECT DISTINCT upper(lang), md5(source) FROM documents)")
def d6_seal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed, seal = ps.seal_map(ps.numbered(sources_first(spark, sf_dir)), SECRET)
    sealed = durable(sealed)
    smallest = sealed.agg(F.min("mac").alias("m")).first()["m"]
    checks = (
        ps.verify_map(sealed, seal, SECRET),
        ps.verify_map(sealed, seal, b"other"),
        ps.verify_map(sealed.where(F.col("mac") != smallest), seal, SECRET),
    )
    return sealed.agg(F.count("*").alias("rows")).select(
        "rows",
        *[F.lit(c).alias(n) for c, n in zip(checks, ("verified", "verified_by_other_key", "verified_after_removal"), strict=True)],
    )


@query("SELECT CAST(doc_id AS VARCHAR) AS path_token, sha256(text) AS input_sha256 FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def d7_pending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(
        "doc_id",
        F.col("doc_id").cast("string").alias("path_token"),
        F.sha2("text", 256).alias("input_sha256"),
        F.md5("text").alias("output_sha256"),
    )
    stored = rows.select("path_token", F.when(F.col("doc_id") % 2 == 0, "changed").otherwise(F.col("output_sha256")).alias("output_sha256"))
    return ps.pending_documents(rows.select("path_token", "input_sha256"), rows.where("doc_id % 3 = 0").drop("doc_id"), stored)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of each document: its first two words of four letters or more."""
    words = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}{4,}"), F.lit(0))), 1, 2)
    return docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.posexplode(words).alias("i", "literal")).select(
        "doc",
        F.when(F.col("i") == 0, "PERSON").otherwise("PROJECT").alias("entity"),
        "literal",
    )


@query()
def d8_replace_dictionary_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.replace_dictionary_literals(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text", dictionary(spark, sf_dir), SECRET)[0]


NOMINATED = r"""(WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\p{L}{4,}') AS w FROM documents),
    n AS (SELECT doc_id, text, 'PERSON' AS type, w[1] AS literal FROM w UNION ALL SELECT doc_id, text, 'PROJECT', list_filter(w, lambda x: x <> w[1])[1] FROM w)
    SELECT doc_id, type, literal, CASE WHEN length(literal) > 160 THEN 'length' WHEN (length(text) - length(replace(text, literal, ''))) / length(literal) > 50 THEN 'too_frequent' END AS reject_reason FROM n WHERE literal IS NOT NULL)"""


PLACES_SQL = "(length(text) - length(replace(text, literal, ''))) // length(literal)"


@query(f"SELECT doc_id AS doc, CAST(sum({PLACES_SQL}) AS BIGINT) AS places FROM (SELECT n.doc_id, n.literal, d.text FROM {NOMINATED} n JOIN documents d USING (doc_id)) GROUP BY doc_id")
def d8_literal_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the literals of each document stand in it, accepted or in conflict."""
    spans = ps.literal_spans(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text", dictionary(spark, sf_dir))
    return ps.conflict_counts(spans).select("doc", (F.col("accepted") + F.col("direct_conflicts") + F.col("literal_conflicts")).alias("places"))


@query()
def d8_literal_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.conflict_counts(ps.literal_spans(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text", dictionary(spark, sf_dir)))


@query(f"SELECT doc_id, type, literal, reject_reason FROM {NOMINATED}")
def d9_validate_nominations(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_doc = dictionary(spark, sf_dir).groupBy(F.col("doc").alias("doc_id")).agg(
        F.to_json(F.collect_list(F.struct(F.col("entity").alias("type"), "literal"))).alias("payload")
    )
    return ps.validate_nominations(docs(spark, sf_dir), by_doc, "doc_id", "text", "payload")


@query(f"SELECT doc_id, count(*) FILTER (reject_reason IS NULL) AS accepted_total, count(*) FILTER (reject_reason IS NOT NULL) AS rejected FROM {NOMINATED} GROUP BY doc_id")
def d9_nomination_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.nomination_summary(d9_validate_nominations(spark, sf_dir), "doc_id").select("doc_id", "accepted_total", "rejected")


@query(
    """SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substr(text, CAST(i * 744 + 1 AS BIGINT), 1000) AS chunk FROM (
    SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1000) / 744.0)) AS BIGINT) + 1)) AS i FROM documents WHERE text IS NOT NULL)"""
)
def d10_sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.sliding_chunks(docs(spark, sf_dir), "doc_id", "text", 1000, 256)


@query()
def d10_paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.paragraph_chunks(docs(spark, sf_dir), "doc_id", "text", 2000)


@query(f"SELECT doc_id, {' + '.join(ENTITIES)} AS residual_hits, CASE WHEN {' + '.join(ENTITIES)} > 0 THEN 'LOCAL_ONLY' ELSE 'MANUAL_REVIEW_REQUIRED' END AS status, false AS release_allowed FROM {SCANNED}")
def d11_residual_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.residual_status(docs(spark, sf_dir), "doc_id", "text")


@query(
    f"""WITH r AS (SELECT doc_id % 4 = 0 AS resumed, {' + '.join(ENTITIES)} > 0 AS hit FROM {SCANNED})
    SELECT count(*) FILTER (NOT resumed) AS processed, count(*) FILTER (resumed) AS resumed, count(*) FILTER (NOT hit) AS review, count(*) FILTER (hit) AS local_only,
    CASE WHEN count(*) FILTER (hit) > 0 THEN 'LOCAL_ONLY' ELSE 'MANUAL_REVIEW_REQUIRED' END AS status FROM r"""
)
def d12_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.batch_summary(d11_residual_status(spark, sf_dir).withColumn("resumed", F.col("doc_id") % 4 == 0))


@query()
def d13_html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.html_visible_text(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def d14_pseudonymize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.pseudonymize_html(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def d14_pseudonymize_html_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.pseudonymize_html_corpus(table(spark, sf_dir, "pages"), "page_id", "html", secret=SECRET)[0]


@query(f"SELECT CAST(0 AS BIGINT) AS name_hits, CAST(sum({' + '.join(ENTITIES)}) AS BIGINT) AS cell_hits, CAST(0 AS BIGINT) AS formula_hits FROM (SELECT doc_id, text, {COUNTS_SQL} FROM documents WHERE NOT starts_with(text, '='))")
def d15_table_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.table_residuals(docs(spark, sf_dir).select("doc_id", "text"), "doc_id").select("name_hits", "cell_hits", "formula_hits")


@query()
def d15_pseudonymize_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.pseudonymize_table(docs(spark, sf_dir).select("doc_id", "text", "source"), "doc_id", secret=SECRET)


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, output): each text and its lower-cased copy without digits 5 to 9."""
    return docs(spark, sf_dir).select("doc_id", F.col("text").alias("source"), F.regexp_replace(F.lower("text"), "[5-9]", "#").alias("output"))


NUMBERS_SQL = r"list_distinct(list_filter(list_transform(regexp_extract_all({}, '(?:^|[^\p{{L}}\p{{N}}_])(\d[\d./:-]*)', 1), lambda x: rtrim(x, './:-')), lambda x: x <> ''))"
PAIR_SQL = "(SELECT doc_id, text AS source, regexp_replace(lower(text), '[5-9]', '#', 'g') AS output FROM documents)"


@query(f"SELECT doc_id, CAST(len(list_intersect({NUMBERS_SQL.format('source')}, {NUMBERS_SQL.format('output')})) AS BIGINT) AS reused_numbers FROM {PAIR_SQL}")
def j1_number_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(spark, sf_dir).select("doc_id", text_audit.number_reuse(F.col("source"), F.col("output")).alias("reused_numbers"))


@query()
def j2_char_ngram_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_audit.char_ngram_reuse(redacted(spark, sf_dir), "doc_id", "source", "output")


WORDS_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}][\p{{L}}\p{{M}}\p{{N}}_''-]{{7,}}')"


@query(
    f"""WITH p AS {PAIR_SQL}, w AS (SELECT doc_id, unnest({WORDS_SQL.format('source')}) AS w FROM p), once AS (SELECT doc_id, w FROM w GROUP BY ALL HAVING count(*) = 1),
    said AS (SELECT DISTINCT doc_id, w, 1 AS hit FROM (SELECT doc_id, unnest({WORDS_SQL.format('output')}) AS w FROM p)),
    n AS (SELECT doc_id, count(*) AS d, count(hit) AS r FROM once LEFT JOIN said USING (doc_id, w) GROUP BY doc_id)
    SELECT doc_id, coalesce(d, 0) AS distinctive_tokens, coalesce(r, 0) AS reused_tokens, CASE WHEN d > 0 THEN round(r / CAST(d AS DOUBLE), 6) ELSE 0.0 END AS token_reuse_rate FROM documents LEFT JOIN n USING (doc_id)"""
)
def j3_distinctive_token_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_audit.distinctive_token_reuse(redacted(spark, sf_dir), "doc_id", "source", "output", ascii_only=True)


GATE_SQL = """array_to_string(list_filter([CASE WHEN pii_hits > 0 THEN 'direct_pii_detected' END, CASE WHEN reused_numbers > 0 THEN 'source_number_reuse' END, CASE WHEN ngram_reuse_rate > 0.01 THEN 'character_ngram_reuse' END,
    CASE WHEN token_reuse_rate > 0.05 THEN 'distinctive_token_reuse' END, CASE WHEN output_chars < 80 THEN 'output_too_short' END], lambda x: x IS NOT NULL), ',')"""
GATE_ROWS = "(SELECT doc_id, doc_id % 3 AS pii_hits, doc_id % 2 AS reused_numbers, (doc_id % 5) / 100.0 AS ngram_reuse_rate, (doc_id % 7) / 100.0 AS token_reuse_rate, n_chars AS output_chars FROM documents)"


@query(f"SELECT doc_id, {GATE_SQL} AS failed, {GATE_SQL} = '' AS eligible_for_manual_review FROM {GATE_ROWS}")
def j4_semantic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = docs(spark, sf_dir).select(
        "doc_id",
        (i % 3).alias("pii_hits"),
        (i % 2).alias("reused_numbers"),
        (i % 5 / 100).alias("ngram_reuse_rate"),
        (i % 7 / 100).alias("token_reuse_rate"),
        F.col("n_chars").alias("output_chars"),
    )
    return text_audit.semantic_gate(rows).select("doc_id", F.array_join("failed_conditions", ",").alias("failed"), "eligible_for_manual_review")


AUDITED = f"""(SELECT doc_id, pii_hits, reused_numbers, 0.0 AS ngram_reuse_rate, token_reuse_rate, length(output) AS output_chars
    FROM {PAIR_SQL} JOIN (SELECT doc_id, {' + '.join(ENTITIES)} AS pii_hits FROM (SELECT doc_id, {COUNTS_SQL} FROM (SELECT doc_id, output AS text FROM {PAIR_SQL}))) USING (doc_id)
    JOIN ({SQL['j1_number_reuse']}) USING (doc_id) JOIN ({SQL['j3_distinctive_token_reuse']}) USING (doc_id))"""


@query(f"SELECT doc_id, {GATE_SQL} AS failed, {GATE_SQL} = '' AS eligible_for_manual_review FROM {AUDITED}")
def j4_gate_of_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over what J1, J3 and the scan measure on pairs; J2's rate, which SQL cannot give, is set to 0."""
    pairs = redacted(spark, sf_dir)
    scanned = scans.scan_text_column(pairs, "doc_id", "output").select("doc_id", F.col("total").alias("pii_hits"))
    rows = pairs.select(
        "doc_id",
        F.length("output").alias("output_chars"),
        F.lit(0.0).alias("ngram_reuse_rate"),
    ).join(scanned, "doc_id").join(j1_number_reuse(spark, sf_dir), "doc_id").join(j3_distinctive_token_reuse(spark, sf_dir), "doc_id")
    return text_audit.semantic_gate(rows).select("doc_id", F.array_join("failed_conditions", ",").alias("failed"), "eligible_for_manual_review")


@query()
def j5_audit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = redacted(spark, sf_dir)
    return text_audit.audit_pairs(
        pairs.select("doc_id", F.col("source").alias("text")),
        pairs.select("doc_id", F.col("output").alias("text")),
        "doc_id",
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as red-team cases: the first two long words are forbidden, the first word is the concept to keep."""
    words = F.regexp_extract_all("text", F.lit(r"\p{L}{8,}"), F.lit(0))
    first = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    return docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("attack_family"),
        F.col("text").alias("source"),
        F.slice(words, 1, 2).alias("forbidden_literals"),
        F.array(F.slice(first, 1, 1)).alias("utility_concepts"),
    )


SCORES = r"""(SELECT doc_id, lang, lower(text) AS said, regexp_extract_all(text, '\p{L}{8,}')[1:2] AS forbidden, regexp_extract_all(text, '\p{L}+')[1:1] AS kept FROM documents)"""


@query(f"SELECT doc_id AS id, lang AS attack_family, CAST(len(list_filter(forbidden, lambda x: contains(said, lower(x)))) AS BIGINT) AS forbidden_reuse, CASE WHEN len(list_filter(kept, lambda x: contains(said, lower(x)))) > 0 THEN 1.0 ELSE 0.0 END AS utility_retention, CASE WHEN len(list_filter(forbidden, lambda x: contains(said, lower(x)))) > 0 THEN 1 ELSE 0 END AS attack_success FROM {SCORES}")
def j6_score_redteam(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    audited = rows.select("id", F.col("source").alias("output"), F.lit(0).alias("pii_hits"), F.lit(0).alias("reused_numbers"))
    return text_audit.score_redteam(audited, rows).select("id", "attack_family", "forbidden_reuse", "utility_retention", "attack_success")


def measured_sql(baseline: str, output: str) -> str:
    """SQL: what the matrix measures under one baseline, but for the two rates of J2 and J3."""
    has = lambda x: f"contains(lower(output), lower({x}))"
    return f"""SELECT '{baseline}' AS baseline, lang AS attack_family, pii_hits, reused_numbers, len(list_filter(forbidden, lambda x: {has('x')})) AS forbidden_reuse,
      CASE WHEN len(kept) = 0 OR {has('kept[1]')} THEN 1.0 ELSE 0.0 END AS utility_retention
      FROM (SELECT doc_id, lang, text AS source, {output} AS output, regexp_extract_all(text, '\\p{{L}}{{8,}}')[1:2] AS forbidden, regexp_extract_all(text, '\\p{{L}}+')[1:1] AS kept FROM documents)
      JOIN (SELECT doc_id, {' + '.join(ENTITIES)} AS pii_hits FROM (SELECT doc_id, {COUNTS_SQL} FROM (SELECT doc_id, {output} AS text FROM documents))) USING (doc_id)
      JOIN (SELECT doc_id, CAST(len(list_intersect({NUMBERS_SQL.format('source')}, {NUMBERS_SQL.format('output')})) AS BIGINT) AS reused_numbers FROM (SELECT doc_id, text AS source, {output} AS output FROM documents)) USING (doc_id)"""


MEANS = ("attack_success", "pii_hits", "reused_numbers", "forbidden_reuse", "utility_retention")


@query(
    f"""WITH m AS ({measured_sql('identity', 'text')} UNION ALL {measured_sql('regex', tagged_sql('text', TOKEN_SQL))}),
    s AS (SELECT *, CASE WHEN pii_hits > 0 OR reused_numbers > 0 OR forbidden_reuse > 0 THEN 1 ELSE 0 END AS attack_success FROM m)
    SELECT baseline, attack_family, count(*) AS cases, {', '.join(f'round(avg({c}), 6) AS {c}' for c in MEANS)} FROM s GROUP BY GROUPING SETS ((baseline), (baseline, attack_family))"""
)
def j7_redteam_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix's summary without the rates of J2 and J3."""
    return text_audit.summarize_redteam(text_audit.redteam_matrix(cases(spark, sf_dir))).select("baseline", "attack_family", "cases", *MEANS)


@query()
def j7_redteam_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_audit.summarize_redteam(text_audit.redteam_matrix(cases(spark, sf_dir)))


@query()
def j9_remediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def blur(rows: DataFrame, i: int) -> DataFrame:
        return rows.select("doc_id", F.regexp_replace("text", r"\p{Nd}+" if i == 1 else r"[\p{L}\p{Nd}]{8,}", "*").alias("text"))

    return text_audit.remediate(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text", blur, 2)[0]


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, list_concat(CASE WHEN doc_id % 2 = 0 THEN ['" + dict(release.ACTIONS)["exact_row_overlap"] + "'] ELSE [] END, list_concat(CASE WHEN doc_id % 3 = 0 THEN ['" + dict(release.ACTIONS)["output_too_short"] + f"'] ELSE [] END, ['{release.LAST_ACTION}'])) AS actions FROM documents")
def h5_next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    codes = F.array_compact(F.array(F.when(i % 3 == 0, "output_too_short"), F.when(i % 2 == 0, "exact_row_overlap")))
    return release.next_actions(docs(spark, sf_dir).select("doc_id", codes.alias("codes")), "doc_id", "codes")
