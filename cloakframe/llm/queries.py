"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable
from pathlib import Path
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_topk, chat_format, conversation_repair, embedding_join, gkl_whitening, media_tiles, pii_anchor, quality_nbsvm, secret_ledger, sentencepiece_scan, simhash_ring, source_mix, token_count
from .common import table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.piece_digest(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is filled from the first half of the ids, as an earlier version of the table; then the rest is brought in."""
    documents = table(spark, sf_dir, "documents")
    middle = documents.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("m")).first()["m"]
    return secret_ledger.secret_digest(documents, earlier=F.col("doc_id") <= F.lit(middle))


def op3_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        said.alias("text"),
    )
    return chat_format.conversation_digest(chat_format.format_blocks(conversations.unionByName(probe)))


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_anchor.pii_digest(table(spark, sf_dir, "documents"))


def op5_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_nbsvm.score(documents, quality_nbsvm.fit(documents, table(spark, sf_dir, "labels")))


def op8_simhash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ring.near_duplicates(table(spark, sf_dir, "documents"))


def op9_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_tiles.text_media_features(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digest(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op12_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_topk.top_k(table(spark, sf_dir, "embeddings"))


def op13_gkl_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gkl_whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline() -> ModuleType:
    """corpus_pipeline.py at the top of the repository, whatever the working directory."""
    name = "corpus_pipeline"
    if name not in sys.modules:
        spec = importlib.util.spec_from_file_location(name, Path(__file__).resolve().parents[2] / f"{name}.py")
        sys.modules[name] = module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    return sys.modules[name]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_sentencepiece_scan,
        op2_secret_ledger,
        op3_prefix_target_chat,
        op4_pii_anchors,
        op5_metric_range_join,
        op6_token_count,
        op7_quality_nbsvm,
        op8_simhash_ring,
        op9_media_tiles,
        op10_source_mix,
        op11_conversation_repair,
        op12_block_topk,
        op13_gkl_whitening,
    ]
    return {f.__name__: f for f in found} | {"pipeline": pipeline().run}


OP3_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), formatted AS (
  SELECT *, '<s>[ROLE]' || regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))', '\1\\\2\3', 'g') || '[/ROLE]'
    || CASE WHEN role = 'user' THEN '[INST] ' ELSE '' END
    || regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))', '\1\\\2\3', 'g')
    || CASE WHEN role = 'user' THEN ' [/INST]' ELSE '' END || '</s>' AS segment
  FROM said
), placed AS (
  SELECT *, row_number() OVER w AS n, sum(length(segment)) OVER w AS until
  FROM formatted
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, sha256(text) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY n), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN until ELSE 0 END) + max(until)
    - max(CASE WHEN role = 'assistant' THEN until ELSE 0 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
      / (1 - CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#$%&*|!@^~<>{}\[\]\\]', '', 'g')) AS DOUBLE) / (length(coalesce(text, '')) + 1)) AS key,
    md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS digest
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), levels AS (
  SELECT *, 2 * source_size AS most,
    (CAST((SELECT sum(source_size) FROM sources) AS DOUBLE) * 150 / 100 - coalesce(sum(2 * source_size) OVER w, 0))
      / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed
  WINDOW w AS (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE),
    coalesce(weight * (SELECT arg_min(level, most / CAST(weight AS DOUBLE)) FROM levels WHERE most > weight * level), CAST(most AS DOUBLE))) AS target
  FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals
), ordered AS (
  SELECT doc_id, size, b.source_size, target, epochs, CAST(floor(target) AS BIGINT) - epochs * b.source_size
    - coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM ordered
"""


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a
), top AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM p GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(top.b, vec_id)) AS component_id, vec_id <= coalesce(top.b, vec_id) AS kept
FROM embeddings LEFT JOIN top ON vec_id = top.a LEFT JOIN n ON vec_id = n.a
"""

OP11_SQL = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
        string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
        lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END
    ), 4294967295) % 20 AS code
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) FROM said WHERE code <> 0)
), placed AS (
  SELECT *, left(role, 1) AS initial,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM damaged
), timed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS time FROM placed
), faulty AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair,
    CASE WHEN body = '' THEN 'b' WHEN time > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM timed
), counted AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS rows
  FROM faulty GROUP BY conv_id
), -- a way to a state: six digits of cost, then the initials of its edits
search AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, '000000' AS e, CAST(NULL AS VARCHAR) AS s, '000003I' AS u, '000006II' AS a FROM faulty
  UNION ALL
  SELECT conv_id, n, e, s, u, least(a, printf('%06d', CAST(left(u, 6) AS INT) + 3) || substr(u, 7) || 'I')
  FROM (
    SELECT conv_id, n, e, s, a, least(u, printf('%06d', CAST(left(least(e, s, a), 6) AS INT) + 3) || substr(least(e, s, a), 7) || 'I') AS u
    FROM (
      SELECT x.conv_id, f.n,
        printf('%06d', CAST(left(e, 6) AS INT) + 4) || substr(e, 7) || 'D' AS e,
        least(printf('%06d', CAST(left(s, 6) AS INT) + 4) || substr(s, 7) || 'D',
          CASE WHEN fault IN ('', 't') AND initial = 's' THEN printf('%06d', CAST(left(e, 6) AS INT) + CASE fault WHEN 't' THEN 3 ELSE 0 END) || substr(e, 7) || 'K' END) AS s,
        least(printf('%06d', CAST(left(u, 6) AS INT) + 4) || substr(u, 7) || 'D',
          CASE WHEN fault IN ('', 't') THEN printf('%06d', CAST(left(least(e, s, a), 6) AS INT) + CASE fault WHEN 't' THEN 3 ELSE 0 END
            + CASE initial WHEN 'u' THEN 0 ELSE 3 END) || substr(least(e, s, a), 7) || CASE initial WHEN 'u' THEN 'K' ELSE 'R' END END) AS u,
        least(printf('%06d', CAST(left(a, 6) AS INT) + 4) || substr(a, 7) || 'D',
          CASE WHEN fault IN ('', 't') THEN printf('%06d', CAST(left(u, 6) AS INT) + CASE fault WHEN 't' THEN 3 ELSE 0 END
            + CASE initial WHEN 'a' THEN 0 ELSE 3 END) || substr(u, 7) || CASE initial WHEN 'a' THEN 'K' ELSE 'R' END END) AS a
      FROM search x JOIN faulty f ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = x.n + 1
    )
  )
), best AS (
  SELECT c.*, CAST(left(least(e, a), 6) AS BIGINT) AS cost, substr(least(e, a), 7) AS audit
  FROM counted c JOIN search x ON c.conv_id IS NOT DISTINCT FROM x.conv_id AND c.rows = x.n
), steps AS (
  SELECT conv_id, i, substr(audit, i, 1) AS edit,
    sum(CASE WHEN substr(audit, i, 1) IN ('K', 'R', 'D') THEN 1 ELSE 0 END) OVER w AS n,
    sum(CASE WHEN substr(audit, i, 1) IN ('K', 'R', 'I') THEN 1 ELSE 0 END) OVER w AS place
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM best)
  WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), matched AS (
  SELECT s.conv_id, s.i, s.edit, s.place, CASE WHEN s.edit = 'I' THEN '' ELSE f.text END AS text, f.role,
    max(CASE WHEN s.edit = 'K' AND s.place = 1 AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS lead
  FROM steps s LEFT JOIN faulty f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.n = f.n
  WHERE s.edit <> 'D'
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS digest
  FROM matched GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""

OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.place, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.place <> c.place WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_prefix_target_chat": OP3_SQL,
        "op5_metric_range_join": OP5_SQL,
        "op10_source_mix": OP10_SQL,
        "op11_conversation_repair": OP11_SQL,
        "op12_block_topk": OP12_SQL,
    }
