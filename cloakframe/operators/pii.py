"""Scans for direct identifiers; only counts leave them, never values (but for spans)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import pii
from ..functions.lazy import vectorised
from ..sources.shared import durable

SPAN = "array<struct<start:int,end:int,entity:string,value:string>>"


def scan_table(df: DataFrame, columns: list[str] | None = None, ipv6: bool = True) -> DataFrame:
    """column, entity, hits over the columns as text: one pass of sums, then an unpivot. Pairs without hits are left out."""
    columns = columns or df.columns
    sums = {(c, e): n for c in columns for e, n in pii.entity_counts(F.col(f"`{c}`"), ipv6).items()}
    wide = df.agg(*[F.sum(n).alias(f"{i}") for i, n in enumerate(sums.values())])
    each = [F.struct(F.lit(c).alias("column"), F.lit(e).alias("entity"), F.coalesce(F.col(f"`{i}`"), F.lit(0)).cast("bigint").alias("hits")) for i, (c, e) in enumerate(sums)]
    return wide.select(F.inline(F.array(*each))).where("hits > 0")


def scan_text_column(df: DataFrame, id_col: str, text_col: str, ipv6: bool = True) -> DataFrame:
    """id, the five counts and their total for every row."""
    counts = pii.entity_counts(F.col(text_col), ipv6)
    out = df.select(id_col, *[n.alias(e) for e, n in counts.items()])
    return out.withColumn("total", sum((F.col(e) for e in counts), F.lit(0)).cast("bigint"))


def leaves(c: Column, kind: T.DataType) -> Column:
    """All string keys and string leaves of a nested column as an array of strings; numbers are left out."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), F.array(c)).otherwise(none)
    if isinstance(kind, T.StructType):
        parts = [F.array(*[F.lit(f.name) for f in kind]), *[leaves(c[f.name], f.dataType) for f in kind]]
        return F.when(c.isNotNull(), F.concat(*parts)).otherwise(none)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(c, lambda x: leaves(x, kind.elementType))), none)
    if isinstance(kind, T.MapType):
        keys = F.flatten(F.transform(F.map_keys(c), lambda x: leaves(x, kind.keyType)))
        values = F.flatten(F.transform(F.map_values(c), lambda x: leaves(x, kind.valueType)))
        return F.coalesce(F.concat(keys, values), none)
    return none


def json_texts(df: DataFrame, column: str) -> DataFrame:
    """text: all string keys and string values of a column of JSON texts, level by level; a text that is no JSON is one of them.

    Texts are parsed once, as variants, and opened a level at a time in the JVM: a job a level of nesting, not a row. Repeated keys
    count as no JSON.
    """
    text, tvf = F.col(f"`{column}`").cast("string"), df.sparkSession.tvf
    parsed = durable(df.where(text != "").select(text.alias("text"), F.try_parse_json(text).alias("value")))
    out, level = parsed.where("value is null").select("text"), parsed.where("value is not null").select("value")
    while True:
        shown = level.withColumn("json", F.to_json("value"))
        out = out.unionByName(shown.where(F.startswith("json", F.lit('"'))).select(F.variant_get("value", "$", "string").alias("text")))
        nested = shown.where(F.substring("json", 1, 1).isin("{", "[")).select(F.col("value").alias("whole"))
        parts = durable(nested.lateralJoin(tvf.variant_explode(F.col("whole").outer())).select("key", "value"))
        if not parts.limit(1).count():
            return out
        out = out.unionByName(parts.where("key is not null").select(F.col("key").alias("text")))
        level = parts.where("value is not null").select("value")


def scan_structured(df: DataFrame, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """entity, hits over string keys and leaves of all nested columns; columns named as JSON are parsed first.

    Field and column names are scanned once, not once a row.
    """
    parts = [leaves(F.col(f"`{c}`"), df.schema[c].dataType) for c in df.columns if c not in json_columns]
    texts = df.sparkSession.createDataFrame([(c,) for c in df.columns], "text string")
    if parts:
        texts = texts.unionByName(df.select(F.explode(F.concat(*parts)).alias("text")))
    for c in json_columns:
        texts = texts.unionByName(json_texts(df, c))
    found = scan_table(texts, ["text"], ipv6=True)
    return found.groupBy("entity").agg(F.sum("hits").alias("hits"))


class SpanFinder:
    """The five kinds of identifier spans of a text, without overlaps: earlier, then longer, then by priority."""

    def __init__(self) -> None:
        self.plain = (("NATIONAL_ID", P.python(P.NATIONAL_ID)), ("EMAIL", P.python(P.EMAIL)), ("POSTCODE", P.python(P.POSTCODE)))
        self.phone, self.ip = P.python(P.PHONE), P.python(P.IP_TOKEN)
        self.needs = {"EMAIL": re.compile("@"), "POSTCODE": re.compile(pii.POSTCODE_END), "IP_ADDRESS": re.compile(pii.IP_PART)}
        self.date, self.rank = re.compile(P.WHOLE_DATE), {e: i for i, e in enumerate(P.SPAN_PRIORITY)}

    def candidates(self, text: str) -> Iterator[tuple[int, int, str]]:
        holds = {entity for entity, part in self.needs.items() if part.search(text)}
        for entity, pattern in self.plain:
            if entity in self.needs and entity not in holds:
                continue
            for m in pattern.finditer(text):
                yield m.start(), m.end(), entity
        for m in self.phone.finditer(text):
            said = m[0].strip()
            if not self.date.fullmatch(said) and sum(ch.isdigit() for ch in said) >= P.PHONE_DIGITS:
                yield m.start(), m.end(), "PHONE"
        for m in self.ip.finditer(text) if "IP_ADDRESS" in holds else ():
            bare = m[0].lstrip(P.IP_TRIM)
            start = m.end() - len(bare)
            bare = bare.rstrip(P.IP_TRIM)
            if bare and pii.is_ip(bare):
                yield start, start + len(bare), "IP_ADDRESS"

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        taken, free = [], 0
        for span in sorted(self.candidates(text), key=lambda s: (s[0], s[0] - s[1], self.rank[s[2]])):
            if span[0] >= free:
                taken.append(span)
                free = span[1]
        return taken


@vectorised(SPAN)
def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    find = SpanFinder()
    for b in batches:
        yield b.map(lambda t: [{"start": s, "end": e, "entity": k, "value": t[s:e]} for s, e, k in find(t)] if t else [])


def identifier_spans(c: Column) -> Column:
    """array of (start, end, entity, value) in code points."""
    return _spans(F.coalesce(c.cast("string"), F.lit("")))


@vectorised("string")
def _mask_ips(texts: pd.Series) -> pd.Series:
    token, part = P.python(P.IP_TOKEN), re.compile(pii.IP_PART)

    def one(m: re.Match) -> str:
        bare = m[0].strip(P.IP_TRIM)
        return m[0].replace(bare, "[IP_ADDRESS]", 1) if bare and pii.is_ip(bare) else m[0]

    return texts.map(lambda t: token.sub(one, t) if t and part.search(t) else t)


def redact_baseline(c: Column) -> Column:
    """As the preview, but IP addresses are validated tokens, IPv6 among them."""
    for pattern, tag in ((P.EMAIL, "EMAIL"), (P.PHONE, "PHONE"), (P.NATIONAL_ID, "NATIONAL_ID"), (P.POSTCODE, "POSTCODE")):
        c = F.regexp_replace(c, P.java(pattern), f"[{tag}]")
    return _mask_ips(c)


def inspect_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, characters, lines, pii_hits, release_allowed (false) for every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    hits = sum(pii.entity_counts(text).values(), F.lit(0))
    return df.select(
        id_col,
        F.length(text).cast("bigint").alias("characters"),
        lines.cast("bigint").alias("lines"),
        hits.cast("bigint").alias("pii_hits"),
        F.lit(False).alias("release_allowed"),
    )


def scan_with_detector(df: DataFrame, make: Callable[[], Callable[[str], dict[str, int]]], columns: list[str] | None = None) -> DataFrame:
    """column, entity, hits by a pluggable detector: `make` builds it once a task; only counts leave."""
    columns = columns or df.columns
    texts = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("text")) for c in columns]))
    ).where("text is not null and text <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = make()
        for b in batches:
            rows = [(c, e, n) for c, t in zip(b["column"], b["text"], strict=True) for e, n in detect(t).items()]
            yield pd.DataFrame(rows, columns=["column", "entity", "hits"])

    return texts.mapInPandas(run, "column string, entity string, hits bigint").groupBy("column", "entity").agg(F.sum("hits").alias("hits")).where("hits > 0")


# Rule names and patterns of the secret scan over texts.
SECRET_RULES = {
    "assigned-secret": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{6,}",
    "access-key": r"AKIA[A-Z0-9]{16}",
    "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


def scan_secrets(df: DataFrame, group_col: str, text_col: str, rules: dict[str, str] | None = None) -> DataFrame:
    """rule, group, findings, records by a rule table; the secrets themselves never appear."""
    rules = rules or SECRET_RULES
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.regexp_count(text, F.lit(p)).cast("bigint").alias("n")) for name, p in rules.items()])
    found = df.select(F.col(group_col), F.inline(F.filter(each, lambda x: x["n"] > 0)))
    return found.groupBy("rule", group_col).agg(F.sum("n").alias("findings"), F.count("*").alias("records"))
