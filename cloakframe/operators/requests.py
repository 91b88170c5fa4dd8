"""Inspection of outbound requests: names and counts only, never values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import pii


def host_of(url: Column) -> Column:
    """The host, lower case, without user, port and trailing dots; null for what has no host."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)
    return F.nullif(F.lower(F.rtrim(bare, F.lit("."))), F.lit(""))


def classified(df: DataFrame, host_col: str) -> DataFrame:
    """`df` with classification, provider_hint, relay_possible by exact host, then suffix."""
    table = [
        (h, "OFFICIAL_PROVIDER_ENDPOINT", p, False) for h, p in P.OFFICIAL_HOSTS.items()
    ] + [(h, "KNOWN_ROUTER_OR_AGGREGATOR", p, True) for h, p in P.ROUTER_HOSTS.items()]
    known = df.sparkSession.createDataFrame(table, "__h string, classification string, provider_hint string, relay_possible boolean")
    out = df.join(F.broadcast(known), F.col(host_col) == F.col("__h"), "left").drop("__h")
    managed, hint = F.lit(False), F.lit(None).cast("string")
    for suffix, provider in P.MANAGED_SUFFIXES.items():
        hint = F.when(F.col(host_col).endswith(suffix), provider).otherwise(hint)
        managed = managed | F.col(host_col).endswith(suffix)
    fallback = F.when(managed, "MANAGED_CLOUD_ENDPOINT").otherwise("CUSTOM_OR_UNKNOWN_ENDPOINT")
    return out.withColumns(
        {
            "classification": F.coalesce("classification", fallback),
            "provider_hint": F.coalesce("provider_hint", hint),
            "relay_possible": F.coalesce("relay_possible", ~managed),
        }
    )


def classify_endpoints(df: DataFrame, url_col: str) -> DataFrame:
    """`df` with scheme, host, port (defaults filled), endpoint and the classes; other schemes than http(s) give nulls."""
    scheme = F.lower(F.regexp_extract(url_col, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    web = scheme.isin("http", "https")
    port = F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?:([0-9]+)(?:[/?#]|$)", 1).try_cast("int")
    out = df.withColumns(
        {
            "scheme": F.when(web, scheme),
            "host": F.when(web, host_of(F.col(url_col))),
            "port": F.when(web, F.coalesce(port, F.when(scheme == "https", 443).otherwise(80))),
        }
    )
    out = classified(out, "host")
    endpoint = F.concat(
        F.col("scheme"),
        F.lit("://"),
        F.col("host"),
        F.when(
            F.col("port") != F.when(F.col("scheme") == "https", 443).otherwise(80),
            F.concat(F.lit(":"), F.col("port").cast("string")),
        ).otherwise(""),
    )
    return out.withColumn("endpoint", endpoint)


def query_names(url: Column) -> Column:
    """The sorted distinct names of query parameters that look sensitive."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.coalesce(F.try_url_decode(F.regexp_extract(x, r"^([^=]*)", 1)), F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n.rlike(P.SENSITIVE_QUERY))))


def inspect_requests(requests: DataFrame) -> DataFrame:
    """One row a request (method, url, headers, cookies, body) with names, sizes and counts."""
    host = host_of(F.col("url"))
    names = F.transform("headers", lambda h: F.lower(F.trim(h["name"])))
    sensitive = F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isin(*P.SENSITIVE_HEADERS))))
    typed = F.filter("headers", lambda h: (F.lower(F.trim(h["name"])) == "content-type") & h["value"].isNotNull())
    content = F.lower(F.trim(F.substring_index(F.try_element_at(typed, F.lit(-1))["value"], ";", 1)))
    body = F.coalesce("body", F.lit(""))
    hits = sum(pii.entity_counts(body).values(), F.lit(0)).cast("bigint")
    none = F.array().cast("array<string>")
    out = requests.withColumn("host", host).where("host is not null")
    out = classified(out, "host")
    keep = [c for c in requests.columns if c not in ("method", "url", "headers", "cookies", "body")]
    return out.select(
        *keep,
        "host",
        F.upper(F.when(F.coalesce("method", F.lit("")) == "", "UNKNOWN").otherwise(F.col("method"))).alias("method"),
        "classification",
        "provider_hint",
        "relay_possible",
        content.alias("content_type"),
        F.octet_length(body).cast("bigint").alias("body_bytes"),
        hits.alias("pii_hits"),
        F.coalesce(sensitive, none).alias("sensitive_headers"),
        query_names(F.col("url")).alias("sensitive_query"),
        F.regexp_count(body, F.lit(P.SECRET_FIELD)).cast("bigint").alias("secret_fields"),
        F.greatest(F.size("cookies"), F.lit(0)).cast("bigint").alias("cookies"),
    )


def distinct_hosts(inspected: DataFrame, *by: str) -> DataFrame:
    """One row a host (by the columns of `by`) with its entries: the list of hosts as a table, however long."""
    return inspected.groupBy(*by, "host").agg(F.count("*").alias("entries"))


def summarize_requests(inspected: DataFrame, *by: str) -> DataFrame:
    """entries, hosts (how many; distinct_hosts names them), totals and how many entries carry each risk."""
    has = lambda c: F.count_if(F.size(c) > 0)
    return inspected.groupBy(*by).agg(
        F.count("*").alias("entries"),
        F.count_distinct("host").alias("hosts"),
        F.coalesce(F.sum("body_bytes"), F.lit(0)).alias("body_bytes"),
        F.coalesce(F.sum("pii_hits"), F.lit(0)).alias("pii_hits"),
        has("sensitive_headers").alias("with_sensitive_headers"),
        has("sensitive_query").alias("with_sensitive_query"),
        F.count_if(F.col("secret_fields") > 0).alias("with_secret_fields"),
    )
