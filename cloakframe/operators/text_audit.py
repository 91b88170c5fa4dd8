"""What a transformed text still shares with its source."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import pii
from ..functions.keys import rate
from ..functions.lazy import vectorised
from . import pii as pii_ops

#: What is neither a letter nor a digit; hashes of a source that are held at one time; n-grams compared at one time.
NO_LETTER, HELD, STRIP = re.compile(r"[\W_]+"), 4_000_000, 65_536
GATE = ("direct_pii_detected", "source_number_reuse", "character_ngram_reuse", "distinctive_token_reuse", "output_too_short")


def number_tokens(c: Column) -> Column:
    """Distinct numbers and date-like tokens, without punctuation at the end."""
    found = F.regexp_extract_all(c, F.lit(P.java(P.NUMBER_TOKEN)), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.rtrim(x, F.lit("./:-"))), lambda x: x != ""))


def number_reuse(source: Column, output: Column) -> Column:
    return F.size(F.array_intersect(number_tokens(source), number_tokens(output))).cast("bigint")


@vectorised("string")
def compatibility_lower(texts: pd.Series) -> pd.Series:
    """NFKC and lower case; Spark has no Unicode normalisation of its own."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).lower() if t else t)


def folded(c: Column, ascii_only: bool = False) -> Column:
    return F.lower(c) if ascii_only else compatibility_lower(c)


def plain_text(text: str | None) -> str:
    """NFKC, lower case, letters and digits only."""
    text = text or ""
    return NO_LETTER.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def code_points(plain: str) -> np.ndarray:
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)


def ngram_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` code points, from hashes of runs half as long: linear in the text."""
    if len(points) < size:
        return np.zeros(0, np.uint64)
    points = points.astype(np.uint64)
    with np.errstate(over="ignore"):
        # characters are scattered first, so that runs of near characters stay apart
        one = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        one ^= one >> np.uint64(29)
        power, step = one, np.uint64(0xD6E8FEB86659FD93)
        out, taken, width = None, 0, 1
        while taken < size:
            if size & width:
                # the runs so far, and the runs of this width that follow them
                tail = power[taken:]
                out = tail.copy() if out is None else out[: len(tail)] * step + tail[: len(out)]
                taken += width
            longer = power[: max(len(power) - width, 0)] * step + power[width:]
            power, step, width = longer ^ (longer >> np.uint64(31)), step * step + np.uint64(2), width * 2
    return out[: len(points) - size + 1]


def pieces_of(points: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first, hashes) of a text's n-grams, some at a time."""
    for at in range(0, max(len(points) - size + 1, 0), HELD):
        yield at, ngram_hashes(points[at : at + HELD + size - 1], size)


def reused_ngrams(source: str, output: str, size: int) -> tuple[int, int]:
    """(n-grams of the output, by place, that the source holds; n-grams of the output) of two plain texts.

    Equal hashes only propose a place; the characters decide. Of a source longer than HELD the hashes are
    taken in shares of the hash values, one share at a time, so memory is bounded and the result is the same.
    """
    if source == output:
        return (max(len(output) - size + 1, 0),) * 2
    held, said = code_points(source), code_points(output)
    total = max(len(said) - size + 1, 0)
    if not total or len(held) < size:
        return 0, total
    windows, own = (np.lib.stride_tricks.sliding_window_view(x, size) for x in (held, said))
    shares, found = np.uint64(1 + (len(held) - size) // HELD), 0
    for share in range(int(shares)):
        mine = lambda hashes: np.flatnonzero(hashes % shares == share) if shares > 1 else np.arange(len(hashes))
        parts = [(at + (keep := mine(hashes)), hashes[keep]) for at, hashes in pieces_of(held, size)]
        places, hashes = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(hashes, kind="stable")
        places, hashes = places[order], hashes[order]
        for at, asked in pieces_of(said, size):
            first = np.searchsorted(hashes, asked)
            known = np.flatnonzero(
                (first < len(hashes)) & (hashes[np.minimum(first, len(hashes) - 1)] == asked)
            ) if len(hashes) else np.zeros(0, np.int64)
            for i in range(0, len(known), STRIP):
                hit = known[i : i + STRIP]
                k, j = at + hit, places[first[hit]]
                # what follows an equal n-gram on either side is equal if its last character is
                follows = np.zeros(len(hit), bool)
                follows[1:] = (np.diff(k) == 1) & (np.diff(j) == 1)
                if (said[k + size - 1] == held[j + size - 1]).all() and (own[k[~follows]] == windows[j[~follows]]).all():
                    found += len(hit)
                    continue
                same = (own[k] == windows[j]).all(axis=1)
                found += int(same.sum())
                # another n-gram has this hash: whether one of the others is ours
                for k in hit[~same]:
                    others = places[first[k] : np.searchsorted(hashes, asked[k], "right")]
                    found += bool((windows[others] == own[at + k]).all(axis=1).any())
    return found, total


def ngram_reuse_udf(size: int):
    if size < 8:
        raise ValueError("n-grams have 8 characters or more")

    @vectorised("struct<reused:bigint,total:bigint>")
    def count(source: pd.Series, output: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [reused_ngrams(plain_text(s), plain_text(o), size) for s, o in zip(source, output, strict=True)],
            columns=["reused", "total"],
        )

    return count


def char_ngram_reuse(df: DataFrame, id_col: str, source_col: str, output_col: str, size: int = 32) -> DataFrame:
    """id, reused_ngrams, output_ngrams, ngram_reuse_rate over positions of the output: a row out for a row in, whatever its id and length."""
    rows = df.select(id_col, ngram_reuse_udf(size)(F.col(source_col), F.col(output_col)).alias("n"))
    out = rows.select(id_col, F.col("n.reused").alias("reused_ngrams"), F.col("n.total").alias("output_ngrams"))
    return out.withColumn("ngram_reuse_rate", rate(F.col("reused_ngrams"), F.col("output_ngrams")))


def long_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(P.java(P.LONG_WORD)), F.lit(0))


def with_token_reuse(df: DataFrame, source: Column, output: Column) -> DataFrame:
    """`df` with distinctive_tokens, reused_tokens, token_reuse_rate of two folded texts; nothing is shuffled."""
    words = df.withColumns({"__w": F.array_sort(long_words(source)), "__o": F.array_distinct(long_words(output))})
    # sorted, a word that comes once differs from both neighbours
    alone = F.filter("__w", lambda x, i: ~F.get("__w", i - 1).eqNullSafe(x) & ~F.get("__w", i + 1).eqNullSafe(x))
    once = words.withColumn("__once", alone)
    out = once.withColumns(
        {"distinctive_tokens": F.size("__once").cast("bigint"), "reused_tokens": F.size(F.array_intersect("__once", "__o")).cast("bigint")}
    )
    return out.withColumn("token_reuse_rate", rate(F.col("reused_tokens"), F.col("distinctive_tokens"))).drop("__w", "__o", "__once")


def distinctive_token_reuse(df: DataFrame, id_col: str, source_col: str, output_col: str, ascii_only: bool = False) -> DataFrame:
    """id, distinctive_tokens, reused_tokens, token_reuse_rate: long words that the source has exactly once."""
    fold = lambda c: folded(F.coalesce(F.col(c), F.lit("")), ascii_only)
    rows = df.select(id_col, fold(source_col).alias("__s"), fold(output_col).alias("__t"))
    return with_token_reuse(rows, F.col("__s"), F.col("__t")).drop("__s", "__t")


def semantic_gate(df: DataFrame) -> DataFrame:
    """`df` with failed_conditions and eligible_for_manual_review, by pii_hits, reused_numbers, the two rates and output_chars."""
    flags = (
        F.col("pii_hits") > 0,
        F.col("reused_numbers") > 0,
        F.col("ngram_reuse_rate") > P.MAX_NGRAM_REUSE,
        F.col("token_reuse_rate") > P.MAX_TOKEN_REUSE,
        F.col("output_chars") < P.MIN_OUTPUT_CHARS,
    )
    out = df.withColumn("failed_conditions", F.array_compact(F.array(*[F.when(f, F.lit(c)) for f, c in zip(flags, GATE, strict=True)])))
    return out.withColumn("eligible_for_manual_review", F.size("failed_conditions") == 0).withColumn("release_allowed", F.lit(False))


def token_reuse(source: str, output: str) -> tuple[int, int]:
    """(distinctive tokens, those that the output has): long words that the folded source has exactly once."""
    word = P.python(P.LONG_WORD)
    once = {w for w, n in Counter(word.findall(source)).items() if n == 1}
    return len(once), len(once.intersection(word.findall(output)))


def pair_measures(size: int):
    """What needs folded texts, of a pair: both are folded once."""
    if size < 8:
        raise ValueError("n-grams have 8 characters or more")

    @vectorised("struct<reused_ngrams:bigint,output_ngrams:bigint,distinctive_tokens:bigint,reused_tokens:bigint>")
    def measure(source: pd.Series, output: pd.Series) -> pd.DataFrame:
        rows = []
        for pair in zip(source, output, strict=True):
            s, o = (unicodedata.normalize("NFKC", t or "").lower() for t in pair)
            rows.append((*reused_ngrams(NO_LETTER.sub("", s), NO_LETTER.sub("", o), size), *token_reuse(s, o)))
        return pd.DataFrame(rows, columns=["reused_ngrams", "output_ngrams", "distinctive_tokens", "reused_tokens"])

    return measure


def audit_pairs(source: DataFrame, output: DataFrame, key: str, text_col: str = "text", size: int = 32) -> DataFrame:
    """One row a pair with all measures and the gate: one join, one function over the folded texts, then columns."""
    pairs = source.select(key, F.col(text_col).alias("source")).join(output.select(key, F.col(text_col).alias("output")), key)
    return measured_pairs(pairs, [key], size)


def measured_pairs(pairs: DataFrame, keep: list[str], size: int = 32) -> DataFrame:
    """The columns of `keep`, all measures and the gate of rows that hold both texts (source, output); nothing is shuffled."""
    rows = pairs.select(
        *keep,
        number_reuse(F.col("source"), F.col("output")).alias("reused_numbers"),
        sum(pii.entity_counts(F.col("output")).values(), F.lit(0)).cast("bigint").alias("pii_hits"),
        F.length("output").cast("bigint").alias("output_chars"),
        pair_measures(size)(F.col("source"), F.col("output")).alias("__m"),
    )
    rows = rows.select("*", "__m.*").drop("__m")
    shares = {
        "ngram_reuse_rate": rate(F.col("reused_ngrams"), F.col("output_ngrams")),
        "token_reuse_rate": rate(F.col("reused_tokens"), F.col("distinctive_tokens")),
    }
    return semantic_gate(rows.withColumns(shares))


def score_redteam(audited: DataFrame, cases: DataFrame) -> DataFrame:
    """audited (id, output and audit columns) with forbidden_reuse, utility_retention, attack_success by the case's lists."""
    return scored_rows(audited.join(cases.select("id", "attack_family", "forbidden_literals", "utility_concepts"), "id"))


def scored_rows(joined: DataFrame) -> DataFrame:
    """As above, of audited rows that hold their case's columns."""
    said = F.lower("output")
    reuse = F.size(F.filter("forbidden_literals", lambda x: said.contains(F.lower(x)))).cast("bigint")
    kept = F.size(F.filter("utility_concepts", lambda g: F.exists(g, lambda t: said.contains(F.lower(t)))))
    out = joined.withColumn("forbidden_reuse", reuse)
    out = out.withColumn(
        "utility_retention",
        F.when(F.size("utility_concepts") > 0, F.round(kept / F.size("utility_concepts"), 6)).otherwise(F.lit(1.0)),
    )
    success = (F.col("pii_hits") > 0) | (F.col("reused_numbers") > 0) | (F.col("forbidden_reuse") > 0)
    return out.withColumn("attack_success", success.cast("int")).drop("forbidden_literals", "utility_concepts")


BASELINES: dict[str, Callable[[Column], Column]] = {"identity": lambda c: c, "regex": pii_ops.redact_baseline}


def redteam_matrix(cases: DataFrame, baselines: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """id, baseline, attack_family and all measures: every case under every baseline.

    A case's output comes from its own row, so no text is joined back or shuffled; a case without an id has no rows.
    """
    baselines = baselines or BASELINES
    held = ["attack_family", "forbidden_literals", "utility_concepts"]
    out = None
    for name, transform in baselines.items():
        made = cases.where("id is not null").select("id", "source", transform(F.col("source")).alias("output"), *held)
        one = scored_rows(measured_pairs(made, ["id", "output", *held])).withColumn("baseline", F.lit(name)).drop("output")
        out = one if out is None else out.unionByName(one)
    return out


def summarize_redteam(matrix: DataFrame) -> DataFrame:
    """Means by baseline and by (baseline, attack_family); family is null for the former."""
    sets = [["baseline"], ["baseline", "attack_family"]]
    grouped = matrix.groupingSets([[F.col(c) for c in s] for s in sets], "baseline", "attack_family")
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return grouped.agg(
        F.count("*").alias("cases"),
        *[mean(c) for c in ("attack_success", "pii_hits", "reused_numbers", "forbidden_reuse", "ngram_reuse_rate", "token_reuse_rate", "utility_retention")],
    )


def remediate(
    df: DataFrame,
    key: str,
    text_col: str,
    transform: Callable[[DataFrame, int], DataFrame],
    max_rounds: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Final rows (key, text, status) and the log of attempts.

    Texts are pre-redacted, transformed and audited against the original; only rows that
    fail go into the next round. `transform(rows, round)` takes and returns (key, text).
    """
    if not 1 <= max_rounds <= 3:
        raise ValueError("1 to 3 rounds")
    from ..sources.shared import durable

    source = df.select(key, F.col(text_col).alias("text"))
    todo = source.select(key, pii.redact_preview(F.col("text")).alias("text"))
    final = log = None
    for i in range(1, max_rounds + 1):
        made = durable(transform(todo, i).select(key, "text"))
        audited = durable(audit_pairs(source, made, key).select(key, "failed_conditions", "eligible_for_manual_review"))
        attempt = audited.withColumn("round", F.lit(i))
        log = attempt if log is None else log.unionByName(attempt)
        ok = made.join(audited.where("eligible_for_manual_review"), key, "left_semi").withColumn("status", F.lit("MANUAL_REVIEW_CANDIDATE"))
        final = ok if final is None else final.unionByName(ok)
        todo = made.join(audited.where("not eligible_for_manual_review"), key, "left_semi")
        if not todo.limit(1).count():
            break
    return final.unionByName(todo.withColumn("status", F.lit("LOCAL_ONLY"))), log
