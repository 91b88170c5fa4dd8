"""SimHash near-duplicates with pigeonring filtering (Qin and Xiao, 2018).

A fingerprint has 64 bits, each the majority of that bit over the hashes of all word
shingles. Two fingerprints within `distance` bits are linked. The bits are cut into
distance + 1 segments on a ring; for any linked pair there is a segment from which
every chain of l consecutive segments differs in at most l * distance / segments bits.
The first chain (one segment) must then be equal, and the second segment differs in
so few bits that one of its halves is equal too: segment plus half form the join key.
The chain budgets prune the pairs that share a key before the full Hamming check.

Keys that many fingerprints share are not paired. Their members are linked through
the balls around them: each emits all points within half the distance, rounded up, and
two fingerprints are within the distance exactly when a point lies within half of it,
rounded down, of one and in the other's ball; so rows grow with the members and every
group is small. Nothing is dropped.

Defined results: null text is empty; texts without words have fingerprint zero and
link like any other; repeated rows and equal texts share a fingerprint and so a
component; rows with a null id get the smallest id reachable; an empty table gives no
rows; extra columns are ignored; very long texts are hashed whole, in linear time.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_texts, text_or_empty
from .components import components, dealt_join

SEED = 42
#: Fingerprints that share a key are paired up to this many, else linked through their balls.
PAIRED = 64
BITS = 64
#: The largest distance that the ring is written for.
MOST = 4


def fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of one text, as a signed 64-bit integer."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    out = int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")
    return out - (1 << BITS) if out >> (BITS - 1) else out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id and fp (signed 64-bit) for every whole text; a map over the scan."""
    return map_texts(df, id_col, text_col, lambda: lambda text: (fingerprint(text, width),), "fp bigint")


def segments(count: int) -> list[tuple[int, int]]:
    """(lowest bit, size) of each segment."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def bits(c: Column, low: int, size: int) -> Column:
    return F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << size) - 1).cast("bigint"))


def chain_holds(x: Column, start: int, cuts: list[tuple[int, int]], distance: int) -> Column:
    """Whether the difference bits x stay within the budgets of all chains from one segment."""
    total, ok = F.lit(0), F.lit(True)
    for length in range(1, len(cuts) + 1):
        low, size = cuts[(start + length - 1) % len(cuts)]
        total = total + F.bit_count(bits(x, low, size))
        ok = ok & (total <= length * distance // len(cuts))
    return ok


def ball(c: Column, radius: int) -> Column:
    """All fingerprints within `radius` bits, as an array."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(BITS), r)]
    signed = F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("bigint") for m in masks])
    return F.transform(signed, lambda m: c.bitwiseXOR(m))


def ring_links(prints: DataFrame, distance: int = 2, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within `distance` bits.

    `prints` has distinct column fp. Linked pairs that share a crowded key may be
    joined through fingerprints between them: the links give the same components.
    Distances go up to MOST; beyond, segments are too short to be keys, and balls too large.
    """
    if not 1 <= distance <= MOST:
        raise ValueError(f"distances from 1 to {MOST} bits")
    cuts = segments(distance + 1)
    keys = []
    for start in range(len(cuts)):
        low, size = cuts[start]
        next_low, next_size = cuts[(start + 1) % len(cuts)]
        half = next_size // 2
        # the second chain leaves the next segment one bit at most, so one of its halves is equal
        for part, (at, n) in enumerate([(next_low, half), (next_low + half, next_size - half)]):
            # segment (32 bits at most), half (16 at most) and which of them: 52 bits
            key = F.shiftleft(bits(F.col("fp"), low, size), 20) + F.shiftleft(bits(F.col("fp"), at, n), 4) + F.lit(2 * start + part)
            keys.append(F.struct(key.cast("bigint").alias("key"), F.lit(start).alias("start")))
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.key", "k.start")
    sizes = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    few = keyed.join(sizes.where(F.col("n") <= paired), "key", "left_semi")
    x = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.coalesce(*[F.when(F.col("start") == s, chain_holds(x, s, cuts, distance)) for s in range(len(cuts))])
    left = few.select("key", F.col("fp").alias("a"), "start")
    right = few.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").where(F.col("a") < F.col("b")).where(chain & (F.bit_count(x) <= distance)).select("a", "b")
    crowded = durable(keyed.join(sizes.where(F.col("n") > paired), "key", "left_semi").select("fp").distinct())
    if not crowded.limit(1).count():
        return pairs.distinct()
    # two are within the distance if a point lies within half of it from one and within the rest from the other
    inner, outer = distance // 2, distance - distance // 2
    near = crowded.select("fp", F.explode(ball(F.col("fp"), outer)).alias("centre"))
    near = near.withColumn("hub", F.when(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= inner, F.col("fp")))
    # a ball holds few points, so no more fingerprints than that share a centre
    centres = near.groupBy("centre").agg(
        F.min("hub").alias("a"),
        F.collect_set("fp").alias("all"),
    ).where(F.col("a").isNotNull() & (F.size("all") > 1))
    stars = centres.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def grouped(df: DataFrame, id_col: str, text_col: str, width: int, distance: int) -> DataFrame:
    """id, sha (of the text), fp, top (a fingerprint that names the component) and component_id for every row."""

    def make():
        return lambda text: (fingerprint(text, width), hashlib.sha256(text.encode("utf-8")).hexdigest())

    rows = durable(map_texts(df, id_col, text_col, make, "fp bigint, sha string").withColumnRenamed(id_col, "id"))
    prints = durable(rows.groupBy("fp").agg(F.min("id").alias("rep")))
    return in_components(rows, prints, ring_links(prints.select("fp"), distance))


def in_components(rows: DataFrame, prints: DataFrame, links: DataFrame) -> DataFrame:
    """`rows` with top and component_id; `prints` has every fp of theirs with its smallest id (rep), `links` join fps (a, b)."""
    # components run over fingerprints; each then takes its smallest document
    found = components(links).select(F.col("id").alias("fp"), F.col("component").alias("top"))
    tops = durable(prints.select("fp", "rep").join(found, "fp", "left").withColumn("top", F.coalesce("top", "fp")))
    # a component may hold very many fingerprints
    smallest = tops.groupBy("top").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    by_print = durable(dealt_join(tops.select("top", "fp"), smallest, "top", "fp").select(F.col("fp").alias("p"), "top", "component_id"))
    return rows.join(by_print, F.col("fp") == F.col("p")).drop("p")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (smallest id reachable) for every row."""
    return grouped(df, id_col, text_col, width, distance).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """`df` with one row of each component: that of its smallest id (null last), then of its smallest digest.

    Rows with equal id and text are one before they are shuffled.
    """
    return keep_smallest(df, grouped(df, id_col, text_col, width, distance), id_col, text_col)


def row_key(id_col: Column, sha: Column) -> Column:
    """Names rows of equal id and text; never null."""
    return F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit("="), sha)


def keep_smallest(df: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`df` with one row of each group (id, sha, top), as keep_representatives has it."""
    order = F.struct(F.col("id").isNull().alias("last"), "id", "sha")
    best = groups.groupBy("top").agg(F.min(order).alias("k"))
    # a key that is never null: the group and the join then share one shuffle of the texts
    keep = durable(best.select(row_key(F.col("k.id"), F.col("k.sha")).alias("__key")))
    rest = [c for c in df.columns if c != text_col]
    rows = df.select(
        row_key(F.col(id_col), F.sha2(text_or_empty(text_col), 256)).alias("__key"),
        F.col(f"`{text_col}`").alias("__text"),
        F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in rest]).alias("__rest"),
    )
    # rows equal in id and text: the one whose other columns are smallest, so that reruns agree
    once = rows.groupBy("__key").agg(F.min_by("__rest", F.to_json("__rest")).alias("__rest"), F.max("__text").alias("__text"))
    return once.join(keep, "__key", "left_semi").select(
        *[F.col("__text").alias(c) if c == text_col else F.col(f"__rest.`{c}`").alias(c) for c in df.columns]
    )
