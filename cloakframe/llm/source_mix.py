"""Mixing sources to target weights by exponential keys (Efraimidis and Spirakis).

Each source gets a word target from its weight; targets above `cap` times the
source's size are cut there and the excess is shared again by weight until none is
above. A source's mix holds whole epochs first; what is left of its target is filled
by documents in the order of their keys -ln(u) / quality, u drawn from a digest of
the row, until the prefix sum of words reaches the budget. The document at the edge
counts the words that still fit.

DataFrame functions only. The prefix sum runs over key ranges: words are summed by
(source, range) before any shuffle, the edge range of each source is found from these
sums, and only documents inside an edge range are ordered, rows equal in id and text as
one, so a source that holds a third of all rows never meets in one task.

Defined results: null text has size 0; a null source is a source of its own, last in
order; documents of size 0 take 0; sources of size 0 have target 0; repeated rows
count as separate documents, and as many of them are taken as fit; null ids are drawn by
their texts; an empty table gives no rows; extra columns are ignored by `mix` and kept by
`mixed_documents`; very long texts count whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, durable, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Characters that mark junk; their share lowers a document's quality weight.
MARKS = "#$%&*|!@^~<>{}[]\\"
#: Key ranges to a doubling of the key.
RANGES = 1024
WEIGHTS = (5, 2, 1)


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *also: str) -> DataFrame:
    """id, source, size, key, digest and key range: from one scan of the texts; `also` names columns to keep.

    Rows that agree in source, key, digest and size tie; they are rows equal in id and text.
    Key ranges are equal steps of the key's logarithm. A key is an exponential number over a weight, and of those,
    whatever the weight, a step holds log(2) / e / RANGES at most: one row in 4,000.
    """
    text = text_or_empty(text_col)
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    quality = 1 - marks / (F.length(text) + 1)
    # the text takes part, so that rows without ids or with repeated ones are drawn apart
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    # 52 bits of the digest, moved off 0 and 1
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        (-F.log(u) / quality).alias("key"),
        digest.alias("digest"),
        *also,
    ).withColumn("key_range", F.floor(F.log2("key") * RANGES).cast("int"))


def targets(sources: DataFrame, share_percent: int, cap: int, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target; `sources` has one row a source (source, source_size).

    The repeated sharing ends at target = min(cap * size, weight * level) for one
    level; sources leave in the order of cap * size / weight, so the level follows
    from running sums in that order. One row a source passes through one window: a
    list of sources is small beside its documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("bigint")
    everything = Window.partitionBy()
    limit = F.col("source_size") * cap
    ranked = sources.select(
        "source",
        "source_size",
        weight.alias("weight"),
        F.sum("source_size").over(everything).alias("all_words"),
    ).withColumn("limit", limit)
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = (F.col("all_words") * share_percent) / 100 - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("level", left / weight_left)
    # the first source in that order whose limit is above its share fixes the level
    fixed = F.min(
        F.when(F.col("limit") > F.col("weight") * F.col("level"), F.struct((F.col("limit") / F.col("weight")).alias("o"), F.col("level").alias("v")))
    ).over(everything)["v"]
    share = F.coalesce(F.col("weight") * fixed, F.col("limit").cast("double"))
    return level.select("source", "source_size", F.least(F.col("limit").cast("double"), share).alias("target"))


def budgets(rows: DataFrame, share_percent: int, cap: int, weights: tuple[int, ...]) -> DataFrame:
    """s (the source), source_size, target, epochs, budget, edge_range and edge_before: one row a source.

    edge_range is the key range in which the running sum of words crosses the budget
    of the fractional epoch, edge_before the words of all ranges before it.
    """
    ranges = durable(rows.groupBy("source", "key_range").agg(F.sum("size").alias("words")))
    goals = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), share_percent, cap, weights)
    goals = goals.withColumn(
        "epochs",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"),
    )
    goals = goals.withColumn("budget", (F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")).cast("bigint"))
    running = Window.partitionBy("source").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    edge = sums.join(
        goals.withColumnRenamed("source", "s"),
        F.col("source").eqNullSafe(F.col("s")),
    ).groupBy("s", "source_size", "target", "epochs", "budget")
    edge = edge.agg(F.max(F.when(F.col("before") <= F.col("budget"), F.struct("key_range", "before"))).alias("edge"))
    return durable(
        edge.select(
            "s",
            "source_size",
            "target",
            "epochs",
            "budget",
            F.col("edge.key_range").alias("edge_range"),
            F.col("edge.before").alias("edge_before"),
        )
    )


TIE = ("key", "digest", "size")


def edge_ties(placed: DataFrame) -> DataFrame:
    """source, key, digest, size, n and ahead of the ties inside edge ranges: how many rows, and the words of the fractional epoch before them."""
    inside = placed.where(F.col("key_range") == F.col("edge_range"))
    ties = inside.groupBy("source", *TIE).agg(F.count("*").alias("n"), F.first("edge_before").alias("edge_before"), F.first("budget").alias("budget"))
    order = Window.partitionBy("source").orderBy(*TIE).rowsBetween(Window.unboundedPreceding, -1)
    return ties.withColumn("ahead", F.col("edge_before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0)))


def split_tie(rows: DataFrame) -> DataFrame:
    """`rows` (in ties that the budget's edge divides) numbered from 0 within each tie as `nth`.

    Numbers run inside the partitions of the stored rows, a small table carries the counts
    of the partitions before, so a tie that a third of all rows share is spread.
    """
    named = rows.withColumn("mark", F.monotonically_increasing_id())
    named = durable(named).withColumn("part", F.shiftright("mark", 33))
    keys = ("source", *TIE)
    sums = named.groupBy(*keys, "part").agg(F.count("*").alias("rows"))
    over = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("part").alias("_part"),
        F.coalesce(F.sum("rows").over(over), F.lit(0)).alias("rows_before"),
    )
    inside = Window.partitionBy(*keys, "part").orderBy("mark")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "part")]
    out = named.withColumn("in_part", F.row_number().over(inside) - 1).join(ahead, same)
    return out.withColumn("nth", F.col("rows_before") + F.col("in_part"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix-1",
    share_percent: int = 150,
    cap: int = 2,
    weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """id, source, size, source_size, target, epochs, taken for every row.

    `taken` is epochs * size plus what the document adds inside the fractional epoch.
    """
    rows = durable(sized(df, id_col, text_col, source_col, seed))
    edge = budgets(rows, share_percent, cap, weights)
    placed = rows.join(by_size(edge), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    none = F.lit(0).cast("bigint")
    # per source, the last tie of which anything fits: what comes before is taken whole
    fits = edge_ties(placed).where(F.col("ahead") < F.col("budget"))
    last = fits.groupBy("source").agg(F.max(F.struct(*TIE)).alias("last"), F.max("ahead").alias("ahead")).withColumnRenamed("source", "t")
    told = placed.join(by_size(durable(last)), F.col("source").eqNullSafe(F.col("t")), "left").drop("t")
    here, inside = F.struct(*TIE), F.col("key_range") == F.col("edge_range")
    at_edge = F.coalesce(inside & (here == F.col("last")), F.lit(False))
    taken = (F.col("key_range") < F.col("edge_range")) | (inside & F.coalesce(here < F.col("last"), F.lit(False)))
    whole = told.where(~at_edge).withColumn("extra", F.when(taken, F.col("size")).otherwise(none))
    tied = split_tie(told.where(at_edge)).withColumn(
        "extra",
        F.greatest(none, F.least(F.col("size"), F.col("budget") - F.col("ahead") - F.col("nth") * F.col("size"))),
    )
    both = whole.select(*placed.columns, "extra").unionByName(tied.select(*placed.columns, "extra"))
    return both.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        "epochs",
        (F.col("epochs") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"),
    )


def mixed_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix-1",
    share_percent: int = 150,
    cap: int = 2,
    weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """`df` with every row as often as the mix takes it, whole: never cut at a budget's edge.

    The document at the edge of a fractional epoch is taken if at least half of it
    fits; of rows that tie there, as many as fit. Each source's choice is one last tie
    and a number, so texts are not shuffled, but for those of that tie.
    """
    rows = durable(sized(df, id_col, text_col, source_col, seed))
    edge = budgets(rows, share_percent, cap, weights)
    placed = rows.join(by_size(edge), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # the c-th of a tie is taken if ahead + (c - 1/2) size is within the budget
    fit = F.least(F.col("n"), F.floor((2 * (F.col("budget") - F.col("ahead")) + F.col("size")) / (2 * F.col("size"))))
    fits = edge_ties(placed).withColumn("take", F.when(F.col("size") > 0, fit).otherwise(F.lit(0)).cast("bigint")).where("take > 0")
    last = fits.groupBy("source").agg(
        F.max(F.struct(*TIE)).alias("last"),
        F.max_by(F.struct("take", "n"), F.struct(*TIE)).alias("cut"),
    ).withColumnRenamed("source", "t")
    plan = durable(edge.join(last, F.col("s").eqNullSafe(F.col("t")), "left").select("s", "epochs", "edge_range", "last", "cut"))
    whole_row = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    drawn = sized(
        df.select(whole_row, F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(source_col).alias("__source")),
        "__id",
        "__text",
        "__source",
        seed,
        "__row",
    )
    told = drawn.join(by_size(plan), F.col("source").eqNullSafe(F.col("s")))
    here, inside = F.struct(*TIE), F.col("key_range") == F.col("edge_range")
    tie = inside & F.coalesce(here == F.col("last"), F.lit(False))
    divided = tie & (F.col("cut.take") < F.col("cut.n"))
    taken = (F.col("key_range") < F.col("edge_range")) | (inside & F.coalesce(here <= F.col("last"), F.lit(False)))
    copies = F.col("epochs") + F.when(taken, 1).otherwise(0)
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("__n")
    plain = told.where(~divided & (copies > 0)).select("__row", times(copies))
    # a tie that the edge divides: its rows are equal in id and text, and the first of them are taken once more
    tied = split_tie(told.where(divided).select("source", *TIE, "epochs", F.col("cut.take").alias("take"), "__row"))
    more = F.col("epochs") + F.when(F.col("nth") < F.col("take"), 1).otherwise(0)
    out = plain.unionByName(tied.where(more > 0).select("__row", times(more)))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in df.columns])
