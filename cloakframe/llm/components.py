"""Connected components of links between ids, by alternating stars.

Large-star and small-star steps (Kiveris et al., 2014) with sums before shuffles:
each step takes the smallest neighbour of every id by a partial aggregate and joins
it back to the links. An id with more than PER_TASK links is dealt over as many salts
as its count asks for, so an id that a third of all links share never gathers them in
one task; where there are no more links than that in all, nothing is counted by id for it.
Rounds are checkpointed, and end as soon as all links are stars, which may be at once;
their number grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, durable

#: Links of one id to a task.
PER_TASK = 200_000


def dealt_join(rows: DataFrame, side: DataFrame, key: str, by: str, count: str = "n") -> DataFrame:
    """`rows` joined on `key` with `side`, which has one row a key and in `count` how many rows it meets.

    Keys that meet more than PER_TASK rows (a list of at most rows / PER_TASK) are dealt by
    a hash of the column `by`; their row of `side` is repeated as often.
    """
    many = side.where(F.col(count) > PER_TASK).select(F.col(key).alias("__k"), (1 + F.floor(F.col(count) / PER_TASK)).cast("int").alias("__s"))
    salt = F.coalesce(F.pmod(F.hash(by), F.col("__s")), F.lit(0))
    left = rows.join(by_size(many), F.col(key) == F.col("__k"), "left").withColumn("__salt", salt).drop("__k", "__s")
    salts = F.sequence(F.lit(0), F.floor(F.col(count) / PER_TASK).cast("int"))
    return left.join(side.withColumn("__salt", F.explode(salts)).drop(count), [key, "__salt"]).drop("__salt")


def point_to_smallest(links: DataFrame, larger_only: bool, dealt: bool = True) -> DataFrame:
    """One star step over links (u, v) with u > v: the neighbours concerned are linked to the smallest.

    `dealt` says whether an id may have more than PER_TASK links.
    """
    meet = (lambda rows, side: dealt_join(rows, side, "u", "v")) if dealt else (lambda rows, side: rows.join(side.drop("n"), "u"))
    if larger_only:  # every neighbour above u is linked to the smallest neighbour of u (or u)
        both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        smallest = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        out = meet(both.where("v > u"), smallest).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its neighbours below are linked to the smallest of them
        smallest = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        out = meet(links, smallest).select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def shape(links: DataFrame) -> tuple[int, bool]:
    """The number of links (u, v) with u > v, and whether all are stars: no id is both centre and leaf, and each leaf has one centre."""
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("id"), F.lit(leaf).alias("leaf")) for c, leaf in (("u", 1), ("v", 0))])).alias("e")
    ids = links.select(ends).groupBy("e.id").agg(F.sum("e.leaf").alias("leaf"), F.count("*").alias("n"))
    told = ids.agg(F.sum("leaf").alias("links"), F.max((F.col("leaf") > 0) & (F.col("n") > 1)).alias("more")).first()
    return told["links"] or 0, not told["more"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component for every id that has a link to another id; component is the smallest id reachable.

    Links with a null end and links of an id to itself are ignored. Ids are of any kind that has an order.
    """
    now = durable(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not (told := shape(now))[1]:
        dealt = told[0] > PER_TASK
        half = point_to_smallest(now, True, dealt)
        # counting the ids' links would go through the first step again
        now = durable(point_to_smallest(durable(half) if dealt else half, False, dealt))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
