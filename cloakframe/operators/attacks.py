"""Privacy attacks as measurements; entity values never leave them."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.keys import as_key, rate
from ..functions.ranges import before, bounds, place_of
from ..sources.shared import durable, durable_once

#: Ranges of a nearest-neighbour search, rows whose distances are held at one time, and distances that are.
RANGES, STRIP, HELD = 1024, 256, 1 << 20
#: Neighbours by order on either side that are compared in turn, before all within reach are.
NEXT = (8, 32, 128)


def band(auc: Column) -> Column:
    """How an AUC reads: elevated from 0.7, above chance from 0.6."""
    return F.when(auc >= 0.7, "elevated").when(auc >= 0.6, "above_chance").otherwise("near_chance")


def renamed_keys(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """Only `columns`, as keys under names of our own, which none of theirs can clash with."""
    return df.select(*[as_key(F.col(f"`{c}`")).alias(n) for c, n in zip(columns, names, strict=True)])


def k_anonymity(df: DataFrame, quasi: list[str], k: int = 5) -> DataFrame:
    """rows, min_class, unique_rows, unique_rate, rows_below_k, below_k_rate, classes; an empty table gives zeros."""
    if k < 2 or not quasi:
        raise ValueError("k is 2 or more, with at least one column")
    keys = [f"k{i}" for i in range(len(quasi))]
    classes = renamed_keys(df, quasi, keys).groupBy(*keys).agg(F.count("*").alias("n"))
    out = classes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_class"),
        F.count_if(F.col("n") == 1).alias("unique_rows"),
        F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).alias("rows_below_k"),
        F.count("*").alias("classes"),
    )
    return out.select(
        "rows",
        "min_class",
        "unique_rows",
        rate(F.col("unique_rows"), F.col("rows")).alias("unique_rate"),
        "rows_below_k",
        rate(F.col("rows_below_k"), F.col("rows")).alias("below_k_rate"),
        "classes",
    )


def unique_linkage(target: DataFrame, auxiliary: DataFrame, quasi: list[str]) -> DataFrame:
    """target_rows, unique_matches, linkage_rate: target rows whose key the auxiliary table has exactly once."""
    keys = [f"k{i}" for i in range(len(quasi))]
    alone = renamed_keys(auxiliary, quasi, keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n = 1")
    out = renamed_keys(target, quasi, keys).join(alone, keys, "left").agg(F.count("*").alias("target_rows"), F.count("n").alias("unique_matches"))
    return out.withColumn("linkage_rate", rate(F.col("unique_matches"), F.col("target_rows")))


def attribute_inference(synthetic: DataFrame, target: DataFrame, quasi: list[str], sensitive: str) -> DataFrame:
    """Coverage, accuracy, baseline accuracy and uplift of the modal sensitive value by quasi key.

    Ties go to the value that sorts first. Accuracy is null if nothing is covered.
    """
    keys = [f"k{i}" for i in range(len(quasi))]
    side = lambda df: renamed_keys(df, [*quasi, sensitive], [*keys, "v"])
    most = lambda name: F.min(F.struct((-F.col("n")).alias("o"), F.col("v").alias("v")))["v"].alias(name)
    counts = side(synthetic).groupBy(*keys, "v").agg(F.count("*").alias("n"))
    guess = counts.groupBy(*keys).agg(most("guess"))
    usual = counts.groupBy("v").agg(F.sum("n").alias("n")).agg(most("usual"))
    rows = side(target).join(guess, keys, "left").crossJoin(F.broadcast(usual))
    right, base = F.col("v") == F.col("guess"), F.col("v") == F.col("usual")
    out = rows.agg(
        F.count("*").alias("target_rows"),
        F.count("guess").alias("covered"),
        F.count_if(right).alias("right"),
        F.count_if(base).alias("base"),
    )
    out = out.select(
        "target_rows",
        "covered",
        rate(F.col("covered"), F.col("target_rows")).alias("coverage"),
        F.round(F.try_divide(F.col("right"), F.col("covered")), 6).alias("accuracy"),
        rate(F.col("base"), F.col("target_rows")).alias("baseline_accuracy"),
    )
    out = out.withColumn("uplift", F.round(F.col("accuracy") - F.col("baseline_accuracy"), 6))
    return out.withColumn("material", F.coalesce((F.col("uplift") >= 0.2) & (F.col("coverage") >= 0.2), F.lit(False)))


def linkage_result(matches: DataFrame, rows: DataFrame) -> DataFrame:
    """earlier_rows, unique_matches, correct_matches, linkage_rate, precision, elevated from single matches (rows that stand behind each, correct) and all rows."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    found = matches.agg(total("rows").alias("unique_matches"), total(F.when(F.col("correct"), F.col("rows"))).alias("correct_matches"))
    out = found.crossJoin(rows.agg(F.count("*").alias("earlier_rows"))).select(
        "earlier_rows",
        "unique_matches",
        "correct_matches",
        rate(F.col("unique_matches"), F.col("earlier_rows")).alias("linkage_rate"),
        F.round(F.try_divide(F.col("correct_matches"), F.col("unique_matches")), 6).alias("precision"),
    )
    return out.withColumn("elevated", F.coalesce((F.col("precision") >= 0.8) & (F.col("linkage_rate") >= 0.2), F.lit(False)))


def longitudinal_linkage(earlier: DataFrame, later: DataFrame, quasi: list[str], entity: str) -> DataFrame:
    """How many earlier rows match exactly one later row on the quasi key, and how many of these are the same entity."""
    keys = [f"k{i}" for i in range(len(quasi))]
    side = lambda df: df.select(*[as_key(F.col(f"`{c}`")).alias(k) for c, k in zip(quasi, keys, strict=True)], as_key(F.col(f"`{entity}`")).alias("entity"))
    alone = side(later).groupBy(*keys).agg(F.count("*").alias("n"), F.min("entity").alias("found")).where("n = 1").drop("n")
    return linkage_result(
        side(earlier).join(alone, keys).select((F.col("entity") == F.col("found")).alias("correct"), F.lit(1).alias("rows")),
        earlier,
    )


def matches_of(a: pa.Table, b: pa.Table, tolerances: list[float]) -> pa.Table:
    """row, n (rows behind the matches in this block, counted to two), entity (of a single match) of the rows of one block."""
    rows, entities = a.column("row"), b.column("entity").to_pylist()
    x, y, weight = matrix(a.column("v")), matrix(b.column("v")), b.column("rows").to_numpy()
    n, one = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x) if len(y) else 0, STRIP):
        close = np.ones((len(x[at : at + STRIP]), len(y)), bool)
        for i, t in enumerate(tolerances):
            close &= np.abs(x[at : at + STRIP, i, None] - y[None, :, i]) <= t
        n[at : at + STRIP], one[at : at + STRIP] = close @ weight, close.argmax(axis=1)
    single = [entities[i] if k == 1 else None for i, k in zip(one, n, strict=True)]
    return pa.table({"row": rows, "n": np.minimum(n, 2), "entity": pa.array(single, pa.string())})


def crowded_matches(left: DataFrame, right: DataFrame, on: list[str], tolerances: list[float]) -> DataFrame:
    """entity, found, rows of left rows with exactly one match in bins that are searched in blocks.

    Equal rows of either side count as one with a number. The first block of a bin comes
    first: rows with two matches need no more, so crowded bins make no pairs.
    """
    once = lambda df: df.groupBy(*df.columns).agg(F.count("*").alias("rows"))
    # a row's number must not change when a task is run again
    left = durable(once(left).withColumn("row", F.monotonically_increasing_id()))
    right, asked = once(right), left.select(*on, "row", "v")
    test = lambda a, b: matches_of(a, b, tolerances)
    fields = "row bigint, n bigint, entity string"
    first = durable_once(blocks.meet(asked, right, on, test, fields, part="first"))
    few = first.groupBy("row").agg(F.sum("n").alias("n")).where("n < 2").select("row")
    rest = blocks.meet(asked.join(few, "row", "left_semi"), right, on, test, fields, part="rest")
    found = first.unionByName(rest).groupBy("row").agg(F.sum("n").alias("n"), F.min("entity").alias("found")).where("n = 1")
    return found.join(left.select("row", "entity", "rows"), "row").select("entity", "found", "rows")


def fuzzy_longitudinal_linkage(earlier: DataFrame, later: DataFrame, categorical: list[str], tolerances: dict[str, float], entity: str) -> DataFrame:
    """As above with equality on categories and inclusive tolerances on numbers; nulls in numbers never match.

    A band join: the first positive tolerance sets bins, a later row stands in its own bin
    and those beside it, and an earlier row asks its own bin only; tolerance 0 is equality.
    Small bins are lists, crowded ones are searched in blocks.
    """
    if not tolerances or any(t < 0 for t in tolerances.values()):
        raise ValueError("tolerances are 0 or more, for at least one column")
    binned = next((c for c, t in tolerances.items() if t > 0), None)
    number = lambda c: F.col(f"`{c}`").cast("double")

    def side(df: DataFrame) -> DataFrame:
        keys = [as_key(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(categorical)]
        exact = [(number(c) + 0.0).alias(f"x{i}") for i, (c, t) in enumerate(tolerances.items()) if t == 0]
        sound = reduce(lambda a, b: a & b, [number(c).isNotNull() & ~F.isnan(number(c)) for c in tolerances])
        middle = F.floor(number(binned) / tolerances[binned]) if binned is not None else F.lit(0).cast("bigint")
        return df.where(sound).select(
            *keys,
            *exact,
            F.array(*map(number, tolerances)).alias("v"),
            as_key(F.col(f"`{entity}`")).alias("entity"),
            middle.alias("bin"),
        )

    left, right = side(earlier), side(later)
    if binned is not None:
        right = right.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    on, limits = [*[c for c in left.columns if c[0] in "kx"], "bin"], list(tolerances.values())
    many = blocks.crowded(right, on)
    apart = lambda y: reduce(lambda a, b: a & b, [F.abs(F.col("v")[i] - y["v"][i]) <= t for i, t in enumerate(limits)])
    asked = blocks.with_lists(left, right, on, many).select("entity", F.filter("near", apart).alias("hits"))
    single = asked.where(F.size("hits") == 1).select("entity", F.col("hits")[0]["entity"].alias("found"), F.lit(1).cast("bigint").alias("rows"))
    if many is not None:
        single = single.unionByName(crowded_matches(left.join(many, on, "left_semi"), right.join(many, on, "left_semi"), on, limits))
    return linkage_result(single.select((F.col("entity") == F.col("found")).alias("correct"), "rows"), earlier)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    one = column.combine_chunks()
    return one.flatten().to_numpy(zero_copy_only=False).reshape(len(one), -1) if len(one) else np.zeros((0, 1))


def nearest_in(a: pa.Table, b: pa.Table) -> pa.Table:
    """tag, v, p, r, d: for every asked vector the distance to its nearest in the other block, or what is known already.

    p, a component of v, orders the other block. A vector is compared with its neighbours in that order, some more at a time,
    until the next of either side is farther along p alone than the nearest so far; the few that this does not end
    are compared in strips with all that is within their reach.
    """
    x, px, d = matrix(a.column("v")), a.column("p").to_numpy(), a.column("u").to_numpy().copy()
    order = np.argsort(b.column("p").to_numpy(), kind="stable")
    y, py = matrix(b.column("v"))[order], b.column("p").to_numpy()[order]

    def apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        out = np.zeros(np.broadcast_shapes(one.shape, other.shape)[:2])
        for i in range(x.shape[1]):
            out += (one[..., i] - other[..., i]) ** 2
        return np.sqrt(out.min(axis=1))

    left = np.searchsorted(py, px)
    right, open_ = left.copy(), np.arange(len(x) if len(y) else 0)
    for k in NEXT:
        step = np.arange(k)
        for at in range(0, len(open_), HELD // (2 * k)):
            i = open_[at : at + HELD // (2 * k)]
            beside = np.concatenate([left[i, None] - 1 - step, right[i, None] + step], axis=1).clip(0, len(y) - 1)
            d[i] = np.minimum(d[i], apart(x[i, None], y[beside]))
        left[open_], right[open_] = np.maximum(left[open_] - k, 0), np.minimum(right[open_] + k, len(y))
        i, j = left[open_], right[open_]
        below, above = px[open_] - py[i - 1], py[np.minimum(j, len(y) - 1)] - px[open_]
        open_ = open_[((i > 0) & (below <= d[open_])) | ((j < len(y)) & (above <= d[open_]))]
    open_ = open_[np.argsort(px[open_], kind="stable")]
    for at in range(0, len(open_), STRIP):
        i = open_[at : at + STRIP]
        low, high = np.searchsorted(py, (px[i] - d[i]).min()), np.searchsorted(py, (px[i] + d[i]).max(), "right")
        for start in range(low, high, HELD // STRIP):
            d[i] = np.minimum(d[i], apart(x[i, None], y[None, start : min(start + HELD // STRIP, high)]))
    return pa.table({"tag": a.column("tag"), "v": a.column("v"), "p": a.column("p"), "r": a.column("r"), "d": d})


NEAREST = "tag int, v array<double>, p double, r int, d double"


def nearest_vectors(asked: DataFrame, reference: DataFrame) -> DataFrame:
    """tag, v, d for the distinct `asked` (tag, p, v): the Euclidean distance to the nearest `reference` (tag, p, v) of the tag. Exact.

    p, a component of v, orders the vectors of a tag in ranges, none of them empty. A vector first searches its own range;
    what it finds bounds which ranges can hold something nearer, and only those are searched. Both sides are dealt over blocks.
    Vectors with a gap have no distance.
    """
    sound = lambda df: df.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c))).distinct()
    asked, ref, size = durable(sound(asked)), durable(sound(reference)), 4 * blocks.BLOCK
    # one row a tag
    counts = {t["tag"]: t for t in ref.groupBy("tag").agg(F.count("*").alias("n"), F.min("p").alias("least")).collect()}
    if not counts:
        return asked.where("false").select("tag", "v", F.lit(0.0).alias("d"))
    per = {t: min(RANGES, 1 + 2 * c["n"] // size) for t, c in counts.items()}
    finest = max(per.values())
    limits: list[list[float]] = [[] for _ in range(max(counts) + 1)]
    if finest > 1:
        cuts = F.percentile_approx("p", F.array(*[F.lit(i / finest) for i in range(1, finest)]), F.lit(10_000)).alias("cuts")
        # at most RANGES numbers a tag; a cut is a value of the tag, so every range holds one
        for t in ref.groupBy("tag").agg(cuts).collect():
            n = per[t["tag"]]
            limits[t["tag"]] = sorted({t["cuts"][finest * i // n - 1] for i in range(1, n)} - {counts[t["tag"]]["least"]})
    place = lambda c: place_of(c, limits, F.col("tag"))
    held = ref.withColumn("r", place(F.col("p")))
    first = asked.where(F.col("tag").isin(list(counts))).withColumn("r", place(F.col("p"))).withColumn("u", F.lit(float("inf")))
    told = durable_once(blocks.meet(first, held, ["tag", "r"], nearest_in, NEAREST, size))
    best = durable(told.groupBy("tag", "v", "p", "r").agg(F.min("d").alias("u")))
    # a little more than the bound, whose last bits are rounded
    far = F.col("u") * (1 + 1e-9)
    reach = F.filter(F.sequence(place(F.col("p") - far), place(F.col("p") + far)), lambda r: r != F.col("r"))
    more = best.select("tag", "v", "p", F.explode(reach).alias("r"), "u")
    found = blocks.meet(more, held, ["tag", "r"], nearest_in, NEAREST, size)
    return best.select("tag", "v", F.col("u").alias("d")).unionByName(found.select("tag", "v", "d")).groupBy("tag", "v").agg(F.min("d").alias("d"))


def leading(df: DataFrame, column: str, size: int) -> list[int]:
    """The components of a vector column, those with the most values first: they cut the finest ranges."""
    kinds = df.agg(*[F.approx_count_distinct(F.col(column)[k]).alias(f"k{k}") for k in range(size)]).first()
    return sorted(range(size), key=lambda k: -kinds[f"k{k}"])


def vector_of(columns: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") + 0.0 for c in columns])


def nearest_distance(candidates: DataFrame, reference: DataFrame, columns: list[str], id_col: str, approximate: bool = False) -> DataFrame:
    """id, distance: Euclidean, from each candidate to its nearest reference row; null if there is none.

    Exact, unless `approximate`: then by `hashed_nearest`, which never gives less than the exact distance.
    """
    rows = candidates.select(F.col(f"`{id_col}`").alias("id"), F.lit(0).alias("tag"), vector_of(columns).alias("v"))
    held = reference.select(F.lit(0).alias("tag"), vector_of(columns).alias("v"))
    if approximate:
        found = hashed_nearest(rows.select("v"), held.select("v"), len(columns))
        return rows.join(found, "v", "left").select(F.col("id").alias(id_col), F.col("d").alias("distance"))
    p = leading(held, "v", len(columns))[0]
    with_p = lambda df: df.select("tag", F.col("v")[p].alias("p"), "v")
    found = nearest_vectors(with_p(rows), with_p(held))
    return rows.join(found, ["tag", "v"], "left").select(F.col("id").alias(id_col), F.col("d").alias("distance"))


#: Tables of an index, projections to a table, rows by which it is scaled, and how many times their nearest distance a bucket is wide.
TABLES, PROJECTIONS, SCALE_BY, WIDE = 8, 2, 256, 4.0


def buckets(size: int, width: float, seed: int = 11) -> Column:
    """Of a vector `v`: (table, bucket) for every table, by shifted random projections."""
    rng = np.random.default_rng(seed)
    out = []
    for t in range(TABLES):
        places = []
        for _ in range(PROJECTIONS):
            direction, shift = rng.standard_normal(size), rng.uniform()
            along = reduce(lambda a, b: a + b, [F.col("v")[i] * float(x) for i, x in enumerate(direction)])
            places.append(F.floor(along / width + float(shift)))
        out.append(F.struct(F.lit(t).alias("t"), *[p.alias(f"b{i}") for i, p in enumerate(places)]))
    return F.array(*out)


def hashed_nearest(asked: DataFrame, reference: DataFrame, size: int) -> DataFrame:
    """v, d for the distinct `asked` (v): the distance to the nearest `reference` (v) that shares a bucket of random projections.

    Buckets are WIDE times as wide as nearest distances usually are, measured on SCALE_BY vectors drawn by digests.
    Small buckets are lists, crowded ones are searched in blocks. Vectors alone in all their buckets are searched exactly, so every one has an answer.
    """
    usable = lambda df: df.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))).distinct()
    asked, reference = durable(usable(asked)), durable(usable(reference))
    p = leading(reference, "v", size)[0]
    with_p = lambda df: df.select(F.lit(0).alias("tag"), F.col("v")[p].alias("p"), "v")
    exactly = lambda df: nearest_vectors(with_p(df), with_p(reference)).select("v", "d")
    scale = exactly(asked.orderBy(F.xxhash64("v"), "v").limit(SCALE_BY)).agg(F.percentile("d", 0.9).alias("d")).first()["d"]
    if scale is None or scale == float("inf"):
        return exactly(asked)
    width = WIDE * (scale or 1e-9)
    on = ["t", *[f"b{i}" for i in range(PROJECTIONS)]]
    dealt = lambda df: df.select(F.explode(buckets(size, width)).alias("b"), "v").select("b.*", "v")
    left, right = dealt(asked), dealt(reference)
    many = blocks.crowded(right, on)
    apart = lambda y: F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col("v")[i] - y["v"][i], 2) for i in range(size)]))
    told = blocks.with_lists(left, right, on, many).where(F.size("near") > 0).select("v", F.array_min(F.transform("near", apart)).alias("d"))
    if many is not None:
        inside = lambda df: df.join(many, on, "left_semi")
        whole = inside(left).select(*on, F.lit(0).alias("tag"), "v", F.col("v")[p].alias("p"), F.lit(0).alias("r"), F.lit(float("inf")).alias("u"))
        there = inside(right).withColumn("p", F.col("v")[p])
        told = told.unionByName(blocks.meet(whole, there, on, nearest_in, NEAREST).select("v", "d"))
    best = durable(told.groupBy("v").agg(F.min("d").alias("d")))
    alone = durable(asked.join(best, "v", "left_anti"))
    return best.unionByName(exactly(alone)) if alone.limit(1).count() else best


def pairwise_auc(scores: DataFrame, score_col: str, member_col: str, *by: str) -> DataFrame:
    """auc (by the columns of `by`): P(member above holdout) + half P(tie), from counts by score and running sums over score ranges."""
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("bigint")
    each = scores.select(*by, F.col(score_col).alias("s"), one(F.col(member_col)).alias("m"), one(~F.col(member_col)).alias("h"))
    return auc_of_counts(each, *by)


def auc_of_counts(scores: DataFrame, *by: str) -> DataFrame:
    """As `pairwise_auc`, from scores s (which may repeat) with numbers of members m and of holdout rows h."""
    counts = scores.where("s is not null").groupBy(*by, F.col("s").cast("double").alias("s")).agg(F.sum("m").alias("m"), F.sum("h").alias("h"))
    counts = durable(counts)
    rows = counts.withColumn("r", place_of(F.col("s"), [bounds(counts, "s")], F.lit(0)))
    ahead = before(rows, "r", F.sum("h"), "ahead", *by)
    inside = Window.partitionBy(*by, "r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = rows.withColumn("in", F.coalesce(F.sum("h").over(inside), F.lit(0))).join(ahead, [*by, "r"])
    out = below.groupBy(*by).agg(
        F.sum(F.col("m").cast("double") * (F.col("ahead") + F.col("in") + F.col("h") / 2)).alias("wins"),
        F.sum("m").alias("m"),
        F.sum("h").alias("h"),
    )
    return out.select(*by, F.round(F.try_divide(F.col("wins"), F.col("m").cast("double") * F.col("h")), 6).alias("auc"))


def standardised(members: DataFrame, holdout: DataFrame, synthetic: DataFrame, columns: list[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (id, member, z) and synthetic rows (z): mean and population deviation of members and holdout, gaps filled by means."""
    number = lambda c: F.col(f"`{c}`").cast("double")
    both = members.select(id_col, *columns).withColumn("member", F.lit(True)).unionByName(
        holdout.select(id_col, *columns).withColumn("member", F.lit(False))
    )
    stats = both.agg(*[x for i, c in enumerate(columns) for x in (F.avg(number(c)).alias(f"m{i}"), F.stddev_pop(number(c)).alias(f"s{i}"))]).first()
    z = F.array(
        *[(F.coalesce(number(c), F.lit(stats[f"m{i}"])) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) + 0.0 for i, c in enumerate(columns)]
    ).alias("z")
    return both.select(F.col(id_col).alias("id"), "member", z), synthetic.select(z)


def ensemble_membership(
    members: DataFrame,
    holdout: DataFrame,
    synthetic: DataFrame,
    columns: list[str],
    id_col: str,
    largest: int = 2,
    most: int = 32,
) -> DataFrame:
    """attack_no, columns, auc, interpretation for every subset, all in one search; `ensemble_summary` gives the largest and the median.

    Each attack is a tag; the components that it leaves out are 0 on both sides.
    """
    names = list(dict.fromkeys(columns))
    subsets = attack_subsets(names, largest, most)
    rows, made = standardised(members, holdout, synthetic, names, id_col)
    # the component with the most values cuts the finest ranges: one of 25 values would leave 25, however many rows there are
    finest = leading(made, "z", len(names))
    views = []
    for i, subset in enumerate(subsets):
        used = [names.index(c) for c in subset]
        v = F.array(*[F.col("z")[k] if k in used else F.lit(0.0) for k in range(len(names))])
        views.append(F.struct(F.lit(i).alias("tag"), F.col("z")[min(used, key=finest.index)].alias("p"), v.alias("v")))
    tagged = lambda df, *keep: df.select(*keep, F.explode(F.array(*views)).alias("t")).select(*keep, "t.*")
    # equal vectors are searched once, with the numbers of members and of holdout rows behind them
    asked = durable(tagged(rows, "member").groupBy("tag", "p", "v").agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("h")))
    found = nearest_vectors(asked.select("tag", "p", "v"), tagged(made))
    # nine places, so that equal distances tie whatever the last bits of a sum
    scores = asked.join(found, ["tag", "v"]).select("tag", (-F.round("d", 9)).alias("s"), "m", "h")
    labels = rows.sparkSession.createDataFrame([(i, ",".join(s)) for i, s in enumerate(subsets)], "tag int, columns string")
    out = labels.join(auc_of_counts(scores, "tag"), "tag", "left")
    return out.select(F.col("tag").alias("attack_no"), "columns", "auc", band(F.col("auc")).alias("interpretation"))


def membership_auc(members: DataFrame, holdout: DataFrame, synthetic: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """auc, interpretation: whether members lie nearer to synthetic rows than holdout rows do."""
    return ensemble_membership(members, holdout, synthetic, columns, id_col, most=1).select("auc", "interpretation")


def attack_subsets(columns: list[str], largest: int = 2, most: int = 32) -> list[list[str]]:
    """All subsets up to a size and the full set, which the budget keeps last."""
    columns = list(dict.fromkeys(columns))
    found = [list(s) for n in range(1, min(largest, len(columns)) + 1) for s in combinations(columns, n) if len(s) < len(columns)]
    return [*found[: most - 1], columns]


def ensemble_summary(attacks: DataFrame) -> DataFrame:
    """attacks, max_auc, median_auc, best_columns (the first of the largest)."""
    out = attacks.agg(
        F.count("*").alias("attacks"),
        F.max("auc").alias("max_auc"),
        F.round(F.median("auc"), 6).alias("median_auc"),
        F.max_by("columns", F.struct("auc", (-F.col("attack_no")).alias("o"))).alias("best_columns"),
    )
    return out.withColumn("interpretation", band(F.col("max_auc")))
