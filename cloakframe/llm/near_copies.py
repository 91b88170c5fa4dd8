"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come first from SimHash fingerprints that the pigeonring links (simhash_ring,
within DISTANCE bits) and from texts of one fingerprint. These are not all: pairs at 0.8
to 0.95 differ in up to 14 of 64 bits, which leaves a ring segments of four bits. So texts
that share a band of minima (MinHash, 32 bands of 5) are candidates too: a pair at 0.8
shares none with a probability of (1 - 0.8^5)^32, 3 in a million, and less above. Every
candidate pair is then decided on its exact sets of shingles (64-bit hashes).

The members of a band are held against one of them only, its hub: the one that shares
most bands with others, as a text does from which others were made. A hub and all members
of its bands form a cell. Members that are in their hub's component need no more; those
outside it meet all others of the cell in blocks of bounded size, where overlaps are counted
shingle by shingle. Rows grow with the members, nothing is dropped, and every pair that shares
a band is decided: a crowd that is alike, but not enough, costs counting in blocks, not rows.

Defined results: words are as in simhash_ring (lower-case ASCII, split at blanks); a text
of fewer than five words is one shingle, null is empty, and texts without words are copies of each other.
"""

from __future__ import annotations

import hashlib
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, durable, map_texts, text_or_empty
from .components import components
from .embedding_join import Union
from .simhash_ring import SEED, fingerprint, in_components, keep_smallest, ring_links, row_key

WIDTH = 5
#: The least similarity, in hundredths.
LEAST = 80
BANDS, ROWS = 32, 5
#: Bits within which fingerprints make candidates, as in simhash_ring.
DISTANCE = 2
#: Texts, and shingles of texts, to one side of a block; meetings of equal shingles that are counted at one time.
BLOCK, BLOCK_SHINGLES, MEETINGS = 512, 250_000, 250_000
#: Keys of candidates are broadcast (as 64-bit hashes) up to this many, else texts are shuffled to them.
BROADCAST = 200_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def shingles(words: list[bytes]):
    """The sorted distinct hashes of all shingles, at least one."""
    import numpy as np
    import xxhash

    parts = [b" ".join(words)] if len(words) < WIDTH else map(b" ".join, zip(*(words[i:] for i in range(WIDTH)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(p, SEED) for p in parts], dtype="<u8"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def make_bands():
    """A function from shingles to one 64-bit key for each band."""
    import numpy as np
    import xxhash

    rng = np.random.default_rng(SEED)
    turn = rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
    times = rng.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def bands(found) -> list[int]:
        low = (found >> np.uint64(32)).astype(np.uint32)
        least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
        for at in range(0, len(low), 1024):
            np.minimum(least, ((low[at : at + 1024] ^ turn) * times).min(axis=1), out=least)
        each = least.astype("<u4").reshape(BANDS, ROWS)
        return [signed(xxhash.xxh64_intdigest(each[b].tobytes(), b)) for b in range(BANDS)]

    return bands


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, fp (digest of the words), sha (of the text), print (SimHash) and bands of every row; a map over the scan."""

    def make():
        import xxhash

        bands = make_bands()

        def row(text: str) -> tuple:
            words = words_of(text)
            found = shingles(words)
            sha = hashlib.sha256(text.encode("utf-8")).hexdigest()
            return signed(xxhash.xxh64_intdigest(b" ".join(words), SEED)), sha, fingerprint(text), bands(found)

        return row

    return map_texts(df, id_col, text_col, make, "fp bigint, sha string, print bigint, bands array<bigint>").withColumnRenamed(id_col, "id")


def shingle_sets(df: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """fp and its set of shingles for the rows whose row_key is among `keys` (key, as hash)."""
    key = F.xxhash64(row_key(F.col(id_col), F.sha2(text_or_empty(text_col), 256)))
    rows = df.select(F.col(id_col), F.col(text_col), key.alias("key")).join(by_size(keys, bound=BROADCAST), "key", "left_semi").drop("key")

    def make():
        import xxhash

        def row(text: str) -> tuple:
            words = words_of(text)
            return signed(xxhash.xxh64_intdigest(b" ".join(words), SEED)), shingles(words).tobytes()

        return row

    sets = map_texts(rows, id_col, text_col, make, "fp bigint, shingles binary")
    return sets.groupBy("fp").agg(F.first("shingles").alias("shingles"))


def star_block(group: pa.Table) -> pa.Table:
    """a, b, whether they share a band and whether they are near: the hub of a cell (side 0) against a block of its members (side 1)."""
    import numpy as np

    side, fps = group.column("side").to_numpy(), group.column("fp").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in group.column("shingles")]
    hub, near = sets[int(np.flatnonzero(side == 0)[0])], []
    others = np.flatnonzero(side == 1)
    for i in others:
        both = len(np.intersect1d(hub, sets[i], assume_unique=True))
        near.append(both * 100 >= LEAST * (len(hub) + len(sets[i]) - both))
    return pa.table({"a": group.column("a").to_numpy()[others], "b": fps[others], "banded": group.column("banded").take(others), "near": pa.array(near, pa.bool_())})


def blocks_of(which) -> Column:
    """How many blocks the texts of a group take for which `which` is not null, by their number and their shingles."""
    return (
        1 + F.greatest(
            F.floor(F.count(which) / BLOCK),
            F.coalesce(F.floor(F.sum(F.when(which.isNotNull(), F.col("size"))) / BLOCK_SHINGLES), F.lit(0)),
        )
    ).cast("int")


def dealt(count: str) -> Column:
    return F.pmod(F.xxhash64("fp"), F.col(count)).cast("int")


def spread(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def overlaps(left: list, right: list):
    """How many shingles each set on the left shares with each on the right, counted shingle by shingle."""
    import numpy as np

    rows, cols = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    x, y = np.concatenate(left), np.concatenate(right)
    order = np.argsort(y, kind="stable")
    y, cols = y[order], cols[order]
    first, after = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
    met = after > first
    rows, first, times = rows[met], first[met], (after - first)[met]
    out = np.zeros(len(left) * len(right), np.int32)
    ends = np.cumsum(times)
    at = 0
    while at < len(times):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEETINGS, "right")))
        n = times[at:to]
        place = np.repeat(first[at:to] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out += np.bincount(np.repeat(rows[at:to], n) * len(right) + cols[place], minlength=len(out)).astype(np.int32)
        at = to
    return out.reshape(len(left), len(right))


def block_links(group: pa.Table) -> pa.Table:
    """a, b: one link for each text of a block that is near another of a different component; one place of few bytes a pair."""
    import numpy as np

    side, fps, parts = (group.column(c).to_numpy() for c in ("side", "fp", "component"))
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in group.column("shingles")]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    nodes, place = np.unique(fps, return_inverse=True)
    tops = Union(len(nodes))
    if len(one) and len(two):
        both = overlaps([sets[i] for i in one], [sets[i] for i in two])
        sizes = np.array([len(x) for x in sets])
        near = both * 100 >= LEAST * (sizes[one][:, None] + sizes[two][None] - both)
        a, b = np.nonzero(near & (parts[one][:, None] != parts[two][None]))
        tops.link(place[one[a]], place[two[b]])
    linked = np.flatnonzero(tops.top != np.arange(len(nodes)))
    return pa.table({"a": nodes[tops.top[linked]], "b": nodes[linked]})


def ring_cells(prints: DataFrame) -> DataFrame:
    """Candidates (a, b), fps of texts whose SimHash fingerprints are equal or linked by the ring; `prints` has fp and print."""
    heads = durable(prints.groupBy("print").agg(F.min("fp").alias("head")))
    equal = prints.join(heads, "print").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    links = ring_links(heads.select(F.col("print").alias("fp")), DISTANCE)
    of = lambda c: heads.select(F.col("print").alias(c), F.col("head").alias(f"{c}_head"))
    near = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    return equal.where("a <> b").union(near)


def copy_links(df: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between fps that give the components of all near copies; `prints` has fp, key, print and bands."""
    keyed = prints.select("fp", F.explode("bands").alias("band"))
    crowds = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = durable(keyed.join(crowds, "band"))
    # a text from which others were made shares bands with most of them
    support = members.groupBy("fp").agg(F.sum("n").alias("support"))
    hubs = members.join(support, "fp").groupBy("band").agg(F.max(F.struct("support", "fp"))["fp"].alias("a"))
    banded = members.join(hubs, "band").where("a <> fp").select("a", F.col("fp").alias("b"), F.lit(True).alias("banded"))
    cells = banded.union(ring_cells(prints).withColumn("banded", F.lit(False)))
    cells = durable(cells.groupBy("a", "b").agg(F.max("banded").alias("banded")))
    taken = cells.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    keys = durable(prints.join(taken, "fp", "left_semi").select(F.xxhash64("key").alias("key")))
    sets = durable(shingle_sets(df, keys, id_col, text_col))
    sized = cells.join(sets.select(F.col("fp").alias("b"), F.expr("octet_length(shingles) div 8").alias("size")), "b")
    plan = durable(sized.groupBy("a").agg(blocks_of(F.col("b")).alias("mb")))
    hub = plan.select("a", spread("mb").alias("m"), F.lit(0).alias("side"), F.col("a").alias("fp"), F.lit(False).alias("banded"))
    rest = cells.join(plan, "a").withColumnRenamed("b", "fp").select("a", dealt("mb").alias("m"), F.lit(1).alias("side"), "fp", "banded")
    told = durable(hub.unionByName(rest).join(sets, "fp").groupBy("a", "m").applyInArrow(star_block, "a bigint, b bigint, banded boolean, near boolean"))
    links = told.where("near").select("a", "b")
    # what a component holds needs no more links: members of bands outside their hub's component meet all others of its cell
    found = durable(components(links))
    part = lambda c, name: found.select(F.col("id").alias(c), F.col("component").alias(name))
    placed = told.where("banded").select("a", F.col("b").alias("fp")).join(part("a", "ca"), "a", "left").join(part("fp", "cf"), "fp", "left")
    placed = placed.select("a", "fp", F.coalesce("cf", "fp").alias("component"), (F.coalesce("cf", "fp") != F.coalesce("ca", "a")).alias("outside"))
    placed = durable(placed.join(sets.select("fp", F.expr("octet_length(shingles) div 8").alias("size")), "fp"))
    outside = F.when(F.col("outside"), True)
    plan = placed.groupBy("a").agg(
        F.count(outside).alias("outsiders"),
        F.count("*").alias("n"),
        blocks_of(outside).alias("ob"),
        blocks_of(F.col("fp")).alias("mb"),
    )
    plan = durable(plan.where("outsiders > 0 and n > 1").select("a", "ob", "mb"))
    rows = placed.join(plan, "a").join(sets, "fp")
    columns = ["fp", "component", "shingles"]
    one = rows.where("outside").select("a", dealt("ob").alias("o"), spread("mb").alias("m"), F.lit(0).alias("side"), *columns)
    two = rows.select("a", spread("ob").alias("o"), dealt("mb").alias("m"), F.lit(1).alias("side"), *columns)
    more = one.unionByName(two).groupBy("a", "o", "m").applyInArrow(block_links, "a bigint, b bigint")
    # the components found so far are stars, which are linked as the links were
    return found.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")).union(durable(more))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with one row of each component of near copies: that of its smallest id (null last), then of its smallest digest."""
    rows = durable(text_rows(df, id_col, text_col))
    any_key = F.min(row_key(F.col("id"), F.col("sha")))
    prints = durable(rows.groupBy("fp").agg(F.min("id").alias("rep"), any_key.alias("key"), F.first("print").alias("print"), F.first("bands").alias("bands")))
    groups = in_components(rows.select("id", "sha", "fp"), prints, copy_links(df, prints, id_col, text_col))
    return keep_smallest(df, groups, id_col, text_col)
