"""Conversations repaired at the least cost: a Viterbi search whose survivors give out edits as soon as they agree.

A repaired conversation has roles whose initials read (s?(ua)+)?. Rows are kept, given
another role, or deleted; empty turns are inserted. The search has four states: nothing
yet, after a system turn, after a user turn, complete. What the survivors of the states do
not share yet is a tree of backpointers with counts of its holders: branches that no
survivor holds are freed, chains are merged, and what lies at the root, which all survivors
share, is given out at once. Survivors of equal cost are compared over all that is not
given out yet, so the result is the least in ASCII of all cheapest edits. A survivor that
another one undercuts by more than any continuation can make up for is dropped, so that the
tree stays short; a task's memory is the edits not given out yet, not the conversation.

Rows meet by conversation, sorted by Spark, and stream through the search; a conversation's
digests are chains, so its rows pass through one task, one batch at a time. Repeated turns
are found before that, by partial aggregates over digests of their texts.

Defined results: a null role or text is one space; null turns come first; rows of one turn
go by role, then text (UTF-8 order). A null conv_id is a conversation of its own. Roles are judged by their first
character; a role of no characters has none and cannot be kept. An empty text is blank. Rows
repeated in the input are duplicates. An empty table gives no rows. Columns beyond
conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import by_size

SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing given out yet, after a system turn, after a user turn, complete.
EMPTY, SYSTEM, USER, WHOLE = "esuw"
#: By how much a state's cost may exceed another's before no continuation makes up for it: (state, other) to the gap.
GAPS = {
    (EMPTY, WHOLE): DELETE,
    (EMPTY, USER): INSERT + DELETE,
    (EMPTY, SYSTEM): 2 * INSERT,
    (SYSTEM, WHOLE): 0,
    (SYSTEM, EMPTY): 0,
    (SYSTEM, USER): INSERT,
    (WHOLE, EMPTY): 0,
}
#: Output rows to a batch.
BATCH = 4096

Line = tuple[str, str, str]


def damage(df: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by crc32(conv_id:turn) % 20.

    0 drops the row (kept here with `dropped` set, so that its conversation is known), 1 empties the
    text, 2 removes its sentence marks, 3 repeats the row, 4 sets the role user.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), code.alias("code"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def order_of(turn: Column) -> Column:
    """Turns as they are sorted: null first."""
    return F.struct(turn.isNotNull().alias("given"), turn.alias("turn"))


def with_faults(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped, blank, truncated, repeated: the last for rows whose role and text an earlier turn has.

    Repeats within one turn are neighbours once sorted and are found there.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    said = F.concat_ws(
        "\x00",
        F.col("conv_id").isNotNull().cast("string"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")),
        F.length("role").cast("string"),
        "role",
        "text",
    )
    rows = df.select(
        "conv_id",
        "turn",
        "role",
        F.when(~F.col("dropped"), F.col("text")).alias("text"),
        "dropped",
        (body == "").alias("blank"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.sha2(said, 256).alias("mark"),
    )
    first = rows.where("not dropped and not blank").groupBy("mark").agg(
        F.min(order_of(F.col("turn"))).alias("first"),
        F.max(order_of(F.col("turn"))).alias("last"),
    )
    repeats = first.where("first < last").select("mark", "first")
    found = rows.join(by_size(repeats), "mark", "left")
    return found.withColumn("repeated", F.coalesce(F.col("first") < order_of(F.col("turn")), F.lit(False))).drop("mark", "first")


class Node:
    """A stretch of edits between two forks of the survivors' paths; `held` counts the survivors and stretches that follow."""

    __slots__ = ("edits", "held", "lines", "up")

    def __init__(self, up: Node | None) -> None:
        self.up, self.held, self.edits, self.lines = up, 1, bytearray(), []

    def add(self, edit: str, line: Line | None) -> None:
        self.edits += edit.encode()
        if line is not None:
            self.lines.append(line)


class Survivors:
    """The cheapest edits that lead to each state; `give` gets initials and lines of edits that all survivors share."""

    def __init__(self, give: Callable[[bytes, list[Line]], None]) -> None:
        self.give, self.root = give, Node(None)
        self.paths: dict[str, tuple[int, Node]] = {EMPTY: (0, self.root)}
        self.insert()

    def unresolved(self, state: str) -> bytes:
        """All initials on the way to a state that are not given out yet."""
        node, parts = self.paths[state][1], []
        while node is not None:
            parts.append(node.edits)
            node = node.up
        return b"".join(reversed(parts))

    def better(self, one: tuple | None, two: tuple) -> tuple:
        """Of two ways (cost, state before, edit, line): the cheaper, else the one whose whole unresolved initials are less."""
        if one is None or two[0] != one[0]:
            return two if one is None or two[0] < one[0] else one
        return min(one, two, key=lambda way: self.unresolved(way[1]) + way[2].encode())

    def advance(self, ways: dict[str, tuple[int, str, str, Line | None]]) -> None:
        """Every state takes its way; branches that none takes are freed."""
        drawn = Counter(way[1] for way in ways.values())
        old, self.paths = self.paths, {}
        for state, (cost, before, edit, line) in ways.items():
            node = old[before][1]
            if drawn[before] > 1:
                node = Node(node)
            node.add(edit, line)
            self.paths[state] = (cost, node)
        for before, (_, node) in old.items():
            node.held = drawn[before]
            while node is not None and not node.held:
                node = node.up
                if node is not None:
                    node.held -= 1
        self.settle()

    def settle(self) -> None:
        """Merge stretches that only one path holds, and give out what all share."""
        tops = set()
        for _, leaf in self.paths.values():
            node = leaf
            while node is not self.root:
                up = node.up
                if up.held == 1 and up is not self.root:
                    up.edits += node.edits
                    up.lines += node.lines
                    node.edits, node.lines, node.up = up.edits, up.lines, up.up
                    continue
                if up is self.root:
                    tops.add(node)
                node = up
        if len(tops) == 1 and self.root.held == 1:
            self.flush()
            self.root = tops.pop()
            self.root.up = None
        self.flush()

    def flush(self) -> None:
        if self.root.edits:
            self.give(bytes(self.root.edits), self.root.lines)
            self.root.edits, self.root.lines = bytearray(), []

    def insert(self) -> None:
        """Empty turns before the next row; survivors that cannot win are dropped."""
        for role, befores, to in (("user", (EMPTY, SYSTEM, WHOLE), USER), ("assistant", (USER,), WHOLE)):
            ways = {s: (cost, s, "", None) for s, (cost, _) in self.paths.items()}
            for s in befores:
                if s in self.paths:
                    ways[to] = self.better(ways.get(to), (self.paths[s][0] + INSERT, s, "I", ("I", role, "")))
            self.advance(ways)
        cost = {s: c for s, (c, _) in self.paths.items()}
        lost = {s for (s, other), gap in GAPS.items() if s in cost and other in cost and cost[other] + gap < cost[s]}
        if lost:
            self.advance({s: (c, s, "", None) for s, c in cost.items() if s not in lost})

    def row(self, role: str, text: str, faulty: bool, truncated: bool) -> None:
        """Take a row: faulty ones can only be deleted."""
        ways: dict[str, tuple] = {s: (cost + DELETE, s, "D", None) for s, (cost, _) in self.paths.items()}
        more, initial = TRUNCATED if truncated else 0, role[:1]
        if not faulty:
            for s, (cost, _) in self.paths.items():
                if s == EMPTY and initial == "s":
                    ways[SYSTEM] = self.better(ways.get(SYSTEM), (cost + more, s, "K", ("K", role, text)))
                to, wanted = (WHOLE, "assistant") if s == USER else (USER, "user")
                same = initial == wanted[0]
                way = (cost + more, s, "K", ("K", role, text)) if same else (cost + more + REROLE, s, "R", ("R", wanted, text))
                ways[to] = self.better(ways.get(to), way)
        self.advance(ways)
        self.insert()

    def end(self) -> int:
        """The cost; the rest of the edits is given out."""
        best = None
        for s in (EMPTY, WHOLE):
            if s in self.paths:
                best = self.better(best, (self.paths[s][0], s, "", None))
        self.advance({best[1]: best})
        return best[0]


class Audit:
    """What a conversation's summary holds; fed row by row."""

    def __init__(self, conv, give: Callable[[bytes, list[Line]], None]) -> None:
        self.conv, self.before, self.rows, self.turns = conv, None, 0, 0
        self.low = self.high = None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.survivors = Survivors(give)

    def take(self, turn, role: str, text: str, blank: bool, truncated: bool, repeated: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        same = self.before == (turn, role, text)
        if self.before is not None:
            self.counts["illegal"] += self.before[1][:1] + role[:1] not in ("su", "ua", "au")
        self.before = (turn, role, text)
        fault = "blank" if blank else "duplicate" if repeated or same else "truncated" if truncated else ""
        if fault:
            self.counts[fault] += 1
        self.rows += 1
        self.survivors.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def gaps(self) -> int:
        return 0 if self.low is None else int(self.high - self.low + 1 - self.turns)


def conversations(batches: Iterator[pa.RecordBatch], begin: Callable[[object], tuple[Callable, Callable]]) -> Iterator:
    """Stream sorted rows; `begin` gives, for each conversation, what takes given-out edits and what makes something of its end."""
    audit, finish = None, None
    for b in batches:
        for conv, turn, role, text, dropped, blank, truncated, repeated in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            if audit is None or conv != audit.conv:
                if audit is not None:
                    yield finish(audit, audit.survivors.end())
                give, finish = begin(conv)
                audit = Audit(conv, give)
            if not dropped:
                audit.take(turn, role, text, blank, truncated, repeated)
        yield None
    if audit is not None:
        yield finish(audit, audit.survivors.end())


def streamed(df: DataFrame, begin: Callable, fields: str) -> DataFrame:
    """Every conversation's rows together and in order, through the search; finished rows come out in batches."""
    kinds = T.StructType([df.schema["conv_id"], *T.StructType.fromDDL(fields)])
    arrow = to_arrow_schema(kinds)
    columns = ["conv_id", "turn", "role", "text", "dropped", "blank", "truncated", "repeated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=k.type) for c, k in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        for _ in conversations(batches, lambda conv: begin(conv, out)):
            if len(out) >= BATCH:
                yield batch()
                out.clear()
        if out:
            yield batch()

    rows = with_faults(df).select(*columns)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(run, kinds)


def edits(df: DataFrame) -> DataFrame:
    """conv_id, edit_no, edit (Keep, Rerole or Insert by initial), role, text: the repaired conversations, turn by turn.

    Takes conv_id, turn, role, text (no nulls in role and text) and dropped. Rows come out while a conversation is still read.
    """

    def begin(conv, out: list[tuple]) -> tuple[Callable, Callable]:
        at = 0

        def give(initials: bytes, lines: list[Line]) -> None:
            nonlocal at
            for edit, role, text in lines:
                out.append((conv, at, edit, role, text))
                at += 1

        return give, lambda audit, cost: None

    return streamed(df, begin, "edit_no bigint, edit string, role string, text string")


def repair_digest(df: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Takes conv_id, turn, role, text and dropped. The digest takes lines as they are given out.
    """

    def begin(conv, out: list[tuple]) -> tuple[Callable, Callable]:
        audit_text, digest, any_line = bytearray(), hashlib.sha256(), False

        def give(initials: bytes, lines: list[Line]) -> None:
            nonlocal any_line
            audit_text.extend(initials)
            for _, role, text in lines:
                digest.update(f"{chr(10) if any_line else ''}{role}:{text}".encode())
                any_line = True

        def finish(audit: Audit, cost: int) -> None:
            out.append((conv, audit.gaps(), *audit.counts.values(), cost, audit_text.decode(), digest.hexdigest()))

        return give, finish

    return streamed(
        df,
        begin,
        "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    )
