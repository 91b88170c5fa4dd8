"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn is exploded into a training example of its own: all preceding turns
are its context and only that reply is trainable. Turns are formatted once, in blocks of
BLOCK. An example is the number of whole blocks before its reply's block, which it shares
with other examples, and a text: the turns of its own block up to and with the reply. So a
conversation of up to BLOCK turns has its examples whole, and a long one is stored in
proportion to its turns, not to their square; `render_examples` writes whole texts out.

Template: `<s>[ROLE]role[/ROLE]text</s>`, the text of a user turn between `[INST] `
and ` [/INST]`. Control strings inside roles and texts get one backslash after their
first character (one more if there are some already), which `unescape` takes away.

Turns are numbered without their texts: rows equal in all fields are one with a count,
numbers and lengths are summed inside groups of equal turns (split by digests), over the
groups of a span of turns, and over spans, so a conversation, a turn or a repeated row that
holds a third of all rows is spread. Blocks then hold BLOCK rows at most.

Defined results: turns are ordered by turn (null last), then role, then the SHA-256 of
the text; repeated rows each count as a turn; null role or text is empty; a null conv_id is
a conversation of its own; turns after the last reply belong to no example and are kept in
their blocks; very long texts are formatted whole; an empty table gives no rows; extra
columns are ignored. A conversation's digest needs its text in one place, as a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, durable, text_or_empty

# The control strings of the template, as patterns.
LEAD, TAIL = r"([<\[])", r"(/?(?:s>|INST\]|ROLE\]))"
TURN = r"(?s)<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>"
ASSISTANT, USER = "assistant", "user"
#: Turns to a block, and to a span of the numbering.
BLOCK, SPAN = 8, 64
#: Characters of examples that one task writes of one conversation.
PART_CHARS = 1 << 28


def escape(c: Column) -> Column:
    return F.regexp_replace(c, LEAD + r"(\\*)" + TAIL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, LEAD + r"\\(\\*)" + TAIL, "$1$2$3")


def head_of(role: Column) -> Column:
    return F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]"))


def segment_of(role: Column, text: Column) -> Column:
    """A turn in the template."""
    body = escape(text)
    return F.concat(head_of(role), F.when(role == USER, F.concat(F.lit("[INST] "), body, F.lit(" [/INST]"))).otherwise(body), F.lit("</s>"))


def placed_turns(df: DataFrame) -> DataFrame:
    """One row a turn: conv_id, conv_key, turn_no (from 1), context_chars (of all turns before), role, text, segment."""
    rows = df.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    # keys that are never null, so that joins and groups can share one shuffle of the texts
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    keys = ["conv_key", "turn_key", "role", "digest"]
    rows = rows.withColumns({"conv_key": named("conv_id"), "turn_key": named("turn"), "digest": F.sha2("text", 256)})
    # stored, because numbers and texts are both derived from it
    once = durable(
        rows.groupBy(*keys).agg(
            F.min("conv_id").alias("conv_id"),
            F.min("turn").alias("turn"),
            F.first("text").alias("text"),
            F.count("*").alias("n"),
        )
    )
    sizes = once.select(
        *keys,
        "turn",
        "n",
        F.length(segment_of(F.col("role"), F.col("text"))).cast("bigint").alias("chars"),
        F.substring("digest", 1, 2).alias("start"),
        F.coalesce(F.floor(F.col("turn") / SPAN).cast("bigint"), F.lit(1 << 62)).alias("span"),
    )
    group, span = ["conv_key", "span", "turn_key", "role", "start"], ["conv_key", "span"]
    totals = lambda by, *more: sizes.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("chars")).alias("c"), *more)

    def before(table: DataFrame, by: list[str], order: list, n: Column, c: Column, level: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return table.withColumns({f"n{level}": F.coalesce(F.sum(n).over(w), F.lit(0)), f"c{level}": F.coalesce(F.sum(c).over(w), F.lit(0))})

    n, c = F.col("n"), F.col("c")
    spans = before(totals(span), ["conv_key"], ["span"], n, c, "0").select(*span, "n0", "c0")
    groups = before(
        totals(group, F.min("turn").alias("turn")),
        span,
        [F.col("turn").asc_nulls_last(), "role", "start"],
        n,
        c,
        "1",
    ).select(*group, "n1", "c1")
    inside = before(sizes, group, ["digest"], n, n * F.col("chars"), "2").select(*keys, "span", "start", "chars", "n2", "c2")
    numbers = inside.join(groups, group).join(spans, span)
    numbers = numbers.select(
        *keys,
        "chars",
        (F.col("n0") + F.col("n1") + F.col("n2")).alias("turns_before"),
        (F.col("c0") + F.col("c1") + F.col("c2")).alias("chars_before"),
    )
    each = once.join(numbers, keys).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return each.select(
        "conv_id",
        "conv_key",
        (F.col("turns_before") + F.col("i") + 1).alias("turn_no"),
        (F.col("chars_before") + F.col("i") * F.col("chars")).alias("context_chars"),
        "role",
        "text",
        segment_of(F.col("role"), F.col("text")).alias("segment"),
    )


def format_blocks(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a block: conv_id, conv_key, block, context_chars (of the blocks before), turns, text.

    turns is an array of (turn_no, start, trainable, head_chars, chars) in order: where the segments lie in the whole conversation.
    """
    placed = placed_turns(df).withColumn("block", F.floor((F.col("turn_no") - 1) / block).cast("bigint"))
    turn = F.struct(
        "turn_no",
        "context_chars",
        (F.col("role") == ASSISTANT).alias("trainable"),
        F.length(head_of(F.col("role"))).alias("head_chars"),
        "segment",
    )
    blocks = placed.groupBy("conv_key", "block").agg(F.min("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("t"))
    out = blocks.select(
        "conv_id",
        "conv_key",
        "block",
        F.col("t")[0]["context_chars"].alias("context_chars"),
        F.transform(
            "t", lambda x: F.struct(
                x["turn_no"].alias("turn_no"),
                x["context_chars"].alias("start"),
                x["trainable"].alias("trainable"),
                x["head_chars"].alias("head_chars"),
                F.length(x["segment"]).alias("chars"),
            )
        ).alias("turns"),
        F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("text"),
    )
    # stored, because examples and turns are both read from it
    return durable(out)


def whole_conversations(blocks: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, conv_key, part, parts, text and turns of every conversation, put together from its blocks.

    A conversation whose examples take more than part_chars characters is there once for
    each of its parts, so that its examples are written by as many tasks.
    """
    replies = F.size(F.filter("turns", lambda x: x["trainable"])).cast("bigint")
    written = blocks.groupBy("conv_key").agg(F.sum(replies * (F.col("context_chars") + F.length("text"))).alias("chars"))
    many = durable(written.where(F.col("chars") > part_chars).select("conv_key", (1 + F.floor(F.col("chars") / part_chars)).cast("int").alias("parts")))
    dealt = blocks.join(by_size(many), "conv_key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = dealt.groupBy("conv_key", "part").agg(
        F.min("conv_id").alias("conv_id"),
        F.first("parts").alias("parts"),
        F.sort_array(F.collect_list(F.struct("block", "text", "turns"))).alias("b"),
    )
    return met.select(
        "conv_id",
        "conv_key",
        "part",
        "parts",
        F.array_join(F.transform("b", lambda x: x["text"]), "").alias("text"),
        F.flatten(F.transform("b", lambda x: x["turns"])).alias("turns"),
    )


def examples_of(whole: DataFrame, *more: str) -> DataFrame:
    """conv_id, conv_key, turn_no, text, loss_start, loss_end and the columns `more` of every reply of the part; null in a part without replies."""
    mine = F.filter("turns", lambda x: x["trainable"] & (x["turn_no"] % F.col("parts") == F.col("part")))
    each = whole.select("conv_id", "conv_key", "text", *more, F.explode_outer(mine).alias("reply"))
    end = F.col("reply.start") + F.col("reply.chars")
    return each.select(
        "conv_id",
        "conv_key",
        "reply.turn_no",
        F.substring(F.col("text"), F.lit(1), end.cast("int")).alias("text"),
        (F.col("reply.start") + F.col("reply.head_chars")).alias("loss_start"),
        (end - 4).alias("loss_end"),
        *more,
    )


def expand_examples(blocks: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """One row an example: conv_id, conv_key, turn_no (of the reply), text, loss_start, loss_end.

    `text` is whole: all turns before the reply, and the reply; the loss is on its code points loss_start to loss_end.
    """
    return examples_of(whole_conversations(blocks, part_chars)).where("turn_no IS NOT NULL")


def render_examples(blocks: DataFrame) -> DataFrame:
    """conv_id, turn_no, text, loss_start, loss_end of each example."""
    return expand_examples(blocks).drop("conv_key")


def read_turns(texts: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and said: an array of (role, text) as parsed from the column text."""
    roles, bodies = (F.regexp_extract_all("text", F.lit(TURN), F.lit(i)) for i in (1, 2))

    def turn(role: Column, body: Column) -> Column:
        role = unescape(role)
        plain = F.when(role == USER, F.substring(body, F.lit(8), F.length(body) - 15)).otherwise(body)
        return F.struct(role.alias("role"), unescape(plain).alias("text"))

    return texts.select(*keep, F.zip_with(roles, bodies, turn).alias("said"))


def read_losses(examples: DataFrame, *more: str) -> DataFrame:
    """conv_key, turn_no, chars (of the example's text), loss (the text under the loss mask, unescaped) of every example."""
    loss = unescape(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    return examples.select("conv_key", "turn_no", F.length("text").cast("bigint").alias("chars"), loss.alias("loss"), *more)


def conversation_digest(blocks: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted conversations and their examples.

    formatted_chars counts the characters of all examples plus the turns after the last
    reply once. Texts are put together once; examples are read where they are written.
    """
    keys = ["conv_id", "conv_key", "part", "parts"]
    lines = F.array_join(F.transform("said", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    # the first part reads the turns
    first = F.when(F.col("part") == 0, F.col("text"))
    whole = read_turns(whole_conversations(blocks, part_chars).withColumns({"all": F.col("text"), "text": first}), *keys, "all", "turns")
    whole = whole.select(
        *keys,
        F.col("all").alias("text"),
        "turns",
        F.length("all").cast("bigint").alias("size"),
        F.when(F.col("said").isNotNull(), F.size("said")).cast("bigint").alias("n"),
        F.sha2(lines, 256).alias("sha"),
    )
    losses = read_losses(examples_of(whole, "size", "n", "sha"), "conv_id", "size", "n", "sha")
    spoken = F.when(F.col("turn_no").isNotNull(), F.struct("turn_no", "loss"))
    met = losses.groupBy("conv_key").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("n").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(spoken)), lambda x: x["loss"]), "").alias("loss"),
        (F.coalesce(F.sum("chars"), F.lit(0)) + F.max("size") - F.coalesce(F.max("chars"), F.lit(0))).cast("bigint").alias("formatted_chars"),
    )
    return met.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
