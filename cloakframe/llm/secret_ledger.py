"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every text is addressed by its SHA-256, every rule by a digest of its
pattern, flags and limits. The ledger holds which rules of which version a blob was
scanned with, and what they found. A run scans one text per address, and that only
with the (blob, rule version) pairs that the ledger lacks: a new text meets all rules,
a changed rule meets all texts, and nothing else is read again. New rows are appended;
findings are joined back to all paths (rows) that carry the blob.

Defined results: null text counts as empty and is a blob like any other; rows repeat
as given; null ids stay null; an empty input gives empty results; extra columns of
the input are ignored (`redact` keeps them); very long texts are scanned whole, in
linear time; offsets are code points, end exclusive. No secret value enters the
ledger, only kinds and offsets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import membership
from .common import by_size, durable, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, its flags, and the least length of one of its groups."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        """Changes whenever anything does that decides what the rule finds."""
        said = "\0".join(map(str, (self.kind, self.pattern, int(self.flags), self.group, self.least)))
        return f"{self.kind}@{hashlib.sha256(said.encode()).hexdigest()[:16]}"

    def find(self, text: str) -> list[tuple[int, int]]:
        found = re.compile(self.pattern, self.flags).finditer(text)
        return [(m.start(), m.end()) for m in found if len(m[self.group]) >= self.least]


# The base patterns, then the patterns that this operator adds.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, 2, 6),
    # `[A-Z0-9]+` runs to the end of the run, so a match of under 20 characters never hides
    # a longer one and the pattern may ask for the length itself; the same holds for hex runs
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    # up to the matching end, or as far as lines of base64 go
    Rule(
        "private_key",
        r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:\s*+(?:[A-Za-z-]+: [^\n]*\n)*+[A-Za-z0-9+/=\s]*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/=]{16,}+)*+)",
    ),
    Rule("bearer_jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]+:[^\s:/@]{3,}@"),
)
FINDING = "struct<start:int,rank:int,kind:string,version:string,end:int>"
LEDGER = f"blob string, rules array<string>, findings array<{FINDING}>"
ARROW_FINDING = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("version", pa.string()), ("end", pa.int32())])
MARK = "[SECRET]"


def scan_text(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """All spans by start, then kind in the order of the rules."""
    found = [(start, rank, r.kind, end) for rank, r in enumerate(rules) for start, end in r.find(text)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds by start, then kind as listed."""
    return scan_text(text, tuple(r for r in RULES if r.kind in BASE_KINDS))


def versions(rules: tuple[Rule, ...]):
    return F.array(*[F.lit(r.version) for r in rules])


def scan_unseen(df: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, rules, findings) for the pairs of blob and rule version that `ledger` lacks.

    Addresses ask the ledger first; texts that it knows whole stay where they are read.
    Copies meet by address: each task keeps one text per address before anything is
    shuffled, so a blob that a third of all rows carry still arrives as one row a task.
    """
    text = text_or_empty(text_col)
    rows, one = df.select(F.sha2(text, 256).alias("blob"), text.alias("text")), F.first("text").alias("text")
    if ledger is None:
        todo = rows.groupBy("blob").agg(one).withColumn("rules", versions(rules))
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        none = F.array().cast("array<string>")
        lacking = rows.select("blob").distinct().join(seen, "blob", "left").select(
            "blob",
            F.array_except(versions(rules), F.coalesce("seen", none)).alias("rules"),
        )
        lacking = durable(lacking.where(F.size("rules") > 0))
        todo = membership.may_hold(rows, lacking, "blob").groupBy("blob").agg(one).join(lacking, "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = {r.version: (rank, r) for rank, r in enumerate(rules)}
        for b in batches:
            found = []
            for text, wanted in zip(b.column("text"), b.column("rules"), strict=True):
                said, rows = text.as_py(), []
                for rank, r in map(ranked.__getitem__, wanted.as_py()):
                    rows += [{"start": s, "rank": rank, "kind": r.kind, "version": r.version, "end": e} for s, e in r.find(said)]
                found.append(sorted(rows, key=lambda x: (x["start"], x["rank"])))
            yield pa.RecordBatch.from_arrays(
                [b.column("blob"), b.column("rules"), pa.array(found, pa.list_(ARROW_FINDING))],
                names=["blob", "rules", "findings"],
            )

    return todo.select("blob", "text", "rules").mapInArrow(run, LEDGER)


def update_ledger(df: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with what it lacks for `df` scanned and added; only the new rows are written, durably."""
    new = durable(scan_unseen(df, ledger, text_col, rules))
    return new if ledger is None else ledger.unionByName(new)


def stored_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger in a folder; empty if nothing is there yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def append_to_ledger(df: DataFrame, folder: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Bring the ledger in a folder up to date with one more version of a table; what it holds is not written again."""
    new = durable(scan_unseen(df, stored_ledger(df.sparkSession, folder), text_col, rules))
    new.write.mode("append").parquet(folder)


def hits_by_blob(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob and its findings under the present rules, by start and kind; blobs without findings are left out."""
    found = ledger.select("blob", F.filter("findings", lambda s: s["version"].isin(*[r.version for r in rules])).alias("f")).where(F.size("f") > 0)
    return found.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("f")))).alias("findings"))


def findings_by_path(df: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id, blob and findings for every row; rows without findings get an empty array.

    Only blobs with findings take part in the join.
    """
    paths = df.select(F.col(id_col), F.sha2(text_or_empty(text_col), 256).alias("blob"))
    none = F.array().cast(f"array<{FINDING}>")
    return paths.join(hits_by_blob(ledger, rules), "blob", "left").select(id_col, "blob", F.coalesce("findings", none).alias("findings"))


def scan_secrets(df: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date with `df`, then findings for every row of `df`."""
    return findings_by_path(df, update_ledger(df, ledger, text_col), id_col, text_col)


def joined(spans):
    """kind:start:end, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str) -> DataFrame:
    """Counts of the base kinds, the digest of base spans, and all spans as one string, from findings by path."""
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(id_col, *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def secret_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", earlier=None) -> DataFrame:
    """The digests of every row, by way of a ledger that grows over the table's versions.

    `earlier`, a condition, names the rows that an earlier version of the table held: they
    fill the ledger first, and of the rows that came later only what it lacks is scanned.
    """
    old = F.coalesce(earlier, F.lit(False)) if earlier is not None else F.lit(False)
    ledger = update_ledger(df.where(old), None, text_col) if earlier is not None else None
    ledger = update_ledger(df.where(~old), ledger, text_col)
    return digests(findings_by_path(df, ledger, id_col, text_col), id_col)


def mask(text: str, spans: list[dict]) -> str:
    """The text with every span, or run of overlapping spans, replaced by one mark."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], MARK]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """`df` with every span replaced by [SECRET]; overlapping spans become one mark.

    Texts without findings pass unchanged, byte for byte. Findings are sent to all tasks
    if the blobs that have any are few, else texts are shuffled to them.
    """
    hits = durable(hits_by_blob(update_ledger(df, ledger, text_col), RULES)).select(
        F.col("blob").alias("__blob"),
        F.col("findings").alias("__findings"),
    )
    # other columns travel in one struct, so that none can clash with a working name
    others = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in df.columns if c != text_col])
    rows = df.select(
        others.alias("__row"),
        F.col(f"`{text_col}`").cast("string").alias("__text"),
        F.sha2(text_or_empty(text_col), 256).alias("__blob"),
    )
    found = rows.join(by_size(hits, F.size("__findings")), "__blob", "left").select("__row", "__text", "__findings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column("__findings").null_count < b.num_rows:
                texts = [t.as_py() if f.as_py() is None else mask(t.as_py(), f.as_py()) for t, f in zip(b.column("__text"), b.column("__findings"), strict=True)]
                b = b.set_column(b.schema.get_field_index("__text"), "__text", pa.array(texts, b.schema.field("__text").type))
            yield b.select(["__row", "__text"])

    clean = found.mapInArrow(run, found.select("__row", "__text").schema)
    return clean.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in df.columns])
