"""Structured Streaming forms: labels over arriving documents, inspected requests, access events."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.pseudonymize import corpus_spans, rebuild, with_digests
from ..operators.release import match_approvals
from ..operators.requests import inspect_requests
from ..sources.shared import remove

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SPAN = "doc string, row string, unit int, start int, end int, entity string, digest string, label string, fresh boolean"


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state by key; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Labelling(StatefulProcessor):
    """State of an (entity, shard): the numbers of its digests, and the last one given."""

    def __init__(self, shards: int) -> None:
        self.shards = shards

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint")
        self.numbers = handle.getMapState("numbers", "digest string", "seq bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        entity, shard = key
        last = self.last.get()[0] if self.last.exists() else 0
        for some in rows:
            some = some.sort_values(["doc", "row", "unit", "start"], na_position="first", kind="stable")
            given, fresh = {}, []
            for digest in some["digest"]:
                fresh.append(digest not in given and not self.numbers.containsKey((digest,)))
                if fresh[-1]:
                    last += 1
                    self.numbers.updateValue((digest,), (last,))
                if digest not in given:
                    given[digest] = self.numbers.getValue((digest,))[0]
            # shards take turns, so numbers of an entity never meet
            seq = some["digest"].map(given).map(lambda n: (n - 1) * self.shards + shard + 1)
            yield some.assign(label=seq.map(lambda n: f"[{entity}_{n:03d}]"), fresh=fresh)[[c.split()[0] for c in SPAN.split(", ")]]
        self.last.update((last,))

    def close(self) -> None:
        pass


def labelled_spans(documents: DataFrame, order_col: str, text_col: str, secret: bytes, shards: int) -> DataFrame:
    """The identifier spans of arriving documents with their labels, from keyed state."""
    spans = with_digests(corpus_spans(documents, order_col, text_col), secret)
    rows = spans.select(
        F.col("doc").cast("string").alias("doc"),
        "row",
        "unit",
        "start",
        "end",
        "entity",
        "digest",
        F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"),
    )
    return rows.groupBy("entity", "shard").transformWithStateInPandas(Labelling(shards), SPAN, "Append", "None")


def stream_pseudonymize(documents: DataFrame, order_col: str, text_col: str, folder: str, secret: bytes, shards: int = 16) -> StreamingQuery:
    """Label arriving documents consistently with all batches before.

    Numbers of labels live in the query's state store, by digest, so a batch reads the state of its own identifiers
    only. An entity's digests are dealt over shards, which number in turn: numbers are unique, in order of arrival
    within a shard. Documents without identifiers are not shuffled. Documents go to folder/documents/batch=N, labels that a batch
    adds to folder/labels/batch=N; a batch that runs again starts from the state before it and writes over what it left.
    Null and repeated ids are safe; see operators.pseudonymize.
    """
    spans = labelled_spans(documents, order_col, text_col, secret, shards)
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("before"))
    both = whole.unionByName(spans, allowMissingColumns=True)

    def one(batch: DataFrame, number: int) -> None:
        spark, staged = batch.sparkSession, f"{folder}/staged/batch={number}"
        # a batch is computed once: its state must not be asked for twice
        batch.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(batch.schema).parquet(staged)
        docs = rows.where("before is not null").select(*[F.col("before")[c].alias(c) for c in documents.columns])
        found = rows.where("label is not null")
        rebuild(
            docs,
            F.col(f"`{order_col}`"),
            [text_col],
            found.select("row", "unit", "start", "end", "label"),
        ).write.mode("overwrite").parquet(f"{folder}/documents/batch={number}")
        found.where("fresh").select("entity", "digest", "label").write.mode("overwrite").parquet(f"{folder}/labels/batch={number}")
        remove(spark, staged)

    with keyed_store(documents.sparkSession):
        return both.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def arriving_requests(requests: DataFrame, time_col: str, id_col: str, late: str) -> DataFrame:
    """Inspected requests of a stream, each capture once: one that comes again within the watermark is dropped."""
    seen = requests.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])
    return inspect_requests(seen)


def windowed_requests(inspected: DataFrame, time_col: str, window: str) -> DataFrame:
    """Totals and how many entries carry each risk, by tumbling window and class of endpoint; the same on streams and tables."""
    has = lambda c: F.count_if(F.size(c) > 0)
    out = inspected.groupBy(F.window(time_col, window).alias("w"), "classification").agg(
        F.count("*").alias("entries"),
        F.sum("body_bytes").alias("body_bytes"),
        F.sum("pii_hits").alias("pii_hits"),
        has("sensitive_headers").alias("with_sensitive_headers"),
        has("sensitive_query").alias("with_sensitive_query"),
        F.count_if(F.col("secret_fields") > 0).alias("with_secret_fields"),
    )
    return out.select(F.col("w.start").alias("window_start"), *[c for c in out.columns if c != "w"])


def stream_request_monitor(requests: DataFrame, time_col: str, id_col: str, window: str, late: str, folder: str) -> StreamingQuery:
    """Inspect arriving captures and write their totals by window and class to folder/totals/batch=N.

    A window is written once the watermark has passed it, and its state is dropped. Rows
    later than that are counted; see `late_rows`.
    """
    totals = windowed_requests(arriving_requests(requests, time_col, id_col, late), time_col, window)

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/totals/batch={number}")

    with keyed_store(requests.sparkSession):
        return totals.writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window was closed, over the batches whose progress the session keeps (spark.sql.streaming.numRecentProgressUpdates)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def stream_access_log(requests: DataFrame, approvals: DataFrame, folder: str) -> StreamingQuery:
    """Decide arriving access requests against a snapshot of approvals; decisions are appended as events."""

    def one(batch: DataFrame, number: int) -> None:
        decided = match_approvals(batch, approvals).select("path", "purpose", "decision", "reason", "approval_id")
        decided.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
