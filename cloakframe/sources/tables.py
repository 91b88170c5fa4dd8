"""Tables, corpora, request captures, JSON lines, artifacts: reading and writing."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import tree_digest
from ..functions.lazy import vectorised
from .shared import durable, remove

SUFFIX = re.compile(r"\.(csv|jsonl|json|parquet)$", re.IGNORECASE)
CORPUS_SUFFIXES = (".txt", ".md", ".markdown", ".html", ".htm")
CAPTURE_LIMIT = 25 * 1024 * 1024


def suffix_of(path: str) -> str:
    found = SUFFIX.search(path.rstrip("/"))
    if not found:
        raise ValueError(f"no reader for {path.rsplit('/', 1)[-1]}")
    return found[1].lower()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: CSV with header, JSON (lines first, then whole documents), Parquet."""
    kind = suffix_of(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    if kind == "parquet":
        return spark.read.parquet(path)
    lines = spark.read.json(path)
    whole = kind == "json" and lines.columns == ["_corrupt_record"] or "_corrupt_record" in lines.columns
    return spark.read.json(path, multiLine=True) if whole else lines


def write_table(df: DataFrame, path: str) -> None:
    kind = suffix_of(path)
    if kind == "csv":
        df.write.csv(path, header=True, escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss")
    elif kind == "parquet":
        df.write.parquet(path)
    else:
        df.write.json(path)


@vectorised("boolean")
def _in_place(paths: pd.Series) -> pd.Series:
    """Whether a local file is reached without a symbolic link below the folder that was read."""
    return paths.map(lambda p: os.path.realpath(p) == os.path.abspath(p))


def read_corpus(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path (relative), order_key (case-folded), kind, text of the text and HTML files of a folder.

    Symbolic links are left out (object stores and HDFS have none). Fails if two paths differ
    by case only. order_key gives documents their order, as for pseudonymize_corpus.
    """
    local = re.match(r"[a-z][a-z0-9+.-]*://", folder) is None and spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:") or folder.startswith("file:")
    if local:
        folder = os.path.realpath(re.sub(r"^file:/*", "/", folder))
    glob = "*.{" + ",".join(s[1:] for s in CORPUS_SUFFIXES) + "," + ",".join(s[1:].upper() for s in CORPUS_SUFFIXES) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    plain = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    if local:
        files = files.where(_in_place(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))))
    root = re.sub(r"^[a-z]+:/*", "/", folder).rstrip("/") + "/"
    relative = F.regexp_replace(plain, "^.*?" + re.escape(root), "")
    kind = F.when(F.lower("path").rlike(r"\.html?$"), "html").otherwise("text")
    out = files.select(relative.alias("path"), F.lower(relative).alias("order_key"), kind.alias("kind"), F.decode("content", "UTF-8").alias("text"))
    if out.groupBy("order_key").count().where("count > 1").limit(1).count():
        raise ValueError("two files of the corpus have paths that differ by case only")
    return out


REQUEST = "method string, url string, headers array<struct<name:string,value:string>>, cookies array<struct<name:string>>, postData struct<text:string>"
CAPTURE = f"log struct<entries:array<struct<request:struct<{re.sub(r'(\w+) (string|array|struct)', r'\1:\2', REQUEST).replace(', ', ',')}>>>>"


def read_har(spark: SparkSession, path: str, limit: int = CAPTURE_LIMIT) -> DataFrame:
    """method, url, headers, cookies, body: one row a request of all captures; rows without a host are dropped.

    A capture over the size limit, or without log entries, is an error.
    """
    files = spark.read.schema(CAPTURE).json(path, multiLine=True, recursiveFileLookup=True)
    rows = files.select("log.entries", F.col("_metadata.file_size").alias("size"))
    bad = rows.agg(F.count_if(F.col("size") > limit).alias("large"), F.count_if(F.col("entries").isNull()).alias("broken")).first()
    if bad["large"] or bad["broken"]:
        raise ValueError(f"{bad['large']} captures are too large, {bad['broken']} have no log entries")
    out = rows.select(F.explode("entries").alias("e")).select("e.request.*").where(F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"))
    return out.select("method", "url", "headers", "cookies", F.col("postData.text").alias("body"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1, in its file), value of every line of text files.

    Lines are numbered inside the block of a file that a task reads; a small table carries
    the lines of the blocks before.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    # stored, because both the counts and the lines need the same numbers
    lines = durable(lines)
    counts = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("file", "block", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ahead"))
    return lines.join(ahead, ["file", "block"]).select("file", (F.col("ahead") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def read_jsonl_checked(spark: SparkSession, path: str, schema: str, key: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejects (file, line_no, line, reason): malformed lines, missing fields, empty or repeated keys. Blank lines are skipped.

    A reject shows its line by digest, not by content. A corpus without valid rows or rejects is refused.
    """
    kind = T.StructType.fromDDL(schema)
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = durable(
        lines.select(
            "file",
            "line_no",
            "value",
            F.from_json("value", T.StructType([*kind, T.StructField("_corrupt_record", T.StringType())]), {"mode": "PERMISSIVE"}).alias("r"),
        )
    )
    if not parsed.limit(1).count():
        raise ValueError("the corpus has no lines")
    missing = F.array_compact(
        F.array(*[F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in required])
    ) if required else F.array().cast("array<string>")
    reason = F.when(F.col("r._corrupt_record").isNotNull(), "malformed").when(
        F.coalesce(F.trim(F.col(f"r.{key}").cast("string")), F.lit("")) == "",
        "empty_key",
    ).when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))
    checked = parsed.withColumn("reason", reason)
    good = checked.where("reason is null")
    twice = good.groupBy(F.col(f"r.{key}").alias("k")).count().where("count > 1").select("k")
    valid = good.join(twice, F.col(f"r.{key}") == F.col("k"), "left_anti").select("r.*").drop("_corrupt_record")
    repeated = good.join(twice, F.col(f"r.{key}") == F.col("k"), "left_semi").withColumn("reason", F.lit("duplicate_key"))
    told = lambda df: df.select("file", "line_no", F.sha2("value", 256).alias("line"), "reason")
    return valid, told(checked.where("reason is not null")).unionByName(told(repeated))


#: Bytes of a file that are held at one time.
WINDOW = 4 << 20


def artifact_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), sha256, bytes of every file below a folder.

    Files are listed first; then each is read in a task through a window of bounded size, the largest first,
    so a file of any size takes no more memory than a small one. What only Spark's own file systems can open is read whole,
    and there files without bytes, which Spark's listing leaves out, have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.escape(re.sub(r"^[a-z]+:/*", "/", folder).rstrip("/") + "/")
    relative = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[a-z]+:/*", "/"), "^.*?" + root, "")
    # a filter over the file's metadata is applied to the listing; one over `path` only after the contents are read
    local = F.col("_metadata.file_path").startswith("file:/")
    elsewhere = files.where(~local).select(relative("path").alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, path in zip(b.column("place").to_pylist(), b.column("path").to_pylist(), strict=True):
                digest, size = hashlib.sha256(), 0
                with open(re.sub("^file:/+", "/", place), "rb", buffering=0) as f:
                    while part := f.read(WINDOW):
                        digest.update(part)
                        size += len(part)
                yield pa.RecordBatch.from_pylist([{"path": path, "sha256": digest.hexdigest(), "bytes": size}])

    # the listing holds no contents; files are dealt one by one over tasks
    listed = files.where(local).select(F.col("path").alias("place"), relative("path").alias("path"), "length")
    dealt = listed.repartition(4 * spark.sparkContext.defaultParallelism).sortWithinPartitions(F.col("length").desc()).select("place", "path")
    return dealt.unionByName(empty_files(spark, folder, root, dealt)).mapInArrow(run, "path string, sha256 string, bytes bigint").unionByName(elsewhere)


def empty_files(spark: SparkSession, folder: str, root: str, like: DataFrame) -> DataFrame:
    """place, path of the files without bytes below a mounted folder: a walk in one task that gives out these only."""
    top = re.sub("^file:/+", "/", folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, _, names in os.walk(top) if b.num_rows else ():
                if found := [p for p in (os.path.join(place, n) for n in names) if not os.path.getsize(p)]:
                    yield pa.RecordBatch.from_pydict({"place": found, "path": [re.sub("^.*?" + root, "", p, count=1) for p in found]})

    if re.match("^(?!file:)[a-z]+:", folder):
        return like.limit(0)
    return spark.range(1).mapInArrow(run, "place string, path string").where(~F.col("path").rlike(r"(^|/)[._]"))


MANIFEST = "artifact string, artifact_sha256 string, allow boolean, allow_after_final_scan boolean, release_class string, final_scan struct<passed:boolean,pii_hits:bigint,by_entity:map<string,bigint>>"


def stage_release(df: DataFrame, allow: bool, folder: str, release_class: str = "aggregate") -> DataFrame:
    """Write a payload only if allowed and its scan finds nothing; the manifest is always written and returned.

    What is scanned is what was written: the payload is read back, and removed again if
    the scan finds anything or breaks off. Ranges of counts are no texts.
    """
    from ..operators.pii import scan_table
    from ..operators.stats import without_ranges

    spark, payload = df.sparkSession, f"{folder}/payload"
    name = digest = None
    by_entity: dict[str, int] = {}
    if allow:
        try:
            df.write.json(payload)
            staged = spark.read.schema(df.schema).json(payload)
            by_entity = {r["entity"]: r["n"] for r in scan_table(without_ranges(staged)).groupBy("entity").agg(F.sum("hits").alias("n")).collect()}
            parts = artifact_digests(spark, payload).where(F.col("path").endswith(".json"))
            name, digest = "payload", tree_digest(parts, F.concat_ws("\0", "sha256", F.col("bytes").cast("string")))
        except Exception:
            remove(spark, payload)
            raise
        if by_entity:
            remove(spark, payload)
            name = digest = None
    else:
        by_entity = {r["entity"]: r["n"] for r in scan_table(without_ranges(df)).groupBy("entity").agg(F.sum("hits").alias("n")).collect()}
    row = {
        "artifact": name,
        "artifact_sha256": digest,
        "allow": allow,
        "allow_after_final_scan": name is not None,
        "release_class": release_class,
        "final_scan": {"passed": not by_entity, "pii_hits": sum(by_entity.values()), "by_entity": by_entity},
    }
    manifest = spark.createDataFrame([row], MANIFEST)
    manifest.write.json(f"{folder}/manifest")
    return manifest


def append_ledger(df: DataFrame, path: str) -> None:
    """Append rows to a ledger of JSON lines."""
    df.write.mode("append").json(path)


def write_run_records(
    runs: DataFrame,
    path: str,
    allowed: tuple[str, ...] = ("experiment_id", "seed", "duration_seconds", "metrics", "case_id", "baseline", "attack_family"),
) -> None:
    """Run records as JSON lines; only columns on the list are written, so no source text gets there."""
    runs.select(*sorted(c for c in runs.columns if c in allowed)).write.json(path)


def write_summary(
    summary: DataFrame,
    path: str,
    allowed: tuple[str, ...] = (
        "experiment_id",
        "metric",
        "n",
        "mean",
        "sd",
        "ci_low",
        "ci_high",
        "benchmark",
        "value",
        "baseline",
        "attack_family",
        "cases",
    ),
) -> None:
    """A summary of runs (a few rows) as one file of JSON lines, fields and rows in sorted order; other columns than those on the list are left out."""
    kept = sorted(c for c in summary.columns if c in allowed)
    summary.select(*kept).orderBy(*kept).coalesce(1).write.json(path)
