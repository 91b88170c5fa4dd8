"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written
as Parquet and read again as the next stage's documents. All stages but the last
return the columns of documents.

Defined results: a null text is empty; the classifier scores it by its bias alone, and if
kept it is a near copy of other empty texts, holds no secrets, has size 0 and so is not
taken by the mix; a null source is a source of its own, a null id stays null. Rows equal
in id and text are one document from the second stage on; the mix may repeat documents. An
empty table gives no rows at every stage. Extra columns are kept whatever their names, up
to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import near_copies, quality_nbsvm, secret_ledger, sentencepiece_scan, source_mix
from cloakframe.llm.common import table
from cloakframe.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, predicts as good."""
    return quality_nbsvm.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity of 0.8 or more): that of the smallest id."""
    return near_copies.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced by a mark and n_chars counted anew where that happened."""
    kind = docs.schema["n_chars"].dataType
    before = docs.withColumn("n_chars", F.when(F.col("n_chars") == F.length("text"), F.lit(None)).otherwise(F.col("n_chars")))
    return secret_ledger.redact(before).withColumn("n_chars", F.coalesce(F.col("n_chars"), F.length("text").cast(kind))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return source_mix.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, part, parts, ids, n_tokens: the encoded documents, giant ones in parts."""
    return sentencepiece_scan.encode(docs, tokenizer_file("piece_bpe_32k.model")).withColumn("n_tokens", (F.length("ids") / 4).cast("bigint"))


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mixing),
    ("SentencePiece encoding", pieces),
]

#: The classifier and the near copies are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages, Parquet in the session's shared folder.

    A stage's rows are removed once the next one's are written; those of the last but one
    stay, because the result is read from them.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    place = f"{shared}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}")
        docs = spark.read.parquet(f"{place}/{i}")
        if i:
            remove(spark, f"{place}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this run wrote, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
