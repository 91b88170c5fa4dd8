"""Durable intermediate results in the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if set_dir is None:
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return set_dir


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this session wrote, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def durable_once(df: DataFrame) -> DataFrame:
    """As `durable`, for rows that are dear to compute and few: held on disk meanwhile, because a checkpoint computes its rows twice."""
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        return durable(held)
    finally:
        held.unpersist()
