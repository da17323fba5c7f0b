"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder on a local master and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    if not found and not _own:
        _own.append(tempfile.mkdtemp(prefix="skein-"))
    return (found or _own[0]).rstrip("/")


@contextmanager
def passing(df: DataFrame, name: str = "passing") -> Iterator[DataFrame]:
    """df written once to the shared folder, for as long as the block runs; then it is deleted, whatever happens."""
    spark = df.sparkSession
    path = new_path(spark, name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
