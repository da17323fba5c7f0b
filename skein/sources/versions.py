"""Numbered versions of a table in one folder: a version is there once its write has succeeded, and never changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def latest(spark: SparkSession, path: str) -> int:
    """The highest complete version below path; 0 where there is none. Spark's marker of success is what publishes one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return 0
    numbers = [int(f.getPath().getName()[2:]) for f in store.listStatus(where) if f.getPath().getName().startswith("v=")]
    return next((n for n in sorted(numbers, reverse=True) if store.exists(where.suffix(f"/v={n}/_SUCCESS"))), 0)


def publish(rows: DataFrame, path: str, version: int, replace: bool = False) -> None:
    """Write a version of few rows. Remains of an attempt that failed are replaced; a complete version is an error,
    unless it is to be replaced since nothing refers to it."""
    if not replace and latest(rows.sparkSession, path) >= version:
        raise ValueError(f"version {version} of {path} is there already: another writer was faster")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/v={version}")
