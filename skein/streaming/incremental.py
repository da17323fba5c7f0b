"""Incremental loads with Structured Streaming: each micro-batch recomputes the sessions it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import episodes, merge

KEYS = ["session_key", "entry_id", "ordinal"]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def follow(spark: SparkSession, source: str, target: str, schema, max_gap_seconds: int = episodes.MAX_GAP_SECONDS, max_steps: int = episodes.MAX_STEPS, max_files: int = 1):
    """Load new invocation files below source into target and stop when none is left.

    target/invocations has one folder for each batch, written whole, so that a batch that is run again after a
    failure replaces itself; rows known from other batches are left out. target/episodes has, for each batch, the
    episodes of the sessions it touched; `current` reads the latest of each session, so a late success turns an
    abandoned episode into a resolved one.
    """
    def load(batch: DataFrame, number: int) -> None:
        base = f"{target}/invocations"
        fresh = merge.first_writer(batch, KEYS, ["line_no"])
        if _exists(spark, base):
            known = spark.read.parquet(base).where(F.col("batch") != number)
            fresh = merge.unknown(fresh, known, KEYS)
        fresh.write.mode("overwrite").parquet(f"{base}/batch={number}")
        every = spark.read.parquet(base)
        touched = every.where(F.col("batch") == number).select("session_key").distinct()
        rows = every.join(touched, "session_key", "left_semi").drop("batch")
        episodes.assemble(rows, max_gap_seconds, max_steps).write.mode("overwrite").parquet(f"{target}/episodes/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    run = stream.writeStream.foreachBatch(load).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The episodes of each session as of the latest batch that touched it."""
    touched = spark.read.parquet(f"{target}/invocations").groupBy("session_key").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{target}/episodes").join(touched, ["session_key", "batch"]).drop("batch")
