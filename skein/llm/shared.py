"""Helpers all operators of this subpackage share: intermediate tables, size-checked broadcasts, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which an id table is broadcast; beyond it the same join is left to a shuffle.
BROADCAST_ROWS = 2_000_000

#: Bytes of an Arrow batch at most: long texts then take few rows a batch, and both Python workers and the pools that
#: executors keep for Arrow's buffers stay small.
BATCH_BYTES = 2 << 20

_written: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Hand memory that is free back to the system: a worker goes on to other stages, and an executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        return


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a temporary one where that is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    if not found and not _own:
        _own.append(tempfile.mkdtemp(prefix="skein-"))
    where = spark._jvm.org.apache.hadoop.fs.Path(found or _own[0])
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already
            return


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what was written to the shared folder inside it; results must be written elsewhere by then."""
    begin = len(_written)
    try:
        yield
    finally:
        for own, path in _written[begin:]:
            _delete(own, path)
        del _written[begin:]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised table of narrow rows: hinted for broadcast if it has at most `most` rows, else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def crc_mod(column: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def most_frequent(rows: DataFrame, n: str, by: str, most: int) -> DataFrame:
    """The `most` rows of largest n > 0, ties by `by`; fewer only where there are fewer.

    Levels of about one hundredth tell where the bound falls; only the rows of that level are sorted.
    """
    level = F.floor(F.log2(F.col(n).cast("double")) * 64).cast("int")
    held = 0
    for step in rows.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect():
        if held + step.rows > most:
            return rows.where(level > step.level).unionByName(rows.where(level == step.level).orderBy(F.desc(n), by).limit(most - held))
        held += step.rows
    return rows


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), two long columns: rows (node, component), the component's least node.

    Each round sends every node to its neighbour of least hash (itself included) and contracts; a random order
    makes the number of rounds logarithmic for any graph, sorted paths too.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("v"))
    edges = edges.where("a <> b").select("a", "b")
    label = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least(F.min(order(F.col("b"))), F.min(order(F.col("a"))))["v"].alias("p"))
        parent = materialise(parent, "parents")
        side = bounded(parent)
        pa, pb = side.select("a", F.col("p").alias("pa")), side.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = materialise(edges.join(pa, "a").join(pb, "b").where("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        label = parent.select(F.col("a").alias("node"), F.col("p").alias("root")) if label is None else materialise(
            label.join(side, label.root == parent.a, "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        if edges.isEmpty():
            least = label.groupBy("root").agg(F.min("node").alias("component"))
            return materialise(label.join(least, "root").select("node", "component"), "components")
