"""Ingest as set operations: new versions only, first writer wins, conflicts put aside, blobs and snapshots compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTRY = ["session_key", "entry_id"]


def unknown(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known yet."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def first_writer(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ingest order (machine, path, line)."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("turn = 1").drop("turn")


def same_session_conflicts(rows: DataFrame, order: list[str]) -> DataFrame:
    """(session_key, entry_id, first_sha, second_sha): later versions of an entry that differ from the first."""
    first = F.first("entry_sha256").over(Window.partitionBy(*ENTRY).orderBy(*order))
    return rows.withColumn("first_sha", first).where("entry_sha256 <> first_sha").select(*ENTRY, "first_sha", F.col("entry_sha256").alias("second_sha")).distinct()


def cross_machine_conflicts(rows: DataFrame) -> DataFrame:
    """(source_name, source_session_id, entry_id): entries that two machines hold with different hashes."""
    keys = ["source_name", "source_session_id", "entry_id"]
    found = rows.groupBy(*keys).agg(F.count_distinct("machine_id").alias("machines"), F.min("entry_sha256").alias("lo"), F.max("entry_sha256").alias("hi"), F.min(F.struct("entry_sha256", "machine_id")).alias("a"), F.max(F.struct("entry_sha256", "machine_id")).alias("b"))
    # two machines and two hashes; a conflict needs a pair that differs in both
    return found.where("machines > 1 and lo <> hi").select(*keys, F.col("lo").alias("first_sha"), F.col("hi").alias("second_sha"), F.col("machines").cast("bigint").alias("machines"))


def page(conflicts: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200 and offset 0 or more")
    return conflicts.orderBy("conflict_id").offset(offset).limit(limit)


def snapshot_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(machine_id, relative_path, change): added, removed or changed files between two snapshots."""
    side = lambda d, n: d.select("machine_id", "relative_path", F.col("sha256").alias(n))
    both = side(old, "a").join(side(new, "b"), ["machine_id", "relative_path"], "full_outer").where("not (a <=> b)")
    return both.select("machine_id", "relative_path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def blob_plan(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Per machine: distinct blobs, those stored already, and what is left to send."""
    blobs = new.groupBy("machine_id", "sha256").agg(F.max("bytes").alias("bytes"))
    have = stored.select("sha256").distinct().withColumn("have", F.lit(1))
    return blobs.join(have, "sha256", "left").groupBy("machine_id").agg(F.count("*").alias("blobs"), F.sum(F.coalesce("have", F.lit(0))).cast("bigint").alias("existing"), F.sum(F.when(F.col("have").isNull(), 1).otherwise(0)).cast("bigint").alias("uploads"), F.sum(F.when(F.col("have").isNull(), F.col("bytes")).otherwise(0)).cast("bigint").alias("upload_bytes"))


def download_plan(latest: DataFrame, materialised: DataFrame, known: DataFrame) -> DataFrame:
    """(machine_id, state, files, unknown_blobs, unknown_bytes): what bringing each machine's latest snapshot here takes.

    latest: (machine_id, manifest_sha256, sha256, bytes), a row for each file; materialised: (machine_id,
    manifest_sha256) of what is here; known: (sha256) of blobs that are here. A machine whose latest manifest is here
    is current and needs nothing, whatever its blobs. A blob that several machines need is fetched once, for the
    first of them.
    """
    machines = latest.groupBy("machine_id", "manifest_sha256").agg(F.count("*").alias("files"))
    have = materialised.select("machine_id", F.col("manifest_sha256").alias("have"))
    state = F.when(F.col("have").isNull(), "new").when(F.col("have") == F.col("manifest_sha256"), "current").otherwise("behind")
    machines = machines.join(have, "machine_id", "left").withColumn("state", state)
    wanted = latest.join(machines.where("state <> 'current'").select("machine_id"), "machine_id", "left_semi")
    blobs = unknown(wanted.groupBy("sha256").agg(F.min("machine_id").alias("machine_id"), F.max("bytes").alias("bytes")), known, ["sha256"])
    fetched = blobs.groupBy("machine_id").agg(F.count("*").alias("unknown_blobs"), F.sum("bytes").cast("bigint").alias("unknown_bytes"))
    return machines.join(fetched, "machine_id", "left").na.fill(0, ["unknown_blobs", "unknown_bytes"]).select("machine_id", "state", "files", "unknown_blobs", "unknown_bytes")


def manifest_digests(files: DataFrame) -> DataFrame:
    """(manifest, machine_id, files, digest): a snapshot's identity, by its files' paths and hashes.

    In two levels: files are hashed and fall into 4096 ranges by the hash's first three digits, each range has a
    digest of its hashes in order, and the machine's is that of its ranges in order. So no row gathers more than
    a range's hashes, or 4096 digests.
    """
    line = F.sha2(F.concat_ws("\t", "relative_path", "sha256"), 256)
    rows = files.select("manifest", "machine_id", line.alias("line"))
    ranges = rows.groupBy("manifest", "machine_id", F.substring("line", 1, 3).alias("range")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("digest"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("range", "digest"))), lambda x: x["digest"])
    return ranges.groupBy("manifest", "machine_id").agg(F.sum("n").alias("files"), F.sha2(F.array_join(ordered, ""), 256).alias("digest"))


def vector_diff(mine: DataFrame, latest: DataFrame) -> DataFrame:
    """(machine_id, state): current, behind, missing (not here yet) or gone, by each machine's manifest."""
    both = mine.select("machine_id", F.col("digest").alias("a")).join(latest.select("machine_id", F.col("digest").alias("b")), "machine_id", "full_outer")
    return both.select("machine_id", F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "gone").when(F.expr("a <=> b"), "current").otherwise("behind").alias("state"))


def orphans(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    """(sha256, bytes) of stored blobs that nothing refers to."""
    return stored.join(referenced.select("sha256").distinct(), "sha256", "left_anti")
