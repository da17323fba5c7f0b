"""Reading a session back: windows, branches to the root, and the live context of a leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.lineage import cut

BEFORE, AFTER, MOST = 3, 5, 200


def clamp(n: int, default: int) -> int:
    return default if n < 0 else min(n, MOST)


def window(entries: DataFrame, centres: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """Entries around each centre (session_key, entry_id), by line number; one row for each centre and entry."""
    lines = entries.select("session_key", F.col("entry_id").alias("centre_id"), F.col("line_no").alias("centre"))
    at = centres.select("session_key", F.col("entry_id").alias("centre_id")).join(lines, ["session_key", "centre_id"])
    # the lines wanted are few and known, so the join has equal keys only
    wanted = at.select("session_key", "centre_id", F.explode(F.sequence(F.col("centre") - clamp(before, BEFORE), F.col("centre") + clamp(after, AFTER))).alias("line_no"))
    return wanted.join(entries, ["session_key", "line_no"])


def branches(entries: DataFrame, leaves: DataFrame) -> DataFrame:
    """(session_key, leaf_id, entry_id, depth): the entries from each leaf (depth 0) to its root by parent_id.

    Ancestors are found by pointer doubling: after k joins each entry knows the 2^k entries above it, so a session
    of any depth takes a logarithmic number of joins. ValueError for a cycle or a parent that isn't there.
    """
    entries = entries.join(leaves.select("session_key").distinct(), "session_key", "left_semi")
    up = entries.select("session_key", "entry_id", F.nullif(F.coalesce("parent_id", F.lit("")), F.lit("")).alias("parent_id"))
    lost = up.where("parent_id is not null").join(up.select("session_key", F.col("entry_id").alias("parent_id")), ["session_key", "parent_id"], "left_anti")
    if not lost.isEmpty():
        raise ValueError("an entry's parent is not in its session")
    walk = leaves.select("session_key", F.col("entry_id").alias("leaf_id")).join(entries.select("session_key", F.col("entry_id").alias("leaf_id")), ["session_key", "leaf_id"], "left_semi")
    walk = walk.select("session_key", "leaf_id", F.col("leaf_id").alias("entry_id"), F.lit(0).cast("bigint").alias("depth"))
    jump, step, size = up.select("session_key", "entry_id", F.col("parent_id").alias("above")), 1, entries.groupBy("session_key").count().agg(F.max("count")).first()[0] or 0
    while step <= size:
        more = walk.join(jump, ["session_key", "entry_id"]).where("above is not null")
        walk = cut(walk.unionByName(more.select("session_key", "leaf_id", F.col("above").alias("entry_id"), (F.col("depth") + step).alias("depth"))))
        jump = cut(jump.join(jump.select("session_key", F.col("entry_id").alias("above"), F.col("above").alias("next")), ["session_key", "above"], "left").select("session_key", "entry_id", F.col("next").alias("above")))
        step *= 2
        if jump.where("above is not null").isEmpty():
            break
    if not jump.where("above is not null").isEmpty():
        raise ValueError("parents form a cycle")
    return walk


def live_context(entries: DataFrame, leaves: DataFrame) -> DataFrame:
    """(session_key, leaf_id, place, entry_id): what a model sees at each leaf.

    Entries that take no part are dropped. Compactions come first, the latest before earlier ones; the latest one's
    first kept entry ends the walk. Others follow from root to leaf. ValueError if a kept entry is off the branch.
    """
    path = branches(entries, leaves).join(entries.select("session_key", "entry_id", "entry_type", "participates_in_context", "first_kept"), ["session_key", "entry_id"])
    compaction = F.col("entry_type") == "compaction"
    latest = path.where(compaction).groupBy("session_key", "leaf_id").agg(F.min_by("first_kept", "depth").alias("anchor"), F.min("depth").alias("at"))
    anchored = latest.where("anchor <> ''").join(path.select("session_key", "leaf_id", F.col("entry_id").alias("anchor"), F.col("depth").alias("stop")), ["session_key", "leaf_id", "anchor"], "left")
    if not anchored.where("stop is null").isEmpty():
        raise ValueError("a compaction keeps an entry that is off the branch")
    cut = path.join(anchored.select("session_key", "leaf_id", "at", "stop"), ["session_key", "leaf_id"], "left")
    # an anchor nearer to the leaf than its compaction has been passed already and ends nothing
    kept = cut.where("participates_in_context = 1 and (stop is null or stop < at or depth <= stop)")
    place = F.row_number().over(Window.partitionBy("session_key", "leaf_id").orderBy(F.when(compaction, 0).otherwise(1), F.when(compaction, F.col("depth")).otherwise(-F.col("depth"))))
    return kept.select("session_key", "leaf_id", place.cast("bigint").alias("place"), "entry_id")


def resolve(ids: DataFrame, column: str, text: str) -> str:
    """The id equal to text, or else the only one that begins with it; LookupError where there is none or several."""
    if not ids.where(F.col(column) == text).isEmpty():
        return text
    found = ids.where(F.col(column).startswith(text)).select(column).distinct().limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{text!r} is {'ambiguous' if found else 'unknown'}")
    return found[0][0]


def artifact_hits(artifacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with (artifact_id, text, raw_path): of the artifacts with its hash, and its parent if that is not '', the one
    of least id; null for none.

    artifacts: (artifact_id, artifact_sha256, parent_session_key, raw_path, text, text_preview); wanted:
    (artifact_sha256, parent_session_key). The text is the preview where there is none.
    """
    body = F.coalesce(F.nullif("text", F.lit("")), F.col("text_preview")).alias("text")
    held = artifacts.select("artifact_sha256", "parent_session_key", "artifact_id", body, "raw_path")
    first = lambda *keys: held.groupBy(*keys).agg(F.min_by(F.struct("artifact_id", "text", "raw_path"), "artifact_id").alias("x")).select(*keys, "x.*")
    asked = wanted.select("artifact_sha256", F.coalesce("parent_session_key", F.lit("")).alias("parent_session_key"))
    own = asked.where("parent_session_key <> ''").join(first("artifact_sha256", "parent_session_key"), ["artifact_sha256", "parent_session_key"], "left")
    return own.unionByName(asked.where("parent_session_key = ''").join(first("artifact_sha256"), "artifact_sha256", "left"))
