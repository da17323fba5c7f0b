"""Failure episodes, incidents, resolution paths, sparklines and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalars import message_ref, parse_ts, spread, wilson

MAX_GAP_SECONDS = 30 * 60
MAX_STEPS = 40
MAX_LIMIT = 200
TOP_PATHS = 3
BUCKETS = 12
#: Invocations that a task orders, on average: what it holds does not grow with the table.
TASK_ROWS = 50_000
CLUSTER = ["tool_name", "command_family", "error_signature"]


def ordered(invocations: DataFrame) -> DataFrame:
    """Invocations with their instant `ts` and place `rn` in the session; those without an instant come first.

    Sessions are dealt to a number of tasks that follows the number of rows, which adaptive execution leaves as it is.
    """
    tasks = max(invocations.sparkSession.sparkContext.defaultParallelism, -(-invocations.count() // TASK_ROWS))
    invocations = invocations.repartition(tasks, "session_key")
    seq = Window.partitionBy("session_key").orderBy(F.col("ts").asc_nulls_first(), "line_no", "entry_id", "ordinal")
    return invocations.withColumn("ts", parse_ts(F.col("timestamp"))).withColumn("rn", F.row_number().over(seq))


def assemble(invocations: DataFrame, max_gap_seconds: int = MAX_GAP_SECONDS, max_steps: int = MAX_STEPS, paths: bool = True) -> DataFrame:
    """One row for each failure that opens an episode: the first of a command family since its last success.

    The family's next success closes it: resolved within both budgets, abandoned otherwise. A gap counts only where
    both instants are known. resolution_path has the families after the opener up to the resolver; without paths
    the column is left out, and no families are gathered. A session is ordered in one task, whatever its length.
    """
    seq = ordered(invocations)
    family = Window.partitionBy("session_key", "command_family").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("session_key").orderBy("rn").rowsBetween(-(max_steps - 1), 0)
    seq = seq.withColumn("arc", F.coalesce(F.sum(F.when(F.col("is_error") == 0, 1).otherwise(0)).over(family), F.lit(0)))
    seq = seq.withColumn("families", F.collect_list("command_family").over(back)) if paths else seq
    side = F.struct("rn", "entry_id", "ordinal", "tool_name", "error_signature", "project_key", "timestamp", "ts")
    done = F.struct("rn", "entry_id", "ordinal", "timestamp", "ts", *(["families"] if paths else []))
    arcs = seq.groupBy("session_key", "command_family", "arc").agg(F.min(F.when(F.col("is_error") == 1, side)).alias("o"), F.max(F.when(F.col("is_error") == 0, done)).alias("r")).where("o is not null")
    steps = F.col("r.rn") - F.col("o.rn")
    gap = F.col("r.ts").cast("double") - F.col("o.ts").cast("double")
    good = F.col("r.rn").isNotNull() & (steps + 1 <= max_steps) & F.coalesce(gap <= max_gap_seconds, F.lit(True))
    keep = lambda c: F.when(F.col("resolved") == 1, c)
    path = [keep(F.slice(F.col("r.families"), -F.least(steps, F.size("r.families")), F.least(steps, F.size("r.families")))).alias("resolution_path")] if paths else []
    return arcs.withColumn("resolved", good.cast("int")).select(
        "session_key", F.col("o.entry_id").alias("open_entry_id"), F.col("o.ordinal").alias("open_ordinal"), F.col("o.tool_name").alias("tool_name"), "command_family", F.col("o.error_signature").alias("error_signature"), "resolved",
        keep(F.col("r.entry_id")).alias("resolve_entry_id"), keep(F.col("r.ordinal")).alias("resolve_ordinal"),
        *path, F.col("o.project_key").alias("project_key"), F.col("o.timestamp").alias("opened_at"), keep(F.col("r.timestamp")).alias("resolved_at"))


def faceted(episodes: DataFrame, sessions: DataFrame | None = None, tool: str = "", project: str = "", source: str = "", machine: str = "") -> DataFrame:
    """Episodes of a tool, project, source or machine; sessions are joined only for the last two."""
    for name, value in (("tool_name", tool), ("project_key", project)):
        episodes = episodes.where(F.col(name) == value) if value else episodes
    if source or machine:
        wanted = sessions
        for name, value in (("source_name", source), ("machine_id", machine)):
            wanted = wanted.where(F.col(name) == value) if value else wanted
        episodes = episodes.join(wanted.select("session_key").distinct(), "session_key", "left_semi")
    return episodes


def incidents(episodes: DataFrame, state: str = "", limit: int = 50) -> DataFrame:
    """Clusters of episodes by tool, family and signature, scored by recurrence times spread; best first.

    state: '', unresolved, partial or resolved, applied before the limit, which is 200 at most.
    """
    if state not in ("", "unresolved", "partial", "resolved"):
        raise ValueError(f"unknown state {state!r}")
    limit = min(limit if limit > 0 else 50, MAX_LIMIT)
    resolved = F.col("resolved") == 1
    out = episodes.groupBy(*CLUSTER).agg(
        F.count("*").alias("episodes"), F.sum("resolved").cast("bigint").alias("resolved"), F.countDistinct("session_key").alias("sessions"), F.countDistinct("project_key").alias("projects"),
        F.countDistinct(F.when(resolved, F.col("session_key"))).alias("resolved_sessions"), F.min("opened_at").alias("first_seen"), F.max("opened_at").alias("last_seen"))
    out = out.withColumn("resolution_rate", F.col("resolved") / F.col("episodes")).withColumn("state", F.when(F.col("resolved") <= 0, "unresolved").when(F.col("resolved") >= F.col("episodes"), "resolved").otherwise("partial"))
    out = out.withColumn("tier", F.when(F.col("resolved") <= 0, "").when((F.col("resolved") >= 3) & (F.col("resolved_sessions") >= 2), "established").otherwise("emerging")).withColumn("score", F.col("episodes") * spread(F.col("sessions"), F.col("projects")))
    out = out.where(F.col("state") == state) if state else out
    return out.orderBy(F.desc("score"), F.desc("episodes"), *CLUSTER).limit(limit)


def resolution_paths(episodes: DataFrame, top: int = TOP_PATHS) -> DataFrame:
    """The best paths of each cluster by Wilson confidence times spread, with a sample episode of each."""
    done = episodes.where("resolved = 1")
    newest = F.struct("resolved_at", "session_key", "open_entry_id")
    paths = done.groupBy(*CLUSTER, "resolution_path").agg(F.count("*").alias("support"), F.countDistinct("session_key").alias("sessions"), F.countDistinct("project_key").alias("projects"), F.max(newest).alias("sample"))
    cluster = Window.partitionBy(*CLUSTER)
    paths = paths.withColumn("trials", F.sum("support").over(cluster)).withColumn("confidence", wilson(F.col("support"), F.col("trials"))).withColumn("score", F.col("confidence") * spread(F.col("sessions"), F.col("projects")))
    rank = F.row_number().over(cluster.orderBy(F.desc("score"), F.desc("support"), F.array_join("resolution_path", "\0")))
    return paths.withColumn("rank", rank).where(F.col("rank") <= top).select(*CLUSTER, "resolution_path", "support", "sessions", "projects", "trials", "confidence", "score", "rank", F.col("sample.session_key").alias("sample_session"), F.col("sample.open_entry_id").alias("sample_entry"))


def samples(episodes: DataFrame) -> DataFrame:
    """The newest episode of each cluster, as a message reference."""
    newest = F.max(F.struct("opened_at", "session_key", "open_entry_id")).alias("s")
    return episodes.groupBy(*CLUSTER).agg(newest).select(*CLUSTER, message_ref(F.col("s.session_key"), F.col("s.open_entry_id")).alias("sample_ref"))


def sparklines(episodes: DataFrame, page: DataFrame) -> DataFrame:
    """Episodes of the page's clusters in 12 buckets over one window, the first to the last known opening of the page."""
    rows = episodes.join(F.broadcast(page.select(*CLUSTER)), CLUSTER, "left_semi").withColumn("t", parse_ts(F.col("opened_at")).cast("double")).where("t is not null")
    window = rows.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    rows = rows.join(F.broadcast(window))
    bucket = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (BUCKETS - 1))).otherwise(0).cast("int")
    counts = rows.groupBy(*CLUSTER, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    grid = page.select(*CLUSTER, F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"))
    return grid.join(counts, [*CLUSTER, "bucket"], "left").select(*CLUSTER, "bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def trajectories(invocations: DataFrame, episodes: DataFrame) -> DataFrame:
    """All steps from opener to resolver of resolved episodes, with references, in session order."""
    seq = ordered(invocations)
    done = episodes.where("resolved = 1").select("session_key", "open_entry_id", "open_ordinal", "resolve_entry_id", "resolve_ordinal")
    place = seq.select("session_key", "entry_id", "ordinal", "rn")
    ends = done.join(place.select("session_key", F.col("entry_id").alias("open_entry_id"), F.col("ordinal").alias("open_ordinal"), F.col("rn").alias("lo")), ["session_key", "open_entry_id", "open_ordinal"])
    ends = ends.join(place.select("session_key", F.col("entry_id").alias("resolve_entry_id"), F.col("ordinal").alias("resolve_ordinal"), F.col("rn").alias("hi")), ["session_key", "resolve_entry_id", "resolve_ordinal"])
    # steps are few (the budget), so their numbers are exploded and the join has equal keys only
    steps = ends.select("session_key", "open_entry_id", "open_ordinal", "lo", F.explode(F.sequence("lo", "hi")).alias("rn"))
    found = steps.join(seq.select("session_key", "rn", "entry_id", "command_family", "tool_name", "is_error"), ["session_key", "rn"])
    return found.select("session_key", "open_entry_id", "open_ordinal", (F.col("rn") - F.col("lo")).alias("step"), "entry_id", "tool_name", "command_family", "is_error", message_ref(F.col("session_key"), F.col("entry_id")).alias("ref"))


def trajectory(invocations: DataFrame, episodes: DataFrame, session: str, resolve_entry: str, resolve_ordinal: int | None = None) -> DataFrame:
    """Steps of the episode that an entry resolves; ValueError where it resolves several and no ordinal is given."""
    found = episodes.where((F.col("session_key") == session) & (F.col("resolve_entry_id") == resolve_entry))
    found = found if resolve_ordinal is None else found.where(F.col("resolve_ordinal") == resolve_ordinal)
    if len(found.limit(2).collect()) > 1:
        raise ValueError("the entry resolves several episodes; give an ordinal")
    return trajectories(invocations, found).orderBy("step")
