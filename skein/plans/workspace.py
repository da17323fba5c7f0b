"""A workspace: transcripts loaded end to end into tables below one folder, and a method for each question asked of it.

Loading is one pass of set operations: entries of all sources, the first writer of each entry, conflicts aside,
texts redacted on the way in, calls paired with results, failure episodes assembled, postings written. Tables are
Parquet, so any of them can be read alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import redaction as R
from skein.functions import scalars as S
from skein.operators import episodes as E
from skein.operators import health, merge, pairing, read, search
from skein.operators.lineage import passing
from skein.sources import transcripts

LEVEL = "v1"
#: Bytes of an artifact's preview.
PREVIEW_BYTES = 4000
# The tables that `status` counts, the roles whose texts are searched, and the levels of redaction.
TABLES = ("machines", "snapshots", "sources", "files", "sessions", "session_versions", "entries", "messages", "artifacts", "images", "entry_assets", "session_path_tokens", "artifact_path_tokens", "conflicts", "tool_invocations", "redactions", "redaction_events", "fts_messages", "fts_artifacts")
LEVELS = ("none-v1", "v1")
ARTIFACT = "artifact_id bigint, artifact_sha256 string, source_name string, machine_id string, manifest_sha256 string, kind string, parent_session_key string, parent_entry_id string, raw_path string, text string"
ASSET = "session_key string, entry_id string, asset_kind string, content_index int, mime_type string, sha256 string, bytes bigint"
EVENT = "subject_kind string, subject_id string, session_key string, entry_id string, artifact_id bigint, pattern string, count bigint"


def capture(entries: DataFrame, machine: str, source: str, manifest: str = "") -> DataFrame:
    """Entries of one reader with where they come from."""
    return entries.withColumn("machine_id", F.lit(machine)).withColumn("source_name", F.lit(source)).withColumn("manifest_sha256", F.lit(manifest))


class Workspace:
    takes_artifacts = True

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _write(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.table(name)

    def ingest(self, captures: list[DataFrame], artifacts: DataFrame | None = None) -> None:
        """Load captured entries and artifacts (ARTIFACT); the workspace holds what they hold, and nothing of before."""
        every = reduce(DataFrame.unionByName, captures).withColumn("session_key", S.session_key(F.col("machine_id"), F.col("source_name"), F.col("source_session_id")))
        # it holds secrets, so it is no table of the workspace and goes when the tables are written
        with passing(every, "captures") as read:
            self._tables(read, artifacts)

    def _tables(self, every: DataFrame, artifacts: DataFrame | None) -> None:
        order = ["machine_id", "path", "line_no"]
        self._write("machines", every.select("machine_id").distinct())
        self._write("sources", every.select("source_name").distinct())
        self._write("snapshots", every.select("manifest_sha256", "machine_id").distinct())
        self._write("files", every.groupBy("machine_id", "source_name", "path").agg(F.count("*").alias("lines")))
        known = F.nullif("cwd", F.lit(""))
        sessions = every.groupBy("session_key", "machine_id", "source_name", "source_session_id").agg(
            F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.struct("path", "line_no"))), F.lit("")).alias("raw_cwd"), F.coalesce(F.min(F.nullif("timestamp", F.lit(""))), F.lit("")).alias("started_at"), F.max(F.col("is_subagent").cast("int")).alias("is_subagent"))
        sessions = self._write("sessions", sessions.withColumn("project_key", S.project_key(F.col("raw_cwd"))).withColumn("redaction_level", F.lit(LEVEL)))
        self._write("session_versions", every.select("session_key", "path", "manifest_sha256").distinct())
        self._write("session_path_tokens", sessions.select("session_key", F.explode(S.path_tokens(F.col("raw_cwd"))).alias("token")))
        self._write("conflicts", merge.same_session_conflicts(every, order))
        first = merge.first_writer(every, merge.ENTRY, order).join(sessions.select("session_key", "project_key"), "session_key")
        self._write("entries", first.select(*merge.ENTRY, "parent_id", "line_no", "entry_type", "timestamp", "role", "entry_sha256", R.redact(F.col("raw_json")).alias("raw_json"), "participates_in_context", "first_kept", "project_key"))
        texts = first.select("session_key", "entry_id", "role", F.col("text").alias("plain"), "tool_name", "command", "model", "provider", "tokens", "cost", "participates_in_context", "first_kept")
        messages = self._write("messages", texts.withColumn("text", R.redact(F.col("plain"))).withColumn("command", R.redact(F.col("command"))).drop("plain"))
        self._write("redactions", texts.select("session_key", "entry_id", F.explode(R.redaction_hits(F.col("plain"))).alias("pattern", "count")))
        calls = first.select("session_key", "entry_id", "line_no", "timestamp", "project_key", F.explode("tool_calls").alias("c")).select("session_key", "entry_id", "line_no", "timestamp", "project_key", F.col("c.ordinal"), F.col("c.id").alias("call_id"), "c.tool_name", "c.command", "c.files_json")
        results = first.select("session_key", "line_no", F.explode("tool_results").alias("r")).select("session_key", "line_no", "r.ordinal", "r.for_id", "r.is_error", "r.outcome_text", "r.exit_code")
        invocations = self._write("tool_invocations", pairing.tool_invocations(calls, results, index_output=True))
        self._write("failure_episodes", E.assemble(invocations))
        held = artifacts if artifacts is not None else self.spark.createDataFrame([], ARTIFACT)
        plain = F.coalesce("text", F.lit(""))
        hits = held.select("artifact_id", "parent_session_key", "parent_entry_id", F.explode(R.redaction_hits(plain)).alias("pattern", "count"))
        kept = self._write("artifacts", held.withColumn("text", R.redact(plain)).withColumn("text_preview", S.truncated_utf8(F.col("text"), PREVIEW_BYTES)))
        self._write("artifact_path_tokens", kept.select("artifact_id", F.explode(S.path_tokens(F.col("raw_path"))).alias("token")))
        self._write("redaction_events", hits.select(F.lit("artifact").alias("subject_kind"), F.col("artifact_id").cast("string").alias("subject_id"), F.col("parent_session_key").alias("session_key"), F.col("parent_entry_id").alias("entry_id"), "artifact_id", "pattern", "count"))
        for name, schema in (("images", "sha256 string, mime_type string, bytes bigint"), ("entry_assets", ASSET)):
            self._write(name, self.spark.createDataFrame([], schema))
        search.build(messages.withColumn("id", F.concat_ws("\t", "session_key", "entry_id")), "id", f"{self.root}/fts_messages")
        search.build(kept, "artifact_id", f"{self.root}/fts_artifacts")

    # -- questions ---------------------------------------------------------------------------------------------------

    def _indexed(self, name: str) -> DataFrame:
        return self.table(f"{name}/postings").select("id").distinct()

    def _counted(self, name: str) -> DataFrame:
        return self._indexed(name) if name.startswith("fts_") else self.table(name)

    def status(self) -> DataFrame:
        """(name, n): rows of each table, hits of redaction, and sessions by level of redaction."""
        counts = health.status({t: self._counted(t) for t in TABLES})
        hits = self.table("redactions").select("count").unionByName(self.table("redaction_events").select("count")).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).select(F.lit("redaction_hits").alias("name"), "n")
        levels = self.table("sessions").groupBy(F.concat(F.lit("redaction_level:"), F.coalesce("redaction_level", F.lit(LEVELS[0]))).alias("name")).agg(F.count("*").alias("n"))
        return counts.unionByName(hits).unionByName(levels)

    def redactions_by_pattern(self) -> DataFrame:
        side = lambda t: self.table(t).select("pattern", F.col("count").alias("hits"))
        return health.redactions_by_pattern(side("redactions"), side("redaction_events"))

    def checks(self) -> DataFrame:
        """(check, n) of all eleven checks of integrity: equal-key anti joins, and a filter for levels."""
        t, entry = self.table, merge.ENTRY
        orphans = lambda name, rows, parents, keys: health.orphan_check(name, rows, parents, keys)
        said = t("messages").where(F.size(search.tokens(F.col("text"))) > 0).select(F.concat_ws("\t", *entry).alias("id"))
        kept = t("artifacts").where(F.size(search.tokens(F.col("text"))) > 0).select(F.col("artifact_id").alias("id"))
        every = t("messages").select(F.concat_ws("\t", *entry).alias("id"))
        events = t("redaction_events")
        lost = [events.where("subject_kind = 'session'").join(t("sessions").select(F.col("session_key").alias("subject_id")), "subject_id", "left_anti").select("subject_id"),
                events.where("subject_kind = 'entry'").join(t("entries").select(*entry), entry, "left_anti").select("subject_id"),
                events.where("subject_kind = 'artifact' and artifact_id is not null").join(t("artifacts").select("artifact_id"), "artifact_id", "left_anti").select("subject_id")]
        total = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        found = [orphans(f"orphan_{name}", t(name), t("entries"), entry) for name in ("messages", "entry_assets", "tool_invocations", "redactions")]
        found += [orphans("orphan_artifacts", t("artifacts"), t("snapshots"), ["manifest_sha256"]),
                  orphans("orphan_fts_messages", self._indexed("fts_messages"), every, ["id"]), orphans("missing_fts_messages", said, self._indexed("fts_messages"), ["id"]),
                  orphans("orphan_fts_artifacts", self._indexed("fts_artifacts"), t("artifacts").select(F.col("artifact_id").alias("id")), ["id"]), orphans("missing_fts_artifacts", kept, self._indexed("fts_artifacts"), ["id"]),
                  total("orphan_redaction_events", reduce(DataFrame.unionByName, lost)), total("unknown_redaction_levels", t("sessions").where(~F.coalesce("redaction_level", F.lit(LEVELS[0])).isin(*LEVELS)))]
        return reduce(DataFrame.unionByName, found)

    def verify(self) -> DataFrame:
        return self.checks().where("n > 0")

    def joined(self) -> DataFrame:
        """Messages with their entries and sessions, as `search.find` takes them."""
        entries = self.table("entries").select(*merge.ENTRY, "timestamp")
        sessions = self.table("sessions").select("session_key", "source_name", "machine_id", F.col("raw_cwd").alias("raw_path"), "project_key")
        return self.table("messages").select(F.concat_ws("\t", *merge.ENTRY).alias("id"), *merge.ENTRY, "role", "text").join(entries, merge.ENTRY).join(sessions, "session_key")

    def search(self, query: str, limit: int = search.DEFAULT_LIMIT, path_token: str = "", **facets: str) -> DataFrame:
        return search.find(search.open_index(self.spark, f"{self.root}/fts_messages"), self.joined(), query, limit, self.table("session_path_tokens"), path_token, **facets)

    def search_all(self, query: str, limit: int = 0, role: str = "", path_token: str = "", **facets: str) -> DataFrame:
        """Messages and artifacts; artifacts only without a role, or with theirs."""
        said = self.search(query, limit, path_token, role=role, **facets)
        if role not in ("", "artifact") or not self.takes_artifacts:
            return said
        artifacts = self.table("artifacts").withColumn("id", F.col("artifact_id"))
        tokens = self.table("artifact_path_tokens").select(F.col("artifact_id").alias("id"), "token")
        snapshots = self.table("snapshots")
        # a load without manifests knows no times
        snapshots = snapshots if "captured_at" in snapshots.columns else snapshots.select("manifest_sha256", F.lit(None).cast("string").alias("captured_at"))
        index = search.open_index(self.spark, f"{self.root}/fts_artifacts")
        kept = search.find_artifacts(index, artifacts, snapshots.groupBy("manifest_sha256").agg(F.min("captured_at").alias("captured_at")), self.table("sessions"), query, limit, tokens, path_token, **facets)
        return search.find_all(said, kept, limit)

    def artifact(self, wanted: DataFrame) -> DataFrame:
        return read.artifact_hits(self.table("artifacts"), wanted)

    def incidents(self, state: str = "", limit: int = 50, **facets: str) -> DataFrame:
        return E.incidents(E.faceted(self.table("failure_episodes"), self.table("sessions"), **facets), state, limit)

    def resolution_paths(self, top: int = E.TOP_PATHS) -> DataFrame:
        return E.resolution_paths(self.table("failure_episodes"), top)

    def trajectory(self, session: str, resolve_entry: str, ordinal: int | None = None) -> DataFrame:
        return E.trajectory(self.table("tool_invocations"), self.table("failure_episodes"), session, resolve_entry, ordinal)

    def window(self, centres: DataFrame, before: int = read.BEFORE, after: int = read.AFTER) -> DataFrame:
        return read.window(self.table("entries"), centres, before, after)

    def branch(self, leaves: DataFrame) -> DataFrame:
        return read.branches(self.table("entries"), leaves)

    def live_context(self, leaves: DataFrame) -> DataFrame:
        return read.live_context(self.table("entries").withColumn("participates_in_context", F.col("participates_in_context").cast("int")), leaves)

    def conflicts(self) -> DataFrame:
        """(conflict_id, session_key, entry_id, first_sha, second_sha); an id is a hash of its row's keys."""
        return self.table("conflicts").withColumn("conflict_id", F.xxhash64("session_key", "entry_id", "second_sha"))

    def overview(self, column: str = "source_name", limit: int | None = None) -> DataFrame:
        return health.counted(self.table("sessions"), column, limit=limit)

    def load(self, root: str, machine: str, sources: tuple[str, ...] = ("pi", "claude-code", "codex")) -> None:
        """Ingest the transcripts below root/<source> of one machine."""
        self.ingest([capture(transcripts.read(self.spark, s, f"{root}/{s}"), machine, s) for s in sources])
