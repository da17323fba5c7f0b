"""A workspace that grows by snapshots: what is known is not read again, and only touched sessions are rewritten.

A snapshot is a manifest: the files of a machine at a time, each by its content's hash. A session file whose version
(hash, both paths, machine, source) is known is only noted; transcripts of the others are read. Sessions fall into
buckets by their source and their id there, so that all machines' copies of a session are in one bucket, and one
version of a table rewrites the buckets that new entries touch. Every table is a set of folders
`<table>/v=<version>/bucket=<bucket>`; a small list of them is published last, which makes a version visible as a
whole. Readers of an earlier list are not disturbed, and what an attempt that failed has left is replaced.

The first writer of an entry wins. A later entry of the same id with other content is quarantined: as a conflict
within the session if the session holds the entry already, else as one across machines. Texts are redacted before
anything is written; hashes are those of the raw lines. There is one writer at a time; a second one fails to publish.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import images
from skein.functions import redaction as R
from skein.functions import scalars as S
from skein.operators import episodes, merge, pairing, search, segments
from skein.plans.workspace import ARTIFACT, EVENT, LEVEL, Workspace
from skein.sources import transcripts, versions
from skein.sources.archive import Archive

#: Buckets of sessions. A bucket is what one new file rewrites; fixed when a workspace is made.
BUCKETS = 64
#: Sessions of a bucket are spread over so many files of each table, whatever the number of tasks.
SPREAD = 8
#: Transcripts that an opener is given at once, since their paths are listed in the driver; an opener that lists none
#: says so by an attribute `any_number`. More files are read in parts.
FILES = 10_000
#: Versions that one ingest makes at most, so that the buckets are rewritten a fixed number of times, however many files come.
VERSIONS = 8
MANIFEST = "manifest_sha256 string, machine_id string, captured_at string, place int, kind string, source_name string, file_sha256 string, relative_path string, raw_path string, bytes bigint, copy_state string"
VERSION = ["file_sha256", "relative_path", "raw_path", "machine_id", "source_name"]
_CATALOG = "name string, bucket int, version int"
_SESSION = ["session_key", "machine_id", "source_name", "source_session_id"]
_TOLD = ["parent_id", "line_no", "entry_type", "timestamp", "role", "raw_json", "text", "tool_name", "command", "files_json", "tool_calls", "tool_results", "model", "provider", "tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "cost", "participates_in_context", "first_kept", "assets"]
#: Tables of buckets, and those that each version adds a part to.
BUCKETED = ("accepted", "sessions", "entries", "messages", "redactions", "tool_invocations", "failure_episodes", "conflicts", "session_path_tokens", "entry_assets")
APPENDED = ("snapshots", "ingest_attempts", "files", "session_versions")
REPLACED = ("machines", "sources")
EMPTY = {"artifacts": f"{ARTIFACT}, text_preview string", "artifact_path_tokens": "artifact_id bigint, token string", "redaction_events": EVENT}

#: Rows of MANIFEST to entries: transcripts.ENTRY_COLUMNS and the rows' VERSION columns.
Opener = Callable[[DataFrame], DataFrame]


def opener(spark: SparkSession) -> Opener:
    """Reads transcripts at raw_path, each by the reader of its source."""
    def read(files: DataFrame) -> DataFrame:
        parts, bare = [], lambda c: F.regexp_replace(c, "^file:/+", "/")
        for source in (r.source_name for r in files.select("source_name").distinct().collect()):
            mine = files.where(F.col("source_name") == source)
            paths = [r.raw_path for r in mine.select("raw_path").distinct().collect()]  # FILES at most
            found = transcripts.read_lines(source, transcripts.lines_of(spark, paths))
            # the path of a row is that of a URL
            at = bare(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
            parts.append(found.withColumn("at", at).join(F.broadcast(mine.select(*VERSION, bare(F.col("raw_path")).alias("at"))), "at").drop("at"))
        return reduce(DataFrame.unionByName, parts)
    return read


def archive_opener(spark: SparkSession, archive: Archive) -> Opener:
    """Reads transcripts from an archive's blobs, each verified first; no content passes the driver.

    Versions of equal content share a blob and are read each under its own name.
    """
    def read(files: DataFrame) -> DataFrame:
        shas = [r.file_sha256 for r in files.select("file_sha256").distinct().collect()]  # FILES at most
        bad = archive.damaged(spark, shas).collect()
        if bad:
            raise ValueError(f"damaged blobs: {sorted(r.sha256 for r in bad)}")
        text = transcripts.numbered(spark.read.option("lineSep", "\n").text([f"{archive.root}/{archive.blob_key(s)}" for s in shas]))
        text = text.select(F.regexp_extract("path", r"([^/]+)\.gz$", 1).alias("file_sha256"), "line_no", "value")
        parts, version = [], F.to_json(F.array(*VERSION))
        for source in (r.source_name for r in files.select("source_name").distinct().collect()):
            mine = F.broadcast(files.where(F.col("source_name") == source).select(*VERSION, version.alias("version")))
            rows = text.join(mine, "file_sha256").select(F.col("version").alias("path"), F.col("raw_path").alias("named"), "line_no", "value")
            found = transcripts.read_lines(source, transcripts.named(rows, F.col("named")))
            parts.append(found.join(mine, F.col("path") == F.col("version")).drop("version"))
        return reduce(DataFrame.unionByName, parts)
    return read


@dataclass
class Report:
    """What an ingest did: manifests that were known, files whose version was known, files that were read."""

    version: int
    duplicates: int = 0
    known_files: int = 0
    read_files: int = 0
    buckets: int = 0


def _bucket() -> Column:
    return F.pmod(F.xxhash64("source_name", "source_session_id"), F.lit(BUCKETS)).cast("int")


#: What is searched for secrets: columns of an entry, and fields of its calls and results.
SURFACES = ("raw_json", "text", "command", "files_json", "tool_name")


def _redacted(rows: DataFrame) -> DataFrame:
    """Entries with every surface redacted, and `hits` (surface, pattern, count) of what was found in each column.

    All surfaces of an entry are one array, so that the patterns are one expression.
    """
    n, calls = len(SURFACES), F.size("tool_calls")
    every = F.concat(F.array(*SURFACES), F.transform("tool_calls", lambda c: c["command"]), F.transform("tool_calls", lambda c: c["files_json"]), F.transform("tool_results", lambda r: r["outcome_text"]))
    rows = rows.withColumn("clean", F.transform(every, lambda t: R.cleaned(t)))
    text = lambda i: F.get("clean", i)["text"]
    found = lambda i, name: F.transform(F.get("clean", F.lit(i))["hits"], lambda h: F.struct(F.lit(name).alias("surface"), h["name"].alias("pattern"), h["hits"].alias("count")))
    rows = rows.withColumn("hits", F.flatten(F.array(*[found(i, name) for i, name in enumerate(SURFACES)])))
    rows = rows.withColumn("tool_calls", F.transform("tool_calls", lambda c, i: c.withField("command", text(i + n)).withField("files_json", text(i + n + calls))))
    rows = rows.withColumn("tool_results", F.transform("tool_results", lambda r, i: r.withField("outcome_text", text(i + n + 2 * calls))))
    return rows.withColumns({name: text(F.lit(i)) for i, name in enumerate(SURFACES)}).drop("clean")


def judged(candidates: DataFrame) -> DataFrame:
    """Which of the entries (session_key, source_name, source_session_id, entry_id, entry_sha256, ord, held) stay.

    One row for each hash of an entry in a session. `first` and `first_session` are those of the earliest row of all
    machines; a row of another hash is a conflict, `cross` where its own session didn't hold the entry before it.
    """
    entry = Window.partitionBy("source_name", "source_session_id", "entry_id").orderBy("ord", "session_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = candidates.withColumn("first", F.first("entry_sha256").over(entry)).withColumn("first_session", F.first("session_key").over(entry))
    own = Window.partitionBy("session_key", "entry_id")
    rows = rows.withColumn("own", F.min(F.when(F.col("entry_sha256") == F.col("first"), F.col("ord"))).over(own))
    return rows.withColumn("stays", F.col("entry_sha256") == F.col("first")).withColumn("cross", F.col("own").isNull() | (F.col("own") > F.col("ord"))).drop("own")


class SnapshotWorkspace(Workspace):
    """Workspace below a root that manifests are ingested into; the questions are those of Workspace."""

    takes_artifacts = False

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        super().__init__(spark, root)
        self._at(version)

    def _at(self, version: int | None = None) -> None:
        self.version = versions.latest(self.spark, f"{self.root}/catalog") if version is None else version
        # no more rows than tables x BUCKETS, and a part of each appended table for each version
        rows = self.spark.read.schema(_CATALOG).parquet(f"{self.root}/catalog/v={self.version}").collect() if self.version else []
        self.parts: dict[str, dict[int, int]] = {}
        for r in rows:  # a table without rows is listed by bucket -1
            self.parts.setdefault(r.name, {}).update({r.bucket: r.version} if r.bucket >= 0 else {})

    def table(self, name: str) -> DataFrame:
        if name == "images":  # one row for each content, as its first mention by key tells it
            held = self.table("entry_assets").where("bytes > 0")
            first = held.groupBy("asset_sha256").agg(F.min(F.struct(*merge.ENTRY, "prompt_order", "source_name", "mime_type", "bytes", "width", "height")).alias("x"))
            return first.select(F.col("asset_sha256").alias("image_sha256"), "x.source_name", "x.mime_type", "x.bytes", "x.width", "x.height", images.ending(F.col("x.mime_type")).alias("ext"))
        if name in EMPTY:
            return self.spark.createDataFrame([], EMPTY[name])
        paths = [f"{self.root}/{name}/v={v}/bucket={b}" for b, v in sorted(self.parts.get(name, {}).items())]
        return self.spark.read.schema(self._schema(name)).parquet(*[f"{self.root}/{name}/none", *paths])

    def _schema(self, name: str):
        return self.spark.read.parquet(f"{self.root}/{name}/none").schema

    def buckets_of(self, name: str, buckets: list[int]) -> DataFrame:
        paths = [f"{self.root}/{name}/v={v}/bucket={b}" for b, v in sorted(self.parts.get(name, {}).items()) if b in buckets]
        return self.spark.read.schema(self._schema(name)).parquet(*[f"{self.root}/{name}/none", *paths])

    def _index(self, name: str) -> segments.Segments:
        return segments.open_segments(self.spark, f"{self.root}/{name}", self.parts.get(name, {}).get(0, 0))

    def _indexed(self, name: str) -> DataFrame:
        index = self._index(name)
        return index.ids().select("id") if index.live else self.spark.createDataFrame([], "id string" if name == "fts_messages" else "id bigint")

    def search(self, query: str, limit: int = search.DEFAULT_LIMIT, path_token: str = "", **facets: str) -> DataFrame:
        return search.find(self._index("fts_messages"), self.joined(), query, limit, self.table("session_path_tokens"), path_token, **facets)

    def conflicts(self) -> DataFrame:
        """(conflict_id, session_key, entry_id, first_sha, second_sha, kind, other_session_key, manifest_sha256); an id is a hash of its row's keys."""
        return self.table("conflicts").withColumn("conflict_id", F.xxhash64("session_key", "entry_id", "second_sha", "manifest_sha256"))

    # -- writing -----------------------------------------------------------------------------------------------------

    def _names(self, path: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []

    def _put(self, name: str, rows: DataFrame, bucket: Column) -> list[int]:
        """Write the next version of a table's buckets; returns the buckets that have rows."""
        path = f"{self.root}/{name}"
        if name not in self.parts:  # what a reader takes the schema from
            self.spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/none")
        by = ["bucket", "session_key"] if name in BUCKETED else ["bucket"]
        dealt = ["bucket", F.pmod(F.xxhash64("session_key"), F.lit(SPREAD))] if name in BUCKETED else ["bucket"]
        spread = rows.withColumn("bucket", bucket).repartition(*dealt).sortWithinPartitions(*by)
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={self.version + 1}")
        return [int(n.removeprefix("bucket=")) for n in self._names(f"{path}/v={self.version + 1}") if n.startswith("bucket=")]

    def _put_all(self, tables: dict[str, tuple[DataFrame, Column]]) -> dict[str, list[int]]:
        """Write several tables side by side."""
        with ThreadPoolExecutor(len(tables)) as pool:
            done = {name: pool.submit(self._put, name, *what) for name, what in tables.items()}
            return {name: found.result() for name, found in done.items()}

    def _new(self, name: str) -> DataFrame:
        """The buckets of the next version that are written already."""
        return self.spark.read.schema(self._schema(name)).parquet(f"{self.root}/{name}/v={self.version + 1}").drop("bucket")

    def _or_none(self, name: str, schema: str) -> DataFrame:
        return self.table(name) if name in self.parts else self.spark.createDataFrame([], schema)

    def ingest_snapshots(self, manifests: DataFrame, open_files: Opener | None = None, now: str = "") -> Report:
        """Take in manifests (MANIFEST), in order of the time of capture; a version for each FILES new transcripts, VERSIONS at most.

        The result is that of taking them one by one. A manifest that is known is noted as an attempt, nothing more.
        An empty table of manifests does nothing.
        """
        if manifests.isEmpty():
            return Report(self.version)
        stamps = manifests.groupBy("manifest_sha256", "machine_id").agg(F.min("captured_at").alias("captured_at"))
        seen = self._or_none("snapshots", "manifest_sha256 string").select("manifest_sha256", F.lit(1).alias("duplicate"))
        attempts = stamps.join(seen, "manifest_sha256", "left").select("manifest_sha256", "machine_id", "captured_at", F.coalesce("duplicate", F.lit(0)).alias("duplicate"), F.lit(now).alias("ingested_at"))
        new = manifests.join(attempts.where("duplicate = 0").select("manifest_sha256"), "manifest_sha256", "left_semi")
        wanted = new.where("kind = 'session'")
        keys = ", ".join(f"{c} string" for c in [*VERSION, "session_key"])
        known = self._or_none("session_versions", keys).groupBy(*VERSION).agg(F.min("session_key").alias("session_key"))
        # of a version that several of the manifests name, the earliest is read
        order = F.struct("captured_at", "manifest_sha256", "place")
        unknown = wanted.join(known.select(*VERSION), VERSION, "left_anti").groupBy(*VERSION).agg(F.min(order).alias("seen"))
        count = unknown.count()
        report = Report(self.version, attempts.where("duplicate = 1").count(), wanted.select(*VERSION).distinct().count() - count, count)
        open_files = open_files or opener(self.spark)
        pieces = 1 if getattr(open_files, "any_number", False) else max(1, -(-count // FILES))
        rounds = min(pieces, VERSIONS)
        # later rounds hold later files, so that the first writer is the same; the rows are names of files
        dealt = unknown.withColumn("part", F.lit(0) if pieces == 1 else F.ntile(pieces).over(Window.orderBy("seen", *VERSION)) - 1)
        for i in range(rounds):
            put, noted = {}, wanted.join(known, VERSION)
            if count:
                own = range(i * pieces // rounds, (i + 1) * pieces // rounds)
                files = dealt.where(F.col("part").between(own[0], own[-1])).drop("part")
                each = [files] if len(own) == 1 else [dealt.where(F.col("part") == n).drop("part") for n in own]
                # names of FILES files are few; where the opener takes any number, they may be many
                hinted = F.broadcast if count <= FILES * pieces else lambda rows: rows
                put = self._entries([open_files(f.select(*VERSION)).join(hinted(f), VERSION) for f in each])
                noted = noted.where(F.lit(i == rounds - 1)).unionByName(wanted.join(files.select(*VERSION), VERSION).join(self._read_keys(), VERSION, "left").withColumn("session_key", F.coalesce("session_key", _own_key())).select(*noted.columns))
            parts = {"session_versions": noted.select("session_key", *VERSION, "manifest_sha256", F.col("captured_at").alias("observed_at"), "copy_state")}
            if i == rounds - 1:
                parts |= self._notes(new, attempts)
            put |= self._put_all({name: (rows, F.lit(0 if name in REPLACED else self.version + 1)) for name, rows in parts.items()})
            self._publish(put)
            report.buckets += len(put.get("accepted", []))
        report.version = self.version
        return report

    def plan(self, archive: Archive) -> DataFrame:
        """What bringing the archive's latest snapshots here would take (skein.operators.merge.download_plan)."""
        latest = archive.manifests(self.spark).withColumn("sha256", F.col("file_sha256"))
        here = self._or_none("snapshots", "manifest_sha256 string, machine_id string").select("machine_id", "manifest_sha256")
        # a machine is current if its latest snapshot is among those that came here
        mine = here.join(latest.select("machine_id", F.col("manifest_sha256").alias("last")).distinct(), "machine_id")
        mine = mine.groupBy("machine_id").agg(F.max(F.when(F.col("manifest_sha256") == F.col("last"), F.col("last"))).alias("same"), F.min("manifest_sha256").alias("any"))
        return merge.download_plan(latest, mine.select("machine_id", F.coalesce("same", "any").alias("manifest_sha256")), self._or_none("files", "file_sha256 string").select(F.col("file_sha256").alias("sha256")))

    def materialise(self, archive: Archive, now: str = "") -> Report:
        """Bring the archive's latest snapshots of all machines here."""
        return self.ingest_snapshots(archive.manifests(self.spark), archive_opener(self.spark, archive), now)

    def _notes(self, new: DataFrame, attempts: DataFrame) -> dict[str, DataFrame]:
        """Parts and new states of the tables that tell of snapshots, machines, sources and files."""
        first = attempts.where("duplicate = 0")
        machines = first.select("machine_id", F.col("captured_at").alias("first_seen_at"), F.col("captured_at").alias("last_seen_at"))
        machines = self._or_none("machines", "machine_id string, first_seen_at string, last_seen_at string").unionByName(machines)
        sources = self._or_none("sources", "source_name string").unionByName(new.where("source_name <> ''").select("source_name"))
        files = new.groupBy("file_sha256").agg(F.min("kind").alias("kind"), F.max("bytes").alias("bytes"), F.min_by("manifest_sha256", F.struct("captured_at", "manifest_sha256")).alias("first_seen_manifest_sha256"))
        return {"snapshots": first.select("manifest_sha256", "machine_id", "captured_at", "ingested_at"), "ingest_attempts": attempts.select("manifest_sha256", "ingested_at", "duplicate"),
                "machines": machines.groupBy("machine_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")), "sources": sources.distinct(),
                "files": files.join(self._or_none("files", "file_sha256 string").select("file_sha256"), "file_sha256", "left_anti")}

    def _read_path(self) -> str:
        return f"{self.root}/read/v={self.version + 1}"

    def _read_rows(self) -> DataFrame:
        """The states of entries that were read for the next version."""
        together = f"{self._read_path()}/all"
        return self.spark.read.parquet(together if self._names(together) else self._read_path())

    def _read_keys(self) -> DataFrame:
        """The session of each file version that was read."""
        return self._read_rows().select("session_key", F.explode("files").alias("f")).select("f.*", "session_key").groupBy(*VERSION).agg(F.min("session_key").alias("session_key"))

    def _entries(self, reads: list[DataFrame]) -> dict[str, list[int]]:
        """Write the buckets that new transcripts, read part by part, touch, in all tables of buckets."""
        seen, one = F.col("seen"), ["session_key", "entry_id", "entry_sha256"]
        order = F.struct(F.lit(self.version + 1).alias("version"), seen["captured_at"].alias("captured_at"), seen["manifest_sha256"].alias("manifest_sha256"), seen["place"].alias("place"), F.col("line_no").cast("int").alias("line_no"))
        columns = [*_SESSION[1:], *_TOLD, "is_subagent", "cwd", "hits", "ord", "bucket"]

        def states(every: DataFrame, files: Column) -> DataFrame:
            return every.groupBy(*one).agg(F.min_by(F.struct(*columns), "ord").alias("x"), files.alias("files")).select(*one, "x.*", "files")

        # one row for each state of an entry, redacted: what is written here goes when the version is published
        path = self._read_path() if len(reads) == 1 else f"{self._read_path()}/parts"
        for n, read in enumerate(reads):
            every = read.withColumn("session_key", S.session_key(F.col("machine_id"), F.col("source_name"), F.col("source_session_id")))
            every = _redacted(every.withColumn("ord", order).withColumn("bucket", _bucket()))
            states(every, F.collect_set(F.struct(*VERSION))).write.mode("append" if n else "overwrite").parquet(path)
        if len(reads) > 1:
            states(self.spark.read.parquet(path), F.array_distinct(F.flatten(F.collect_list("files")))).write.mode("overwrite").parquet(f"{self._read_path()}/all")
        fresh = self._read_rows().drop("files")
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # BUCKETS at most
        old = self.buckets_of("accepted", touched) if "accepted" in self.parts else fresh.where("false").drop("bucket")
        key = ["source_name", "source_session_id", "entry_id"]
        small = ["session_key", *key, "entry_sha256", "ord"]
        candidates = fresh.join(old.select(*one), one, "left_anti").select(*small, F.lit(False).alias("held"))
        rivals = old.select(*small, F.lit(True).alias("held")).join(candidates.select(*key).distinct(), key, "left_semi").select(*small, "held")
        verdict = judged(candidates.unionByName(rivals)).where("not held").select(*one, "first", "first_session", "stays", "cross")
        accepted = fresh.join(verdict.where("stays").select(*one), one, "left_semi").select(*fresh.columns).drop("bucket")
        refused = fresh.select(*one, *key[:2], "ord").join(verdict.where("not stays"), one)
        kind = F.when(F.col("cross"), "cross-machine").otherwise("same-session")
        conflicts = refused.select(*key[:2], "session_key", "entry_id", F.col("first").alias("first_sha"), F.col("entry_sha256").alias("second_sha"), kind.alias("kind"), F.when(F.col("cross"), F.col("first_session")).alias("other_session_key"), F.col("ord.manifest_sha256").alias("manifest_sha256"))
        put = self._put_all({"accepted": (old.select(*accepted.columns).unionByName(accepted), _bucket()), "conflicts": (self._held("conflicts", touched, conflicts), _bucket()), "sessions": (self._sessions(fresh, touched), _bucket())})
        # accepted entries never change, so that the index only grows
        said = accepted.select(F.concat_ws("\t", *merge.ENTRY).alias("id"), "text")
        with ThreadPoolExecutor(1) as pool:
            index = pool.submit(segments.add, self.spark, f"{self.root}/fts_messages", said, None, "id", version=self.parts.get("fts_messages", {}).get(0, 0))
            put |= self._put_all({name: (rows, _bucket()) for name, rows in self._derived().items()})
            put["failure_episodes"] = self._put("failure_episodes", self._episodes(), _bucket())
            self.search_version = index.result().version
        return put

    def _held(self, name: str, touched: list[int], rows: DataFrame) -> DataFrame:
        return self.buckets_of(name, touched).unionByName(rows) if name in self.parts else rows

    def _sessions(self, fresh: DataFrame, touched: list[int]) -> DataFrame:
        """The sessions of the touched buckets: the first folder by order of writing, the earliest time."""
        cwd = F.nullif("cwd", F.lit(""))
        rows = fresh.groupBy(*_SESSION).agg(F.min(F.when(cwd.isNotNull(), F.struct("ord", "cwd"))).alias("at"), F.min(F.nullif("timestamp", F.lit(""))).alias("started_at"), F.max(F.col("is_subagent").cast("int")).alias("is_subagent"))
        if "sessions" in self.parts:
            rows = rows.unionByName(self.buckets_of("sessions", touched).select(*_SESSION, "at", F.nullif("started_at", F.lit("")).alias("started_at"), "is_subagent"))
        rows = rows.groupBy(*_SESSION).agg(F.min("at").alias("at"), F.coalesce(F.min("started_at"), F.lit("")).alias("started_at"), F.max("is_subagent").alias("is_subagent"))
        rows = rows.withColumn("raw_cwd", F.coalesce("at.cwd", F.lit("")))
        return rows.select(*_SESSION, "at", "started_at", "is_subagent", "raw_cwd", S.project_key(F.col("raw_cwd")).alias("project_key"), F.lit(LEVEL).alias("redaction_level"))

    def _derived(self) -> dict[str, DataFrame]:
        """The tables that follow from the accepted entries and sessions of the next version."""
        names, sessions = ["source_name", "source_session_id"], self._new("sessions")
        told = self._new("accepted").join(sessions.select("session_key", "project_key"), "session_key")
        head, call = [*names, *merge.ENTRY], ["session_key", "entry_id", "line_no", "timestamp", "project_key"]
        calls = told.select(*call, F.explode("tool_calls").alias("c")).select(*call, F.col("c.ordinal"), F.col("c.id").alias("call_id"), "c.tool_name", "c.command", "c.files_json")
        results = told.select("session_key", "line_no", F.explode("tool_results").alias("r")).select("session_key", "line_no", "r.ordinal", "r.for_id", "r.is_error", "r.outcome_text", "r.exit_code")
        return {
            "entries": told.select(*head, "parent_id", "line_no", "entry_type", "timestamp", "role", "entry_sha256", "raw_json", "participates_in_context", "first_kept", "project_key"),
            "messages": told.select(*head, "role", "text", "tool_name", "command", "model", "provider", "tokens", "cost", "participates_in_context", "first_kept"),
            "entry_assets": told.select(*head, F.inline("assets")),
            "redactions": told.select(*head, F.inline("hits")),
            "tool_invocations": pairing.tool_invocations(calls, results, index_output=True).join(sessions.select("session_key", *names), "session_key"),
            "session_path_tokens": sessions.select("session_key", *names, F.explode(S.path_tokens(F.col("raw_cwd"))).alias("token"))}

    def _episodes(self) -> DataFrame:
        names = ["source_name", "source_session_id"]
        return episodes.assemble(self._new("tool_invocations").drop(*names)).join(self._new("sessions").select("session_key", *names), "session_key")

    def _publish(self, put: dict[str, list[int]]) -> None:
        """Make the next version visible, then drop the entries as they were read."""
        following, parts = self.version + 1, {name: dict(held) for name, held in self.parts.items()}
        for name, buckets in put.items():
            parts.setdefault(name, {}).update({b: following for b in buckets})
        if "accepted" in put:
            parts["fts_messages"] = {0: self.search_version}
        rows = [(name, b, v) for name, held in parts.items() for b, v in held.items()] + [(name, -1, 0) for name, held in parts.items() if not held]
        versions.publish(self.spark.createDataFrame(rows, _CATALOG), f"{self.root}/catalog", following)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._read_path())
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self._at(following)


def _own_key() -> Column:
    """The session of a transcript without entries, by its file's name."""
    name = F.regexp_replace(F.element_at(F.split("raw_path", "/"), -1), r"\.jsonl$", "")
    return S.session_key(F.col("machine_id"), F.col("source_name"), name)
