"""Workspace relations from the supplied tables, so that every operator has whole tables to run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import search
from skein.operators.lineage import new_path

_indexes: dict[tuple, search.Index] = {}


def state(spark: SparkSession, path: str) -> tuple:
    """What tells whether a table's files are as they were: their names, lengths and times."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in store.listStatus(where)))


def index(spark: SparkSession, sf_dir: str, name: str) -> search.Index:
    """The stored postings of documents or messages; written at the session's first use of them, and when their table has changed."""
    source = "conversations" if name == "messages" else name
    key = (spark.sparkContext.applicationId, sf_dir, name, state(spark, f"{sf_dir}/{source}.parquet"))
    if key not in _indexes:
        rows = messages(spark, sf_dir) if name == "messages" else table(spark, sf_dir, name).withColumn("id", F.col("doc_id"))
        _indexes[key] = search.build(rows, "id", new_path(spark, f"index-{name}"))
    return _indexes[key]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages joined with their entries and sessions; a conversation is a session."""
    c, conv = table(spark, sf_dir, "conversations"), F.col("conv_id")
    return c.select(
        (conv * 1000000 + F.col("turn")).alias("id"), F.concat(F.lit("c"), conv).alias("session_key"), F.concat(F.lit("t"), F.col("turn")).alias("entry_id"), "role", "text",
        F.concat(F.lit("2026-01-"), F.lpad((conv % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("timestamp"), F.concat(F.lit("s"), conv % 3).alias("source_name"), F.concat(F.lit("m"), conv % 4).alias("machine_id"),
        F.concat(F.lit("/Work/p_"), conv % 10, F.lit("/src")).alias("raw_path"), F.concat(F.lit("p"), conv % 10).alias("project_key"))


MESSAGES_SQL = """messages as (
  select conv_id * 1000000 + turn id, concat('c', conv_id) session_key, concat('t', turn) entry_id, role, text, concat('2026-01-', lpad((conv_id % 28 + 1)::varchar, 2, '0'), 'T00:00:00Z') "timestamp",
    concat('s', conv_id % 3) source_name, concat('m', conv_id % 4) machine_id, concat('/Work/p_', conv_id % 10, '/src') raw_path, concat('p', conv_id % 10) project_key from conversations)"""


def artifact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as artifacts of snapshots b0 to b6 and of sessions, some of which are not there."""
    d, doc = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        doc.alias("id"), doc.alias("artifact_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("artifact_sha256"), F.col("source").alias("source_name"), F.concat(F.lit("m"), doc % 4).alias("machine_id"),
        F.concat(F.lit("b"), doc % 7).alias("manifest_sha256"), F.when(doc % 5 != 0, F.concat(F.lit("c"), doc % 150)).alias("parent_session_key"), F.concat(F.lit("/Art/"), "lang", F.lit("/d_"), doc, F.lit(".txt")).alias("raw_path"), "text",
        F.substring("text", 1, 40).alias("text_preview"))


ARTIFACT_ROWS_SQL = """artifacts as (
  select doc_id id, sha256(coalesce(text, '')) sha, source source_name, concat('m', doc_id % 4) machine_id, concat('b', doc_id % 7) manifest, case when doc_id % 5 <> 0 then concat('c', doc_id % 150) end parent,
    '/Art/' || lang || '/d_' || doc_id || '.txt' raw_path, text from documents),
snapshots as (select concat('b', doc_id % 7) manifest, concat('2026-01-1', (min(doc_id) % 7)::varchar, 'T00:00:00Z') captured_at from documents where doc_id % 7 <> 6 group by 1)"""


def artifact_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    made = table(spark, sf_dir, "documents").where(doc % 7 != 6).groupBy(F.concat(F.lit("b"), doc % 7).alias("manifest_sha256"))
    return made.agg(F.concat(F.lit("2026-01-1"), F.min(doc) % 7, F.lit("T00:00:00Z")).alias("captured_at"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tool_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: a user is a session, an error event a failed call."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.col("event_id"))
    error = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("session_key"), F.concat(F.lit("m"), F.col("user_id") % 4).alias("machine_id"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("source_name"),
        F.concat(F.lit("p"), F.col("user_id") % 10).alias("project_key"), F.concat(F.lit("e"), F.col("event_id")).alias("entry_id"), F.col("event_id").alias("line_no"), F.lit(0).alias("ordinal"),
        F.concat(F.lit("t"), k % 3).alias("tool_name"), F.concat(F.lit("f"), k % 7).alias("command_family"), error.cast("int").alias("is_error"),
        F.when(error, F.concat(F.lit("exit_code:"), k % 5)).otherwise("").alias("error_signature"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))


INVOCATIONS_SQL = """inv as (
  select concat('u', user_id) session_key, concat('m', user_id % 4) machine_id, concat('s', user_id % 3) source_name, concat('p', user_id % 10) project_key,
    concat('e', event_id) entry_id, event_id line_no, 0 ordinal, concat('t', k % 3) tool_name, concat('f', k % 7) command_family, (event_type = 'error')::int is_error,
    case when event_type = 'error' then concat('exit_code:', k % 5) else '' end error_signature, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') "timestamp", date_trunc('second', ts) t
  from (select *, coalesce(cast(json_extract_string(props, '$.k') as bigint), event_id) k from events))"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as entries; each one's parent is the turn before."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("session_key"), F.concat(F.lit("t"), F.col("turn")).alias("entry_id"), F.when(F.col("turn") > 0, F.concat(F.lit("t"), F.col("turn") - 1)).otherwise("").alias("parent_id"),
        (F.col("turn") + 1).alias("line_no"), F.when(F.col("turn") % 5 == 3, "compaction").otherwise("message").alias("entry_type"), "role", "text",
        F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 2), 0).otherwise(1).alias("participates_in_context"),
        F.when(F.col("turn") % 5 == 3, F.concat(F.lit("t"), F.greatest(F.col("turn") - 2, F.lit(0)))).otherwise("").alias("first_kept"))


ENTRIES_SQL = """entries as (
  select concat('c', conv_id) session_key, concat('t', turn) entry_id, case when turn > 0 then concat('t', turn - 1) else '' end parent_id, turn + 1 line_no,
    case when turn % 5 = 3 then 'compaction' else 'message' end entry_type, role, text, case when conv_id % 7 = 0 and turn = 2 then 0 else 1 end participates_in_context,
    case when turn % 5 = 3 then concat('t', greatest(turn - 2, 0)) else '' end first_kept from conversations)"""


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), F.col("source").alias("machine_id"), F.col("lang").alias("source_name"), "text", F.sha2("text", 256).alias("artifact_sha256"))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of each machine's files: the older lacks every fifth file and has others in an earlier state."""
    d = table(spark, sf_dir, "documents")
    new = d.select(F.lit("new").alias("manifest"), F.col("source").alias("machine_id"), F.concat(F.lit("f"), F.col("doc_id")).alias("relative_path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))
    old = d.where("doc_id % 5 <> 0").select(F.lit("old").alias("manifest"), F.col("source").alias("machine_id"), F.concat(F.lit("f"), F.col("doc_id")).alias("relative_path"),
        F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat(F.lit("x"), "text"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"), F.when(F.col("doc_id") % 7 == 0, F.octet_length("text") + 1).otherwise(F.octet_length("text")).cast("bigint").alias("bytes"))
    return new.unionByName(old)


MANIFESTS_SQL = """files as (
  select 'new' manifest, source machine_id, concat('f', doc_id) relative_path, sha256(text) sha256, octet_length(encode(text))::bigint bytes from documents
  union all
  select 'old', source, concat('f', doc_id), case when doc_id % 7 = 0 then sha256('x' || text) else sha256(text) end, (octet_length(encode(text)) + case when doc_id % 7 = 0 then 1 else 0 end)::bigint from documents where doc_id % 5 <> 0)"""
