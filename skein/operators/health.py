"""Overview, status, integrity checks, sizes and trace cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalars import truncated_utf8

TOP_PROJECTS = 12


def counted(rows: DataFrame, column: str, empty: str = "(none)", limit: int | None = None) -> DataFrame:
    """(name, n): rows for each value, most first, ties by name."""
    name = F.when(F.coalesce(column, F.lit("")) == "", empty).otherwise(F.col(column))
    out = rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")
    return out.limit(limit) if limit else out


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table."""
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, d in sorted(tables.items())])


def redactions_by_pattern(*events: DataFrame) -> DataFrame:
    """(pattern, hits) over several tables of hits."""
    return reduce(DataFrame.unionByName, [e.select("pattern", "hits") for e in events]).groupBy("pattern").agg(F.sum("hits").cast("bigint").alias("hits"))


def orphan_check(name: str, rows: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """(check, n): rows without a parent; an equal-key anti join."""
    return rows.join(parents.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")


def verify(checks: list[DataFrame]) -> DataFrame:
    """The checks that found something."""
    return reduce(DataFrame.unionByName, checks).where("n > 0")


def event_orphans(events: DataFrame, subjects: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Events (subject_kind, subject_id) without their subject; one anti join for each kind instead of an OR."""
    parts = [events.where(F.col("subject_kind") == kind).join(rows.select(F.col(key).cast("string").alias("subject_id")).distinct(), "subject_id", "left_anti") for kind, (rows, key) in sorted(subjects.items())]
    return reduce(DataFrame.unionByName, parts)


def sizes(blobs: DataFrame) -> DataFrame:
    """(class, files, bytes) of distinct blobs by the first letter of their hash's class."""
    return blobs.groupBy(F.substring("sha256", 1, 1).alias("class")).agg(F.count("*").alias("files"), F.sum("bytes").cast("bigint").alias("bytes"))


# Messages of a card's timeline, commands and files of a card, bytes of its title, and its states.
TIMELINE, LISTED, TITLE_BYTES = 18, 6, 140
UNTITLED = "Untitled trace"
STATES = ("failed tool", "tool work", "file match", "conversation")


def _first(rows: DataFrame, most: int, order: list[str], shown: str, name: str) -> DataFrame:
    """(session_key, name): `shown` of the first rows of each session, comma-joined; no more than `most` are gathered."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("session_key").orderBy(*order))).where(F.col("place") <= most)
    return placed.groupBy("session_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", shown))), lambda x: x[shown]), ",").alias(name))


def _title(text: Column) -> Column:
    """A text on one line without brackets, at most TITLE_BYTES of it."""
    line = F.trim(F.regexp_replace(F.translate(text, "[]", ""), r"\s+", " "))
    return F.when(F.octet_length(line) > TITLE_BYTES, F.concat(F.trim(truncated_utf8(line, TITLE_BYTES)), F.lit("…"))).otherwise(line)


def trace_cards(messages: DataFrame, invocations: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """A card for each session: messages, user messages, title and the roles of its first messages.

    messages: (session_key, entry_id, line_no, role, text). With invocations (session_key, tool_name, command_family,
    is_error) and files (session_key, path) also their counts, failures, first commands and files by name, and a
    state: failures go before calls, calls before files, files before talk.
    """
    said = (F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    title = F.min_by("text", F.when(said, F.struct("line_no", "entry_id")))
    cards = messages.groupBy("session_key").agg(F.count("*").alias("messages"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).cast("bigint").alias("user_messages"), title.alias("title"))
    cards = cards.withColumn("title", F.coalesce(F.nullif(_title(F.col("title")), F.lit("")), F.lit(UNTITLED)))
    cards = cards.join(_first(messages.select("session_key", "line_no", "entry_id", "role"), TIMELINE, ["line_no", "entry_id"], "role", "timeline"), "session_key")
    if invocations is None:
        return cards
    command = F.coalesce(F.nullif("command_family", F.lit("")), F.nullif("tool_name", F.lit("")))
    tools = invocations.groupBy("session_key").agg(F.count("*").alias("tools"), F.sum(F.when(F.col("is_error") != 0, 1).otherwise(0)).cast("bigint").alias("failures"))
    commands = _first(invocations.select("session_key", command.alias("command")).where("command is not null").distinct(), LISTED, ["command"], "command", "commands")
    paths = messages.select("session_key").limit(0).withColumn("path", F.lit("")) if files is None else files.select("session_key", "path").where("path <> ''").distinct()
    shown = _first(paths, LISTED, ["path"], "path", "files")
    out = cards.join(tools, "session_key", "full_outer").join(commands, "session_key", "left").join(shown, "session_key", "full_outer")
    out = out.na.fill(0, ["messages", "user_messages", "tools", "failures"]).na.fill("", ["timeline", "commands", "files"]).na.fill(UNTITLED, ["title"])
    return out.withColumn("status", F.when(F.col("failures") > 0, STATES[0]).when(F.col("tools") > 0, STATES[1]).when(F.col("files") != "", STATES[2]).otherwise(STATES[3]))
