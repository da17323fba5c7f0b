"""Sessions, messages and parts of an agent's SQLite database, as the JSON lines that the readers take.

The database is a file on one machine, so it is read by one task for each file: a Python data source.
"""

from __future__ import annotations

import hashlib
import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, source_session_id string, is_subagent boolean, line_no int, raw string"


def _embedded(value):
    """JSON text in a column as its value; anything else as it is."""
    if isinstance(value, str) and value[:1] in "{[":
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value.hex() if isinstance(value, bytes) else value


def _rows(db: sqlite3.Connection, table: str, where: str, *args) -> Iterator[dict]:
    for row in db.execute(f"select * from {table} {where} order by id", args):  # names are fixed, values are bound
        yield {k: _embedded(row[k]) for k in row.keys()}


def _key(db: sqlite3.Connection, table: str, *names: str) -> str:
    have = {r[1] for r in db.execute(f"pragma table_info({table})")}
    return next(n for n in names if n in have)


def export(path: str) -> Iterator[tuple]:
    """Lines of each session: itself, then its messages with their parts, all by id."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    db.row_factory = sqlite3.Row
    try:
        if db.execute("pragma quick_check").fetchone()[0] != "ok":
            raise ValueError(f"{path} is damaged")
        of_message, of_part = _key(db, "message", "session_id", "sessionID"), _key(db, "part", "message_id", "messageID")
        space = "db-" + hashlib.sha256(path.encode()).hexdigest()[:12]
        for session in _rows(db, "session", ""):
            lines = [{"type": "session", "id": session["id"], "row": session}]
            for message in _rows(db, "message", f"where {of_message} = ?", session["id"]):
                lines.append({"type": "message", "id": message["id"], "row": message, "parts": list(_rows(db, "part", f"where {of_part} = ?", message["id"]))})
            for n, line in enumerate(lines, 1):
                yield f"{path}#{session['id']}", f"{space}/{session['id']}", False, n, json.dumps(line, ensure_ascii=False)
    finally:
        db.close()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        yield from export(partition.path)


class OpenCodeDatabase(DataSource):
    """spark.dataSource.register(OpenCodeDatabase); spark.read.format("opencode_db").option("paths", "a.db,b.db")."""

    @classmethod
    def name(cls):
        return "opencode_db"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader([p for p in self.options.get("paths", "").split(",") if p])
