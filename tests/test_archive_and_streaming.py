import hashlib
import sqlite3

import pytest

from skein.sources import archive, opencode_db, transcripts
from skein.streaming import incremental


def _manifest(machine, files, when="t"):
    return {"machine_id": machine, "captured_at": when, "files": [{"relative_path": p, "sha256": hashlib.sha256(d).hexdigest(), "bytes": len(d)} for p, d in files.items()]}


def test_archive_push_reuse_and_verify(spark, tmp_path):
    a = archive.Archive(str(tmp_path / "a"))
    files = {"x/1": b"one", "x/2": b"two"}
    blobs = {hashlib.sha256(d).hexdigest(): d for d in files.values()}
    first = a.push(_manifest("m1", files), blobs)
    assert a.push(_manifest("m1", files, "later"), {}) == first
    with pytest.raises(ValueError):
        a.push(_manifest("m1", {"../x": b"one"}), blobs)
    second = a.push(_manifest("m1", {"x/1": b"one"}), {})
    assert a.vector() == {"m1": second} and second != first
    assert a.files(spark).count() == 1
    sha = hashlib.sha256(b"one").hexdigest()
    (tmp_path / "a" / a.blob_key(sha)).write_bytes(b"bad")
    assert {(r.check, r.sha256) for r in a.verify(spark).collect()} == {("damaged", sha), ("orphan", hashlib.sha256(b"two").hexdigest())}


def test_two_writers_publish_one_after_the_other(tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    a = archive.Archive(str(tmp_path / "a"))
    data = {f"f{i}": f"content {i}".encode() for i in range(9)}
    push = lambda i: a.push(_manifest("m", {"f": data[f"f{i}"]}), {hashlib.sha256(data[f"f{i}"]).hexdigest(): data[f"f{i}"]})
    with ThreadPoolExecutor(8) as pool:
        shas = list(pool.map(push, range(8)))
    versions = sorted((tmp_path / "a" / archive.LATEST / "m").iterdir())
    assert sorted(v.read_text() for v in versions) == sorted(shas) and len(set(shas)) == 8
    assert a.latest("m") == versions[-1].read_text()
    # a writer that has seen an old version does not overwrite a newer one
    seen = iter([7, 8])
    monkeypatch.setattr(archive.Archive, "_version", lambda self, machine, real=archive.Archive._version: next(seen, None) or real(self, machine))
    assert push(8) == a.latest("m") and len(list((tmp_path / "a" / archive.LATEST / "m").iterdir())) == 9


def test_verified_reads(tmp_path):
    a = archive.Archive(str(tmp_path / "a"))
    sha = hashlib.sha256(b"some content").hexdigest()
    a.push(_manifest("m", {"f": b"some content"}), {sha: b"some content"})
    assert a.read(sha) == b"some content"
    with pytest.raises(ValueError):
        a.read(sha, most=4)
    path = tmp_path / "a" / a.blob_key(sha)
    path.write_bytes(path.read_bytes()[:-3])
    with pytest.raises(ValueError):
        a.read(sha)


def test_database_export(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "opencode.db")
    db.executescript("create table session(id text, data text); create table message(id text, session_id text, data text); create table part(id text, message_id text, session_id text, data text);")
    db.execute("insert into session values('s1', '{\"directory\": \"/w\"}')")
    db.execute("insert into message values('m1', 's1', '{\"role\": \"user\"}')")
    db.execute("insert into part values('p1', 'm1', 's1', '{\"type\": \"text\", \"text\": \"needle\"}')")
    db.commit()
    spark.dataSource.register(opencode_db.OpenCodeDatabase)
    rows = spark.read.format("opencode_db").option("paths", str(tmp_path / "opencode.db")).load()
    r = transcripts.opencode_entries(rows).first()
    assert (r.entry_id, r.role, r.text, r.cwd) == ("m1", "user", "needle", "/w")


def test_incremental_equals_full(spark, tmp_path):
    from tests.test_episodes import SCHEMA, _rows

    at = lambda n: f"2026-01-01T00:{n:02d}:00Z"
    every = _rows(spark, [("a", "f", 1, at(0)), ("b", "f", 1, at(0)), ("a", "g", 0, at(1)), ("a", "f", 0, at(2)), ("b", "f", 0, at(59))])
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [every.where("line_no < 2"), every.where("line_no between 1 and 3"), every.where("line_no > 3")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        incremental.follow(spark, source, target, SCHEMA)
    got = {(r.session_key, r.resolved, tuple(r.resolution_path or ())) for r in incremental.current(spark, target).collect()}
    assert got == {("a", 1, ("g", "f")), ("b", 0, ())}
    assert spark.read.parquet(f"{target}/invocations").count() == 5
