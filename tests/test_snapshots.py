"""Snapshot ingest: against a full load, a simulation row by row, and files; lines of files of any number of splits."""

import gzip
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import redaction as R
from skein.operators import health
from skein.plans import snapshots
from skein.plans.snapshots import MANIFEST, SnapshotWorkspace
from skein.sources import transcripts as T
from skein.sources.archive import Archive

SECRET = "ghp_" + "Q7" * 12


def _line(i, text, command=None, at="2026-01-01T00:00:00Z"):
    content = [{"type": "text", "text": text}] + ([{"type": "tool_use", "id": f"c{i}", "name": "Shell", "input": {"command": command}}] if command else [])
    return json.dumps({"type": "assistant", "uuid": f"e{i}", "timestamp": at, "cwd": "/w/my-app", "message": {"role": "assistant", "content": content}})


def _result(i, text, error):
    return json.dumps({"type": "user", "uuid": f"r{i}", "timestamp": "2026-01-01T00:00:09Z", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": f"c{i}", "is_error": error, "content": text}]}})


class Store:
    """Contents by hash, and how often they were opened."""

    def __init__(self, spark):
        self.spark, self.contents, self.opened = spark, {}, []

    def put(self, name, lines):
        self.contents[name] = lines
        return name

    def open(self, files):
        names = [(r.file_sha256, r.raw_path) for r in files.collect()]
        self.opened += [n for n, _ in names]
        rows = [(n, p.split("/")[-1].removesuffix(".jsonl"), False, i, x) for n, p in names for i, x in enumerate(self.contents[n], 1)]
        lines = self.spark.createDataFrame(rows, "path string, source_session_id string, is_subagent boolean, line_no int, raw string")
        return T.generic_entries(lines).join(files, F.col("path") == F.col("file_sha256"))


def _manifest(spark, name, machine, at, files):
    return spark.createDataFrame([(name, machine, at, i, "session", "claude-code", sha, f"{s}.jsonl", f"/in/{s}.jsonl", 1, "copied") for i, (s, sha) in enumerate(files)], MANIFEST)


def _state(w):
    def rows(name, *drop):
        df = w.table(name).drop(*drop)
        return sorted(map(str, df.select(sorted(df.columns)).collect()))
    return {name: rows(name, "ord", "at", "ingested_at") for name in (*snapshots.BUCKETED, "snapshots", "files", "session_versions", "machines", "sources")}


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """Three snapshots of two machines, taken one by one."""
    store = Store(spark)
    one = [_line(1, "first words", "make all"), _result(1, f"token {SECRET} refused", True)]
    two = [*one, _line(2, "second words", "make all"), _result(2, "fine", False)]
    changed = [_line(1, "other words", "make all"), *two[1:], _line(3, "third")]
    a, b, c, d = (store.put(f"sha-{n}", x) for n, x in (("a", one), ("b", two), ("c", changed), ("d", [_line(9, "alone here")])))
    days = [_manifest(spark, "man1", "m1", "2026-01-01", [("s", a), ("t", d)]), _manifest(spark, "man2", "m1", "2026-01-02", [("s", b), ("t", d)]), _manifest(spark, "man3", "m2", "2026-01-03", [("s", c)])]
    w = SnapshotWorkspace(spark, str(tmp_path_factory.mktemp("w") / "grown"))
    reports = [w.ingest_snapshots(day, store.open, str(i)) for i, day in enumerate(days)]
    return w, store, days, reports


def test_growing_equals_a_full_load(spark, history, tmp_path):
    w, store, days, reports = history
    assert [(r.version, r.known_files, r.read_files, r.buckets) for r in reports] == [(1, 0, 2, 2), (2, 1, 1, 1), (3, 0, 1, 1)]
    full = SnapshotWorkspace(spark, str(tmp_path / "full"))
    full.ingest_snapshots(days[2].unionByName(days[0]).unionByName(days[1]), store.open, "x")
    got, want = _state(w), _state(full)
    assert {n for n in got if got[n] != want[n]} == set()
    assert [(r.entry_id, r.kind) for r in w.conflicts().collect()] == [("e1", "cross-machine")]
    assert {r.machine_id: (r.first_seen_at, r.last_seen_at) for r in w.table("machines").collect()} == {"m1": ("2026-01-01", "2026-01-02"), "m2": ("2026-01-03", "2026-01-03")}
    assert w.verify().count() == 0 and {r.name: r.n for r in w.status().collect()}["entries"] == 9


def test_one_by_one_in_rounds(spark, history, tmp_path, monkeypatch):
    w, store, days, _ = history
    monkeypatch.setattr(snapshots, "FILES", 1)
    full = SnapshotWorkspace(spark, str(tmp_path / "rounds"))
    report = full.ingest_snapshots(days[0].unionByName(days[1]).unionByName(days[2]), store.open)
    assert (report.version, report.read_files) == (4, 4) and _state(full)["entries"] == _state(w)["entries"] and _state(full)["conflicts"] == _state(w)["conflicts"]


def test_known_snapshots_read_nothing(spark, history):
    w, store, days, _ = history
    opened, before, parts = len(store.opened), _state(w), {n: dict(w.parts[n]) for n in snapshots.BUCKETED}
    report = w.ingest_snapshots(days[0].unionByName(days[2]), store.open)
    assert (report.duplicates, report.read_files, report.buckets) == (2, 0, 0) and len(store.opened) == opened
    # the same files under another manifest: noted, not read
    report = w.ingest_snapshots(_manifest(spark, "man4", "m1", "2026-01-04", [("s", "sha-b"), ("t", "sha-d")]), store.open)
    assert (report.duplicates, report.known_files, report.read_files) == (0, 2, 0) and len(store.opened) == opened
    after = _state(w)
    assert all(before[n] == after[n] for n in snapshots.BUCKETED) and len(after["session_versions"]) == len(before["session_versions"]) + 2
    assert {n: w.parts[n] for n in parts} == parts
    assert sum(r.duplicate for r in w.table("ingest_attempts").collect()) == 2
    # a new file rewrites its bucket alone, and earlier versions stay as they were
    earlier = w.version
    store.put("sha-e", [_line(9, "alone here"), _line(10, "a needle")])
    w.ingest_snapshots(_manifest(spark, "man5", "m1", "2026-01-05", [("t", "sha-e")]), store.open)
    moved = {b for b, v in w.parts["accepted"].items() if parts["accepted"].get(b) != v}
    assert len(moved) == 1 and [r.entry_id for r in w.search("needle").collect()] == ["e10"]
    assert _state(SnapshotWorkspace(spark, w.root, earlier)) == after
    assert w.ingest_snapshots(days[0].limit(0), store.open).version == w.version


def test_no_secret_is_left(spark, history):
    w, *_ = history
    assert {r.pattern for r in w.table("redactions").collect()} == {"github_token"}
    for name in (*snapshots.BUCKETED, *snapshots.APPENDED):
        assert not [r for r in w.table(name).collect() if SECRET in str(r)], name
    assert not os.path.exists(f"{w.root}/read") or not os.listdir(f"{w.root}/read")


def test_verdicts_equal_a_simulation(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        machine, session, entry, sha = rng.randrange(3), rng.randrange(3), rng.randrange(12), rng.randrange(3)
        rows.append((f"{machine}/{session}", "src", str(session), f"e{entry}", f"h{sha}", i))
    first = {}
    for r in rows:
        first.setdefault(r[:5], r)
    held, want = {}, {}
    for key, source, session, entry, sha, _ in first.values():
        own, others = held.get((key, entry)), [h for (k, e), h in held.items() if e == entry and k != key and k.endswith(f"/{session}")]
        if own is not None or any(h != sha for h in others):
            want[key, entry, sha] = (False, own is None)
        else:
            held[key, entry] = sha
            want[key, entry, sha] = (True, None)
    df = spark.createDataFrame(list(first.values()), "session_key string, source_name string, source_session_id string, entry_id string, entry_sha256 string, ord int").withColumn("held", F.lit(False))
    got = {(r.session_key, r.entry_id, r.entry_sha256): (r.stays, None if r.stays else r.cross) for r in snapshots.judged(df).collect()}
    assert got == want and {v for v in want.values()} == {(True, None), (False, True), (False, False)}


def test_files_are_opened_by_their_paths(spark, tmp_path):
    folder = tmp_path / "with space+plus%25"
    folder.mkdir()
    for n in "st":
        (folder / f"{n}.jsonl").write_text(_line(1, f"text {n}") + "\n")
    day = spark.createDataFrame([("man", "m1", "2026-01-01", i, "session", "claude-code", f"sha{n}", f"{n}.jsonl", str(folder / f"{n}.jsonl"), 1, "copied") for i, n in enumerate("st")], MANIFEST)
    w = SnapshotWorkspace(spark, str(tmp_path / "w"))
    w.ingest_snapshots(day)
    assert sorted((r.source_session_id, r.text) for r in w.table("messages").collect()) == [("s", "text s"), ("t", "text t")]
    assert [r.state for r in w.incidents().collect()] == [] and w.overview().first().n == 2


def test_an_archive_is_materialised(spark, tmp_path):
    archive, contents = Archive(str(tmp_path / "archive")), {}

    def push(machine, at, files):
        for name, lines in files.items():
            raw = "\n".join(lines).encode()
            contents[hashlib.sha256(raw).hexdigest()] = raw
        rows = [{"relative_path": f"{n}.jsonl", "sha256": hashlib.sha256("\n".join(x).encode()).hexdigest(), "bytes": len("\n".join(x).encode()), "source": "claude-code"} for n, x in files.items()]
        return archive.push({"machine_id": machine, "captured_at": at, "files": rows}, contents)

    plan = lambda: {r.machine_id: (r.state, r.files, r.unknown_blobs, r.unknown_bytes) for r in w.plan(archive).collect()}
    one, two = [_line(1, "shared text")], [_line(2, "own text"), _line(3, "more text")]
    w = SnapshotWorkspace(spark, str(tmp_path / "w"))
    push("m1", "2026-01-01", {"s": one, "t": one})
    push("m2", "2026-01-01", {"s": one, "u": two})
    size = lambda x: len("\n".join(x).encode())
    assert plan() == {"m1": ("new", 2, 1, size(one)), "m2": ("new", 2, 1, size(two))}
    report = w.materialise(archive)
    assert report.read_files == 4 and plan() == {"m1": ("current", 2, 0, 0), "m2": ("current", 2, 0, 0)}
    sessions = w.table("sessions").select("session_key", "machine_id")
    assert sorted((r.machine_id, r.source_session_id, r.text) for r in w.table("messages").join(sessions, "session_key").collect()) == [("m1", "s", "shared text"), ("m1", "t", "shared text"), ("m2", "s", "shared text"), ("m2", "u", "more text"), ("m2", "u", "own text")]
    last = push("m2", "2026-01-02", {"s": one, "u": [*two, _line(4, "last text")]})
    assert plan()["m2"][:3] == ("behind", 2, 1) and plan()["m1"][0] == "current"
    report = w.materialise(archive)
    assert (report.duplicates, report.known_files, report.read_files) == (1, 1, 1) and w.table("messages").count() == 6
    # a damaged blob stops the next one, and nothing of it shows
    push("m1", "2026-01-03", {"s": [_line(8, "broken")], "t": one})
    bad = hashlib.sha256(_line(8, "broken").encode()).hexdigest()
    path = f"{archive.root}/{archive.blob_key(bad)}"
    with open(path, "wb") as f:
        f.write(gzip.compress(b"{}"))
    version = w.version
    with pytest.raises(ValueError, match=bad):
        w.materialise(archive)
    assert SnapshotWorkspace(spark, w.root).version == version and last


@pytest.mark.parametrize("split", [7, 64, 1000, 10 ** 6])
def test_lines_of_every_split(spark, tmp_path, split):
    rng = random.Random(split)
    texts = {"a": "", "b": "\n\n{}\n", "c": "".join("x" * rng.choice([0, 1, 5, 40, 300]) + rng.choice(["\n", "\r\n", "\n\n", " \t\n"]) for _ in range(80)), "d": "last line without end", "e": "y\rz\n" * 50}
    for name, text in texts.items():
        (tmp_path / f"{name}.jsonl").write_bytes(text.encode())
    keys = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = sorted((r.source_session_id, r.line_no, r.raw) for r in T.lines(spark, str(tmp_path)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted((name, i, x.rstrip("\r")) for name, text in texts.items() for i, x in enumerate(text.split("\n"), 1) if x.strip(" \t\r\n\x0b\x0c"))
    assert got == want


def test_cases_of_all_letters(spark):
    df = spark.createDataFrame([("paſſword=abcdefgh12345678", "toKen: abcdefgh12345678")], "a string, b string")
    r = df.select(R.redact(F.col("a")).alias("a"), R.redact(F.col("b")).alias("b")).first()
    assert "abcdefgh12345678" not in r.a and "abcdefgh12345678" not in r.b


def test_trace_cards(spark):
    long = "a[b]  c\n" + "é" * 100
    said = [("s", f"e{i:02d}", i * 10, "assistant" if i % 2 else "user", None if i == 0 else long if i == 2 else "x") for i in range(30)] + [("t", "e", 1, "assistant", "hi")]
    messages = spark.createDataFrame(said, "session_key string, entry_id string, line_no int, role string, text string")
    calls = spark.createDataFrame([("t", "Tool", "", 0), ("u", "", "fam", 1), ("u", "", "", 0)] + [("t", "", f"f{i}", 0) for i in range(9)], "session_key string, tool_name string, command_family string, is_error int")
    files = spark.createDataFrame([("v", "/a"), ("v", ""), ("s", "/b")], "session_key string, path string")
    got = {r.session_key: r for r in health.trace_cards(messages, calls, files).collect()}
    assert got["s"].timeline == ",".join(["user", "assistant"] * 9) and got["s"].title == "ab c " + "é" * 67 + "…"
    assert [got[k].status for k in "stuv"] == ["file match", "tool work", "failed tool", "file match"]
    assert (got["t"].commands, got["t"].title, got["u"].tools, got["u"].failures, got["v"].files) == ("Tool,f0,f1,f2,f3,f4", "Untitled trace", 2, 1, "/a")


def test_many_files_make_few_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FILES", 1)
    monkeypatch.setattr(snapshots, "VERSIONS", 2)
    store = Store(spark)
    one = [_line(1, "first words"), _line(2, "more")]
    for name, lines in (("a", one), ("b", [*one, _line(3, "third")]), ("c", [_line(1, "other words"), one[1]]), ("d", [_line(9, "alone here")])):
        store.put(name, lines)
    w = SnapshotWorkspace(spark, str(tmp_path / "few"))
    days = [_manifest(spark, "man1", "m1", "2026-01-01", [("s", "a"), ("t", "d")]), _manifest(spark, "man2", "m1", "2026-01-02", [("s", "b")]), _manifest(spark, "man3", "m2", "2026-01-03", [("s", "c")])]
    report = w.ingest_snapshots(days[0].unionByName(days[1]).unionByName(days[2]), store.open)
    # two files of one at a time to a version
    assert (report.version, report.read_files) == (2, 4) and sorted(store.opened) == ["a", "b", "c", "d"]
    assert sorted(r.entry_id for r in w.table("entries").collect()) == ["e1", "e2", "e2", "e3", "e9"]
    assert [(r.entry_id, r.kind) for r in w.conflicts().collect()] == [("e1", "cross-machine")]
    assert w.table("session_versions").count() == 4
