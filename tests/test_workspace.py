import json

from skein.plans.workspace import ARTIFACT, TABLES, Workspace, capture
from skein.sources import transcripts as T


def _write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, lines)) + "\n")


def _call(i, at, command, parent=""):
    return {"type": "assistant", "uuid": f"a{i}", "parentUuid": parent, "timestamp": at, "cwd": "/home/u/my-app", "message": {"role": "assistant", "content": [{"type": "text", "text": f"step {i} of the plan"}, {"type": "tool_use", "id": f"c{i}", "name": "Shell", "input": {"command": command}}]}}


def _result(i, at, error, text):
    return {"type": "user", "uuid": f"r{i}", "parentUuid": f"a{i}", "timestamp": at, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": f"c{i}", "is_error": error, "content": text}]}}


def test_transcripts_to_incidents(spark, tmp_path):
    at = lambda n: f"2026-02-03T10:{n:02d}:00Z"
    secret = "ghp_" + "Z9" * 12
    for s in ("one", "two"):
        _write(tmp_path / "in" / "claude-code" / f"{s}.jsonl", [
            _call(1, at(0), "cargo build --release"), _result(1, at(1), True, f"token {secret} refused at /src/x.rs:12"),
            _call(2, at(2), "rustup update stable", "r1"), _result(2, at(3), False, "ok"),
            _call(3, at(4), "cargo build --release", "r2"), _result(3, at(5), False, "done"), {"type": "user", "uuid": f"m{s}", "parentUuid": "r3", "timestamp": at(6), "message": {"role": "user", "content": "thanks, the needle is found"}}])
    _write(tmp_path / "in" / "pi" / "p.jsonl", [{"type": "session", "id": "pid", "cwd": "/w/app"}, {"id": "u", "type": "message", "timestamp": at(1), "message": {"role": "user", "content": "where is the needle"}}])
    w = Workspace(spark, str(tmp_path / "w"))
    read = [capture(T.read(spark, s, str(tmp_path / "in" / s)), "m1", s, "man") for s in ("claude-code", "pi")]
    arts = spark.createDataFrame([(7, "f" * 64, "pi", "m1", "man", "note", "", "", "/w/notes.md", f"a note with {secret}")], ARTIFACT)
    w.ingest(read, arts)

    counts = {r.name: r.n for r in w.status().collect()}
    assert set(TABLES) <= set(counts)
    assert (counts["sessions"], counts["entries"], counts["messages"], counts["tool_invocations"], counts["conflicts"], counts["redaction_hits"], counts["redaction_level:v1"]) == (3, 15, 15, 6, 0, 3, 3)
    assert {r["check"] for r in w.checks().collect()} >= {"orphan_messages", "missing_fts_artifacts", "unknown_redaction_levels"} and w.checks().count() == 11 and w.verify().count() == 0
    assert {r.pattern: r.hits for r in w.redactions_by_pattern().collect()} == {"github_token": 3}
    for name in TABLES[:17]:
        assert not [r for r in w.table(name).collect() if secret in str(r)], name

    got = w.incidents().collect()
    assert [(r.tool_name, r.command_family, r.episodes, r.resolved, r.sessions, r.state) for r in got] == [("Shell", "cargo build", 2, 2, 2, "resolved")]
    assert "<path>" in got[0].error_signature and secret.lower() not in got[0].error_signature
    assert [r.resolution_path for r in w.resolution_paths().collect()] == [["rustup update stable", "cargo build"]]
    found = w.search("needle", role="user").collect()
    assert sorted((r.source_name, r.entry_id) for r in found) == [("claude-code", "mone"), ("claude-code", "mtwo"), ("pi", "u")] and all("[needle]" in r.snippet for r in found)
    assert {r.source_name for r in w.search("needle", path_token="my-app").collect()} == {"claude-code"} and w.search("needle", project="app").count() == 1
    both = w.search_all("note").collect()
    assert [(r.role, r.ref, r.snippet) for r in both] == [("artifact", "artifact:v1:" + "f" * 64, "a [note] with [REDACTED:github_token]")]
    assert w.search_all("needle", role="user").count() == 3 and w.search_all("note", path_token="notes.md").count() == 1 and w.search_all("note", after="2026").count() == 0
    assert w.artifact(spark.createDataFrame([("f" * 64, "")], "artifact_sha256 string, parent_session_key string")).first().raw_path == "/w/notes.md"
    session = next(r.session_key for r in found if r.entry_id == "mone")
    leaf = spark.createDataFrame([(session, "mone")], "session_key string, entry_id string")
    assert [r.entry_id for r in w.branch(leaf).orderBy("depth").collect()] == ["mone", "r3", "a3", "r2", "a2", "r1", "a1"]
    assert [r.entry_id for r in w.live_context(leaf).orderBy("place").collect()] == ["a1", "r1", "a2", "r2", "a3", "r3", "mone"]
    assert [(r.step, r.command_family) for r in w.trajectory(session, "a3").collect()] == [(0, "cargo build"), (1, "rustup update stable"), (2, "cargo build")]
    assert {r.name: r.n for r in w.overview().collect()} == {"claude-code": 2, "pi": 1}
    # what breaks integrity is found by name
    w.table("entries").where("entry_id <> 'u'").write.mode("overwrite").parquet(f"{tmp_path}/fewer")
    spark.read.parquet(f"{tmp_path}/fewer").write.mode("overwrite").parquet(f"{w.root}/entries")
    assert {r["check"]: r.n for r in w.verify().collect()} == {"orphan_messages": 1}
