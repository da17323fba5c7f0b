"""Tool calls and their results against a walk in plain Python, and how often their lines are parsed."""

import random

from skein.operators import pairing
from skein.plans import catalog
from skein.sources import transcripts as T

CALL = "session_key string, entry_id string, line_no int, ordinal int, call_id string, tool_name string, command string, files_json string, timestamp string, project_key string"
RESULT = "session_key string, line_no int, ordinal int, for_id string, is_error boolean, outcome_text string, exit_code bigint"


def walked(calls, results):
    """(session, entry, ordinal) -> (key, is_error, signature, exit code, observed), by the rules one after another."""
    out, place = {}, {}
    for c in sorted(calls, key=lambda c: (c[0] or "", c[2], c[3])):
        session, entry, _, ordinal, call, tool, command, files = c[:8]
        if not (tool or command or files):
            continue
        mine = sorted((r for r in results if r[0] == session and session is not None and (r[3] or "") == (call or "")), key=lambda r: (r[1], r[2]))
        at = 0
        if not call:
            at = place[session] = place.get(session, -1) + 1
        r = mine[at] if at < len(mine) else None
        code = "" if r is None or not r[4] else r[5] if r[5] else f"exit_code:{r[6]}" if r[6] is not None else "tool_error"
        out[session, entry, ordinal] = (call or f"#{ordinal:03d}", int(bool(r and r[4])), code, r and r[6], r is not None)
    return out


def test_pairs_of_any_order(spark):
    rng = random.Random(3)
    places = [(line, ordinal) for line in range(120) for ordinal in range(2)]
    calls, results = [], []
    for session in ("s1", "s2", None):
        for line, ordinal in rng.sample(places, 60):
            calls.append((session, f"e{line}", line, ordinal, rng.choice(["", None, *(f"c{i}" for i in range(25))]), rng.choice(["", "Bash"]), rng.choice([None, "", "make all"]), "", "", "p"))
        for line, ordinal in rng.sample(places, 60):
            results.append((session, line, ordinal, rng.choice(["", None, *(f"c{i}" for i in range(25))]), rng.choice([True, False, None]), rng.choice(["", None, "boom", "lost"]), rng.choice([None, 0, 7])))
    found = pairing.tool_invocations(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), index_output=True).collect()
    assert {(r.session_key, r.entry_id, r.ordinal): (r.tool_key, r.is_error, r.error_signature, r.exit_code, r.outcome_observed) for r in found} == walked(calls, results)
    assert len(found) == len(walked(calls, results))
    assert {r.command_family for r in found} == {"make all", "Bash"}


def test_calls_and_results_of_one_reading(spark):
    lines = [("p", "s", False, n, raw) for n, raw in enumerate([
        '{"type": "assistant", "uuid": "a", "content": [{"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "make"}}, {"type": "tool_use", "name": "Read"}]}',
        '{"type": "user", "uuid": "b", "content": [{"type": "tool_result", "tool_use_id": "c1", "is_error": true, "content": "lost"}, {"type": "tool_result", "content": "fine"}]}',
        '{"type": "assistant", "uuid": "d", "content": [{"type": "tool_use", "id": "c1", "name": "Bash"}, {"type": "tool_use", "id": "c2", "name": "Bash"}]}'])]
    entries = T.generic_entries(spark.createDataFrame(lines, "path string, source_session_id string, is_subagent boolean, line_no int, raw string"))
    both = [tuple(r) for r in pairing.tool_invocations(*T.calls_and_results(entries), index_output=True).collect()]
    once = [tuple(r) for r in pairing.paired(T.calls_with_results(entries), index_output=True).collect()]
    assert len(once) == 4 and set(once) == set(both)
    assert {(r[1], r[3]) for r in once} == {("a", "c1"), ("a", "#001"), ("d", "c1"), ("d", "c2")}


def test_a_line_is_parsed_once(spark, tmp_path):
    spark.sql("select id event_id, timestamp_seconds(id) ts, id % 4 user_id, 'error' event_type, 1d value, '{}' props from range(40)").write.parquet(f"{tmp_path}/events.parquet")
    plan = catalog.ingest_invocations(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("parseJson") == 1
    # rows with the key of a pair are brought together once, behind the lines of a file
    assert plan.count("Exchange hashpartitioning") == 2


def test_lines_that_are_no_objects_say_nothing(spark):
    raws = ['{"type": "session", "id": "head", "cwd": "/w"}', '[{"type": "session", "id": "no", "cwd": "/no"}]', ' \t{"uuid": "a", "content": "one"}', "null", '"session"', "{broken", "3", None]
    lines = spark.createDataFrame([("p", "s", False, n, raw) for n, raw in enumerate(raws)], "path string, source_session_id string, is_subagent boolean, line_no int, raw string")
    assert {(r.line_no, r.source_session_id, r.cwd, r.text) for r in T.generic_entries(lines).collect()} == {(0, "head", "/w", ""), (2, "head", "/w", "one")}
    assert {r.line_no for r in T.diagnostics(lines).collect()} == {1, 3, 4, 5, 6, 7}
