import pytest

from skein.operators import merge, pairing, read, search

ENTRY = "session_key string, entry_id string, parent_id string, line_no int, entry_type string, participates_in_context int, first_kept string"


def _live(spark, rows, leaf):
    e = spark.createDataFrame([("s", i, p, n, t, part, kept) for n, (i, p, t, part, kept) in enumerate(rows)], ENTRY)
    return [r.entry_id for r in read.live_context(e, e.where(f"entry_id = '{leaf}'")).orderBy("place").collect()]


def test_live_context_goldens(spark):
    m = lambda i, p: (i, p, "message", 1, "")
    one = [m("u1", ""), m("u2", "u1"), ("comp1", "u2", "compaction", 1, "u2"), m("a2", "comp1")]
    assert _live(spark, one, "a2") == ["comp1", "u2", "a2"]
    two = [*one, m("u3", "a2"), ("comp2", "u3", "compaction", 1, "u3"), m("leaf", "comp2")]
    assert _live(spark, two, "leaf") == ["comp2", "u3", "leaf"]
    assert _live(spark, [m("u1", ""), ("x", "u1", "custom", 0, ""), ("hint1", "x", "custom", 1, ""), m("leaf", "hint1")], "leaf") == ["u1", "hint1", "leaf"]
    with pytest.raises(ValueError):
        _live(spark, [m("u1", ""), ("c", "u1", "compaction", 1, "gone"), m("leaf", "c")], "leaf")


def test_branch_of_a_deep_session_and_errors(spark):
    deep = spark.createDataFrame([("s", f"e{i}", f"e{i - 1}" if i else "", i, "message", 1, "") for i in range(400)], ENTRY)
    assert read.branches(deep, deep.where("entry_id = 'e399'")).count() == 400
    ring = spark.createDataFrame([("s", "a", "b", 0, "message", 1, ""), ("s", "b", "a", 1, "message", 1, "")], ENTRY)
    with pytest.raises(ValueError):
        read.branches(ring, ring).count()
    lost = spark.createDataFrame([("s", "a", "zz", 0, "message", 1, "")], ENTRY)
    with pytest.raises(ValueError):
        read.branches(lost, lost)


def test_resolve_prefix(spark):
    ids = spark.createDataFrame([("abc",), ("abd",), ("x",)], "id string")
    assert read.resolve(ids, "id", "abc") == "abc" and read.resolve(ids, "id", "x") == "x"
    for bad in ("ab", "q"):
        with pytest.raises(LookupError):
            read.resolve(ids, "id", bad)


def test_bm25_matches_the_formula(spark):
    import math

    docs = ["Échelle one two one", "one two three", "three", "", None]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    got = {r.id: r.score for r in search.bm25(df, "id", "one echelle").collect()}
    n, avg = 3, (4 + 3 + 1) / 3
    idf = lambda k: max(math.log((n - k + 0.5) / (k + 0.5)), 0) or 1e-6
    part = lambda f, k: idf(k) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * 4 / avg))
    assert list(got) == [0] and math.isclose(got[0], -(part(2, 2) + part(1, 1)))
    for q in ('needle "quoted"', "--json", "needle:", "path/to/file", "one OR two", "", "a\\b"):
        search.bm25(df, "id", q).collect()
    assert [r.id for r in df.where(search.contains(df.text, "%")).collect()] == []


def test_pairing_keyed_positional_and_pending(spark):
    calls = spark.createDataFrame([("s", "a", 1, 0, "c1", "Bash", "go test", "", "", ""), ("s", "b", 2, 0, "", "Bash", "ls", "", "", ""), ("s", "c", 3, 0, "", "Read", "", "", "", ""), ("s", "d", 4, 0, "", "", "", "", "", ""), ("s", "e", 5, 0, "", "Last", "", "", "", "")],
                                  "session_key string, entry_id string, line_no int, ordinal int, call_id string, tool_name string, command string, files_json string, timestamp string, project_key string")
    results = spark.createDataFrame([("s", 2, 0, "c1", True, "boom 12", 3), ("s", 3, 0, "c1", False, "", None), ("s", 4, 0, "", False, "fine", 0), ("s", 5, 0, "", True, "", None)], "session_key string, line_no int, ordinal int, for_id string, is_error boolean, outcome_text string, exit_code bigint")
    got = {r.entry_id: (r.is_error, r.error_signature, r.outcome_observed) for r in pairing.tool_invocations(calls, results).collect()}
    assert got == {"a": (1, "exit_code:3", True), "b": (0, "", True), "c": (1, "tool_error", True), "e": (0, "", False)}
    kept = {r.entry_id: r.error_signature for r in pairing.tool_invocations(calls, results, True).collect()}
    assert kept["a"] == "boom <n>" and kept["c"] == "tool_error"


def test_replaying_snapshots_equals_the_latest(spark):
    rows = spark.createDataFrame([("s", "a", "m1", 1, "h1"), ("s", "a", "m2", 1, "h1"), ("s", "b", "m2", 2, "h2"), ("s", "b", "m1", 9, "h3")], "session_key string, entry_id string, machine_id string, line_no int, entry_sha256 string")
    first = merge.first_writer(rows, merge.ENTRY, ["machine_id", "line_no"])
    assert {(r.entry_id, r.entry_sha256) for r in first.collect()} == {("a", "h1"), ("b", "h3")}
    again = merge.unknown(rows.select("session_key", "entry_id"), first, merge.ENTRY)
    assert again.count() == 0
    assert [(r.first_sha, r.second_sha) for r in merge.same_session_conflicts(rows, ["machine_id", "line_no"]).collect()] == [("h3", "h2")]
    with pytest.raises(ValueError):
        merge.page(first.withColumnRenamed("line_no", "conflict_id"), 500)


def test_stored_postings_score_as_scans_do(spark, tmp_path):
    texts = ["the quick fox", "the the fox jumped the fox", None, "", "...", "quick Fox, the", "nothing here", "a fox the fox the fox"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = search.build(df, "id", f"{tmp_path}/a")
    later = search.refreshed(search.build(df.where("id < 5").unionByName(spark.createDataFrame([(99, "gone fox")], df.schema)), "id", f"{tmp_path}/b"), df, "id", f"{tmp_path}/c")
    for query in ("fox", "the/fox", "quick the", "fox/the/fox the", "missing", "", "fox missing"):
        want = {r.id: round(r.score, 9) for r in search.bm25(df, "id", query).collect()}
        for one in (index, later):
            assert {r.id: round(r.score, 9) for r in search.matches(one, query).collect()} == want, query
    assert (index.rows, later.rows) == (6, 6) and index.mean == later.mean
