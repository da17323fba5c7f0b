"""Snippets against the full-text tables of the standard library; searches of artifacts, and references."""

import random
import sqlite3

import pytest

from skein.operators import search, snippets


def _texts(rng, n):
    kinds = ["alpha", "beta", "gamma", "Alpha", "bèta", "x", "y", "z", "word", "other", "thing", "q1"]
    gaps = [" ", " ", " ", " ", " ", ". ", ": ", "\n", ", ", " - ", ".", "", ".\n\t"]
    out = []
    for _ in range(n):
        size, few = rng.choice([1, 4, 11, 12, 13, 14, 25, 60, 200]), rng.random()
        words = [rng.choice(kinds if rng.random() < few else kinds[5:]) for _ in range(size)]
        out.append(rng.choice(["", "", " ", "«"]) + "".join(w + rng.choice(gaps) for w in words))
    return out


def _table(texts):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(text, tokenize='unicode61')")
    db.executemany("insert into t(rowid, text) values (?, ?)", list(enumerate(texts)))
    return db


@pytest.mark.parametrize("query", ["alpha", "alpha beta", "beta-gamma", "alpha-beta beta-alpha", "x alpha alpha", "thing x-y-z", "alpha-alpha"])
def test_windows_and_brackets_equal_full_text_tables(spark, query):
    texts = _texts(random.Random(query), 400)
    texts.append("x alpha beta " * 6000 + "gamma alpha-alpha beta thing x y z beta gamma beta alpha end " + "pad " * 3000)
    match = " ".join('"' + " ".join(p) + '"' for p in search.phrases(query))
    want = dict(_table(texts).execute("select rowid, snippet(t, 0, '[', ']', '…', 12) from t where t match ?", [match]).fetchall())
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i in want], "id int, text string")
    got = {r.id: r.snippet for r in snippets.snippets(rows, query).collect()}
    assert want and {i: (texts[i], got[i], w) for i, w in want.items() if got[i] != w} == {}


def test_snippets_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " -- ", "a"), (4, "no hit at all", "a"), (5, " ".join(map(str, range(20))), "a"), (6, "éte été ete", "a")], "id int, text string, snippet string")
    got = {r.id: r.snippet for r in snippets.snippets(rows, "ete").collect()}
    assert got == {1: "", 2: "", 3: " -- ", 4: "no hit at all", 5: "0 1 2 3 4 5 6 7 8 9 10 11…", 6: "[éte] [été] [ete]"}
    assert {r.snippet for r in snippets.snippets(rows.where("id = 5"), " -- ").collect()} == {"0 1 2 3 4 5 6 7 8 9 10 11…"}
    assert snippets.snippets(rows.limit(0), "ete").count() == 0


def test_search_of_messages_and_artifacts_and_reading_hits(spark, tmp_path):
    from pyspark.sql import functions as F

    from skein.functions import scalars as S
    from skein.operators import read

    sha = {i: f"{i:064x}" for i in range(9)}
    rows = [(1, sha[1], "s", "m", "b1", "sk", "/w/one.txt", "needle here"), (2, sha[1], "s", "m", "b9", None, "/w/two.txt", "needle here"), (3, sha[3], "t", "m", "b2", "gone", "/x/three.md", "the needle needle"),
            (4, sha[4], "t", "n", "b2", "sk", "/x/four.md", ""), (5, sha[5], "t", "n", "b2", "sk", "/x/five.md", None)]
    artifacts = spark.createDataFrame(rows, "id long, artifact_sha256 string, source_name string, machine_id string, manifest_sha256 string, parent_session_key string, raw_path string, text string")
    snapshots_ = spark.createDataFrame([("b1", "2026-01-01"), ("b2", "2026-01-02")], "manifest_sha256 string, captured_at string")
    sessions = spark.createDataFrame([("sk", "p")], "session_key string, project_key string")
    tokens = artifacts.select("id", F.explode(S.path_tokens(F.col("raw_path"))).alias("token"))
    index = search.build(artifacts, "id", f"file://{tmp_path}/index")
    found = lambda **x: [(r.timestamp, r.session_key, r.entry_id, r.snippet) for r in search.find_artifacts(index, artifacts, snapshots_, sessions, "needle", path_tokens=tokens, **x).collect()]
    one, two, three = ("2026-01-01", "sk", sha[1], "[needle] here"), ("", "", sha[1], "[needle] here"), ("2026-01-02", "gone", sha[3], "the [needle] [needle]")
    assert sorted(found()) == sorted([one, two, three])
    assert found(project="p") == [one] and found(project="q") == [] and found(before="2026-01-01") == [one] and found(after="2026-01-02") == [three]
    assert found(path_token="MD ") == [three] and found(path_contains="/W/t") == [two] and len(found(limit=1)) == 1
    page = search.find_artifacts(index, artifacts, snapshots_, sessions, "needle")
    assert search.find_all(page, page, 4).count() == 4 and search.find_all(None, page).count() == 3
    assert page.where(S.parsed_ref(F.col("ref"))["artifact_sha256"] != F.col("entry_id")).count() == 0
    wanted = spark.createDataFrame([(sha[1], None), (sha[1], "sk"), (sha[1], "gone"), (sha[4], ""), (sha[8], "")], "artifact_sha256 string, parent_session_key string")
    kept = artifacts.withColumn("artifact_id", F.col("id")).withColumn("text_preview", F.lit("p"))
    got = {(r.artifact_sha256, r.parent_session_key): (r.artifact_id, r.text) for r in read.artifact_hits(kept, wanted).collect()}
    assert got == {(sha[1], ""): (1, "needle here"), (sha[1], "sk"): (1, "needle here"), (sha[1], "gone"): (None, None), (sha[4], ""): (4, "p"), (sha[8], ""): (None, None)}


def test_references_are_parsed_strictly(spark):
    import base64

    from pyspark.sql import functions as F

    from skein.functions import scalars as S

    enc = lambda t: base64.urlsafe_b64encode(t if isinstance(t, bytes) else t.encode()).decode().rstrip("=")
    key, sha = "sk1_" + "0a" * 32, "0f" * 32
    good = {f"msg:v1:{enc(key)}:{enc(e)}": ("message", key, e, None) for e in ("e", "é??>>1", " x ", "a:b")}
    good |= {f"session:v1:{enc(key)}": ("session", key, None, None), f"artifact:v1:{sha}": ("artifact", None, None, sha)}
    bad = ["", "x", "msg:v1:", f"msg:v1:{enc(key)}", f"msg:v1:{enc(key)}:", f"msg:v1:{enc(key)}:{enc('e')}:{enc('e')}", f"msg:v1:{enc('sk1_' + '0A' * 32)}:{enc('e')}", f"msg:v1:{enc(key)}:{enc('a' + chr(10))}", f"msg:v1:{enc(key)}:{enc(' ')}",
           f"msg:v1:{enc(key)}:{enc('e')}=", f"msg:v1:{enc(key)}:A", f"msg:v1:{enc(key)}:{enc(bytes([255, 254]))}", f"msg:v1:{enc(key)}:{enc('a' + chr(0))}", f"session:v1:{enc(key)}:{enc('e')}", f"session:v1:{enc('sk2')}", f"session:v1:{enc(key)}\n",
           f"artifact:v1:{sha.upper()}", f"artifact:v1:{sha}0", f"artifact:v1:{sha}\n", f"artifact:v2:{sha}", f" artifact:v1:{sha}", f"session:v1:{enc(key + chr(10))}", None]
    rows = spark.createDataFrame([(r,) for r in [*good, *bad]], "ref string").select("ref", S.parsed_ref(F.col("ref")).alias("p")).collect()
    assert {r.ref: tuple(r.p) for r in rows if r.p} == good


def test_scores_equal_to_nine_places_are_ordered_by_time_and_path(spark, tmp_path):
    # a word of more than half of the rows weighs so little that texts of other lengths differ beyond the ninth place only
    rows = [(i, f"{i:064x}", "s", "m", f"b{i % 3}", None, f"/w/{99 - i}.txt", "the " + "pad " * (3000 + i)) for i in range(20)] + [(50, f"{50:064x}", "s", "m", "b1", None, "/w/x", "other")]
    artifacts = spark.createDataFrame(rows, "id long, artifact_sha256 string, source_name string, machine_id string, manifest_sha256 string, parent_session_key string, raw_path string, text string")
    times = spark.createDataFrame([(f"b{i}", f"2026-01-0{9 - i}") for i in range(3)], "manifest_sha256 string, captured_at string")
    sessions = spark.createDataFrame([], "session_key string, project_key string")
    index = search.build(artifacts, "id", f"file://{tmp_path}/index")
    scores = {r.id: round(r.score, 9) for r in search.matches(index, "the").collect()}
    want = sorted((scores[r[0]], f"2026-01-0{9 - r[0] % 3}", r[6], r[1]) for r in rows[:20])[:7]
    got = search.find_artifacts(index, artifacts, times, sessions, "the", 7).collect()
    assert len(set(scores.values())) < len(scores) and {(r.timestamp, r.entry_id) for r in got} == {(w[1], w[3]) for w in want}
