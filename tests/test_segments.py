"""Folding against the tokenizer of the standard library's full-text tables, and postings in segments against new indexes."""

import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from skein.operators import search, segments

TEXTS = ["한국어 검색", "мой ещё Ёж", "がっこう ガッコウ", "tiếng Việt", "cafe\u0301 CAFÉ", "naïve Ångström ǅ", "ΣΊΣΥΦΟΣ σίσυφος", "ſtraße ẛ Straße", "x\u0301\u0323y e\u0308", "İstanbul ıstanbul", "हिन्दी भाषा", "a_b 'c' №5 ½ Ⅷ", "日本語 テスト", "øre łódź ñandú", "μέτρο µm"]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(x)")
    except sqlite3.OperationalError:
        pytest.skip("this library has no full-text tables")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    return con


def stored(con, texts):
    con.execute("delete from t")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts, 1)))
    out = [[] for _ in texts]
    for term, doc, place in con.execute('select term, doc, "offset" from v order by doc, "offset"'):
        out[doc - 1].append(term)
    return out


def test_tokens_equal_full_text_tables(spark, fts):
    # every letter of the scripts that are older than the library's table, alone and with marks
    letters = [chr(c) for c in [*range(0xA1, 0x37F), *range(0x384, 0x528), *range(0x531, 0x587), *range(0x5D0, 0x5EB), *range(0x1E00, 0x2000), *range(0x3041, 0x30FF), *range(0xAC00, 0xAD00)] if chr(c).isalpha()]
    texts = TEXTS + [f"q{c}q {c}\u0301a" for c in letters]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [r.t for r in df.select("id", search.tokens(F.col("text")).alias("t")).orderBy("id").collect()]
    want = stored(fts, texts)
    assert [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    # a query folds as its text does
    assert [t for t, w in zip(texts, want, strict=True) if [x for p in search.phrases(t) for x in p] != w] == []


def test_every_text_is_found_by_its_own_words(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for i, text in enumerate(TEXTS):
        word = text.split()[0]
        assert i in {r.id for r in search.bm25(df, "id", word).collect()}, word
    assert {r.id for r in search.bm25(df, "id", "CAFE").collect()} == {r.id for r in search.bm25(df, "id", "cafe\u0301").collect()} == {4}


def ranking(index, query):
    return [(r.id, round(r.score, 9)) for r in search.matches(index, query).orderBy("score", "id").collect()]


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_segments_equal_a_new_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "RANGE_ROWS", 200)
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(["apple", "pear", "plum", "fig", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(1, 40)))
    docs = {i: text() for i in range(120)} | {500: "", 501: None, 502: "..."}
    path, n = str(tmp_path / "index"), 600
    frame = lambda: spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    index = segments.refresh(spark, path, frame())
    assert len(index.live) == 1
    for step in range(4):
        before = files(path)
        for i in rng.sample(sorted(docs), 5):
            del docs[i]
        for i in range(n, n + 8):
            docs[i] = text()
        if step == 2:
            docs[n + 9] = "pear again"
            docs.pop(n - 3, None)
        n += 10
        index = segments.refresh(spark, path, frame())
        new = search.build(frame(), "doc_id", str(tmp_path / f"new{step}"))
        assert (index.rows, round(index.mean, 9)) == (new.rows, round(new.mean, 9))
        for query in ("apple", "pear plum", "apple/pear w1", "fig nowhere", "again"):
            assert ranking(index, query) == ranking(new, query), (step, query)
        # a delta writes its own segment and a commit, and nothing of the others
        assert before <= files(path) and all("commits" in f or f"segment={index.live[-1].segment}" in f for f in files(path) - before)
    assert len(index.live) == 5
    assert segments.refresh(spark, path, frame()).version == index.version
    whole = segments.merged(index)
    assert len(whole.live) == 1 and ranking(whole, "pear plum") == ranking(index, "pear plum") and whole.rows == index.rows
    assert ranking(segments.open_segments(spark, path, index.version), "apple") == ranking(index, "apple")


def test_an_id_that_comes_back(spark, tmp_path):
    path = str(tmp_path / "index")
    one = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    base = [(i, "common word") for i in range(20)]
    segments.refresh(spark, path, one(*base, (99, "first text")))
    segments.refresh(spark, path, one(*base))
    index = segments.refresh(spark, path, one(*base, (99, "second text")))
    assert [i for i, _ in ranking(index, "second")] == [99] and ranking(index, "first") == [] and index.rows == 21


def test_deltas_are_merged_when_they_grow(spark, tmp_path):
    path, docs = str(tmp_path / "index"), []
    for i in range(4):
        docs += [(i * 10 + j, f"word{i} each") for j in range(4)]
        index = segments.refresh(spark, path, spark.createDataFrame(docs, "doc_id long, text string"))
    assert len(index.live) < 4 and len(ranking(index, "each")) == 16


def test_a_query_opens_the_ranges_of_its_tokens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "RANGE_ROWS", 50)
    opened = []
    for size in (1, 10):
        df = spark.createDataFrame([(i, f"common t{i} u{i} v{i}") for i in range(100 * size)], "doc_id long, text string")
        index = segments.refresh(spark, str(tmp_path / f"index{size}"), df)
        opened.append((sum(len(r) for _, r in index.ranges_of(["t7"])), len(index.of(["t7"]).inputFiles())))
        assert len(ranking(index, "t7")) == 1
    assert max(map(max, opened)) <= 2


def test_no_rows(spark, tmp_path):
    index = segments.refresh(spark, str(tmp_path / "index"), spark.createDataFrame([], "doc_id long, text string"))
    assert index.rows == 0 and ranking(index, "word") == []
    index = segments.refresh(spark, str(tmp_path / "index"), spark.createDataFrame([(1, "word")], "doc_id long, text string"))
    assert [i for i, _ in ranking(index, "word")] == [1]


def test_postings_are_made_where_the_text_is(spark):
    rng = random.Random(3)
    texts = TEXTS + ["", None, "...", " ", "a a b a", "b"] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    made = search.by_token(df, "id")
    want = search.postings(df, "id").groupBy("token", "id").agg(F.first("dl").alias("dl"), F.array_sort(F.collect_list("pos")).alias("positions"))
    rows = lambda d: sorted((r.token, r.id, r.dl, list(r.positions)) for r in d.collect())
    assert rows(made) == rows(want) and rows(search.by_token(df.where("id < 0"), "id")) == []
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange ") == 1 and plan.index("MapInArrow") < plan.index("Exchange ")  # of texts, not of postings
