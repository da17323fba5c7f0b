"""Spelling variants, MinHash near duplicates and ranked search against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import minhash_join, ranked, spelling
from tests.llm.conftest import SCHEMA


def lowered(text):
    return (text or "").encode().lower().decode() if (text or "").isascii() else "".join(c.lower() if c.isascii() else c for c in text or "")


# ---- spelling

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def variants_by_brute_force(rows, least, times, ratio, errata):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % errata == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            if len(low) >= least:
                count[low] += 1
    words = {w: n for w, n in count.items() if n >= times}
    out, form = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best
        out[w] = [n, len(near), form.get(w), words[form[w]] if w in form else None]
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def spelled(df, **how):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df, **how).collect()}


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefgÿÀ"])
def test_variants_match_brute_force(spark, letters):
    """Few letters: runs of equal ones, and words that differ at every place."""
    rng = random.Random(len(letters))
    rows = []
    for i in range(60):
        words = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 4, 5, 6]))) * rng.choice([1, 1, 2]) for _ in range(60)]
        rows.append((i % 50, " ".join(w.upper() if rng.random() < 0.1 else w for w in words + ["common" + letters] * 3) + rng.choice([".", "1x", "-"]), None, None, None, "x", "y", "z"))
    rows += [(None, "aaaaa bbbbb " * 3, None, None, None, None, None, None), (7, None, None, None, None, None, None, None), (8, "", None, None, None, None, None, None)] + rows[:3]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least, ratio, errata in ((4, 2, 3), (3, 10, 31)):
        want = variants_by_brute_force([r[:2] for r in rows], least, 2, ratio, errata)
        assert len(want) > 20 and spelled(df, least=least, ratio=ratio, errata=errata) == want
    assert any(v[2] for v in want.values()) or ratio == 10


def test_forms_of_forms(spark):
    text = "abcdefgh " * 2 + "abcdefghi " * 20 + "abcdefghij " * 200 + "abcdefghijk " * 2000
    got = spelled(spark.createDataFrame([(1, text)], "doc_id long, text string"), errata=10 ** 9)
    assert got["abcdefgh"] == (2, 1, "abcdefghi", 20, "abcdefghijk") and got["abcdefghijk"] == (2000, 1, None, None, "abcdefghijk")


def test_a_run_of_a_million_letters(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    df = spark.createDataFrame([(1, f"{long} {long} {long[1:]} {long[1:]} {long}x {long}x")], "doc_id long, text string")
    got = spelled(df, errata=10 ** 9)
    assert {len(w): v[:2] for w, v in got.items()} == {999_999: (2, 1), 1_000_000: (2, 2), 1_000_001: (2, 1)}


def test_words_leave_heavy_paths_seldom(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcd") for _ in range(9)) for _ in range(3000)})
    df = spark.createDataFrame([(i, w, 2) for i, w in enumerate(words)], "id long, word string, n long")
    rows = spelling.light_places(df).groupBy("word").count().collect()
    assert max(r["count"] for r in rows) <= math.log2(len(words)) + 1


# ---- near duplicates

def sets_of(text):
    w = (text or "").encode().lower().split()
    w = [x for x in w if x]
    return {tuple(w[i:i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def copies_by_brute_force(rows):
    """(doc, n_shingles) of each row to (component, kept); rows of one id are one document of all their sets."""
    sets = [(d, sets_of(t)) for d, t in rows]
    up = {d: d for d, s in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return sorted(((d, len(s), None if d is None else root(d), None if d is None else root(d) == d) for d, s in sets), key=repr)


def found(df, **how):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_join.near_duplicates(df, **how).collect()), key=repr)


def test_near_duplicates_match_brute_force(corpus, nothing, odd):
    df, texts = corpus
    assert found(df) == copies_by_brute_force(list(texts.items()))
    assert found(nothing) == []
    assert found(odd) == copies_by_brute_force([(r.doc_id, r.text) for r in odd.collect()])


def family(rng, docs, changes):
    """Texts of one template, each with some words changed, and an unrelated half."""
    base = [f"w{rng.randrange(900)}" for _ in range(90)]
    out = {}
    for i in range(docs):
        w = list(base)
        for _ in range(rng.choice(changes)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        out[i] = " ".join(w)
    for i in range(docs, docs + 20):
        out[i] = " ".join(base[:45] + [f"y{rng.randrange(10 ** 6)}" for _ in range(45)])
    return out


@pytest.mark.parametrize("changes", [[0, 1, 3, 5], [4, 8, 12]])
def test_families_through_all_levels(spark, monkeypatch, changes):
    """Short lists of two only, so that longer signatures and blocks are used."""
    monkeypatch.setattr(minhash_join, "SHORT", 2)
    texts = family(random.Random(len(changes)), 60, changes)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(df, levels=(96, 256)) == copies_by_brute_force(list(texts.items()))


def test_rows_that_repeat_an_id(spark):
    a, b = (" ".join(f"{t}{i}" for i in range(30)) for t in "ab")
    rows = [(5, a), (5, b), (5, b), (7, a), (9, b + " more"), (11, "other words"), (None, a), (2, None), (3, " \t"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == copies_by_brute_force(rows)


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.Generator(np.random.PCG64(4))
    token = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    row = np.repeat([0, 1, 3], [900, 900, 0 + 0 or 1])
    both = np.concatenate([token[:900], token[100:1000], token[:1]])
    sig = minhash_join.signatures(row, both, 4, 1024)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.05 and not sig[2].any() and sig[3].any()


def test_bound_of_collisions():
    for h in (16, 96, 512):
        t = minhash_join.least_collisions(h, 80, 100, 1e-6)
        tail = lambda t: sum(math.comb(h, i) * 0.8 ** i * 0.2 ** (h - i) for i in range(t))
        assert tail(t) <= 1e-6 < tail(t + 1)


# ---- ranked search

def terms_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def ranked_by_brute_force(docs, items, top):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms_of(text))
    out = set()
    for item, terms in asked.items():
        scores = []
        for d, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            score = 0
            for t in terms & set(c):
                df = sum(t in x for _, x in counts)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0 and d is not None:
                scores.append((-score, d))
        out |= {(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:top])}
    return out


def ranks(docs, items, top):
    return [tuple(r) for r in ranked.rank(docs, items, top=top).collect()]


@pytest.mark.parametrize("window, block", [(64, 10 ** 6), (7, 40)])
def test_ranks_match_brute_force(spark, corpus, nothing, monkeypatch, window, block):
    monkeypatch.setattr(ranked, "WINDOW", window)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", block)
    df, texts = corpus
    docs = list(texts.items())
    items = [(i, texts[i]) for i in range(0, 40, 2)] + [(100, "w1 w2 Ñ é 日本 w2"), (101, "nowhere"), (102, None), (103, " ,."), (None, "w1"), (104, "w5"), (104, "w6,W7")]
    asked = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, score string")
    for top in (3, 50):
        got = ranks(df, asked, top)
        assert len(got) == len(set(got)) and set(got) == ranked_by_brute_force(docs, items, top)
    assert ranks(nothing, asked, 5) == [] and ranks(df, asked.limit(0), 5) == []


def test_ranks_of_repeated_and_null_ids(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(1, "here and words")] * 120 + [(2, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ranks(df, spark.createDataFrame([("q", "again here words")], "item_id string, text string"), 50)
    want = ranked_by_brute_force(rows, [("q", "again here words")], 50)
    assert set(got) == want and len(got) == 50


def test_lengths_beyond_64_bits():
    n, docs, total = np.array([10 ** 9, 3]), 10 ** 12, 7 * 10 ** 14
    assert ranked._lengths(n, docs, total).tolist() == [50 + 50 * 10 ** 9 * docs // total, 50]
