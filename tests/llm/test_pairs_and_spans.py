"""Joins and span operators against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decontaminate, ngram_join, substring
from skein.llm.arrowtext import Words, text_buffers


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    up = dict.fromkeys(sets)

    def root(x):
        while up[x] is not None:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                if x != y:
                    up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_join_matches_brute_force(corpus):
    df, texts = corpus
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == classes(texts)


def test_join_with_hot_groups_in_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(90)]
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        texts[i] = " ".join(w[:rng.choice([70, 80, 90])])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == classes(texts)


def test_blocks_return_fewer_links_than_documents():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[:385], rng.integers(0, 1 << 62, 12).astype(np.uint64)])) for _ in range(500)]
    n = len(sets)
    column = lambda x: pa.array([x] * n, pa.int32())
    table = pa.table({"doc": pa.array(range(n), pa.int64()), "component": pa.array(range(n), pa.int64()), "n": pa.array(map(len, sets), pa.int32()), "bits": pa.array(map(ngram_join._parity, sets), pa.binary()), "shingles": pa.array([x.tobytes() for x in sets], pa.binary()),
                      "band": column(3), "part": column(0), "kb": column(3), "ki": column(0), "kj": column(0), "ku": pa.array([False] * n)})
    assert ngram_join._block_links(80, 100)(table).num_rows == n - 1


@pytest.mark.parametrize("seed", range(4))
def test_linked_sets_share_a_signature(seed):
    """The pigeonhole itself: for random linked pairs of any size, with any set of common shingles."""
    rng = np.random.default_rng(seed)
    for _ in range(120):
        n = int(rng.integers(1, 300))
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        a = np.unique(a)
        drop = int(rng.integers(0, max(1, len(a) // 9) + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(1, 1 << 62, int(rng.integers(0, max(1, len(a) // 9) + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both == 0 or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        share = rng.choice([0.0, 0.3, 0.9, 1.0])
        row = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        token = np.concatenate([a, b])
        common = (token % np.uint64(1000)) < np.uint64(int(share * 1000))
        sides = [set(), set()]
        for owner, sig, *_ in ngram_join.segment_rows(row, token, np.array([len(a), len(b)]), common, 80, 100):
            for o, s in zip(owner, sig, strict=True):
                sides[o].add(int(s))
        assert sides[0] & sides[1]


def test_join_edge_cases(nothing, odd):
    assert ngram_join.jaccard_components(nothing).count() == 0
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (6, 0, 6), (None, 2, None)], key=str)


def test_removed_spans_match_brute_force(corpus):
    df, texts = corpus
    first = {}
    for i, t in sorted(texts.items()):
        w = t.encode().split()
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j:j + 50]), i)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df).collect()}
    removed = 0
    for i, t in texts.items():
        w = t.encode().split()
        gone = set()
        for j in range(len(w) - 49):
            if first[tuple(w[j:j + 50])] < i:
                gone.update(range(j, j + 50))
        removed += len(gone)
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept).hexdigest()), i
    assert removed > 3000


def test_removed_spans_edge_cases(nothing, odd):
    assert substring.remove_repeats(nothing).count() == 0
    assert sorted((r.n_words, r.n_removed) for r in substring.remove_repeats(odd).collect()) == [(0, 0), (6, 0), (6, 0), (6, 0)]


def test_repeated_ids_with_unlike_texts(spark):
    rng = np.random.default_rng(8)
    make = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 10 ** 6, n))
    w, u, v = make(100), make(100), make(160)
    rows = [(1, w), (2, w), (2, u), (3, make(10) + " " + v + " " + make(30)), (4, make(5) + " " + v), (4, "short text"), (4, u), (5, make(60))]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 100, 0), (2, 100, 0), (2, 100, 100), (3, 200, 0), (4, 2, 0), (4, 100, 100), (4, 165, 160), (5, 60, 0)]


def test_windows_share_a_picked_kmer():
    rng = np.random.default_rng(0)
    text = " ".join(f"w{x}" for x in rng.integers(0, 30, 3000))
    at, data = text_buffers(__import__("pyarrow").array([text]))
    words = Words(at, data, 0, 1, fold=False)
    place, _ = substring.picked(words, 50, 12)
    have = set(place.tolist())
    assert all(any(s <= p <= s + 38 for p in have) for s in range(3000 - 49)) and len(have) < 400


def test_leaks(spark, nothing):
    rng = np.random.default_rng(5)
    make = lambda n, kinds=5000: [f"v{x}" for x in rng.integers(0, kinds, n)]
    items = {i: make(40) for i in range(8)}
    docs = {0: make(300), 1: make(100) + items[2] + make(50), 2: [w.upper() + "!!" for w in items[3]], 3: make(20) + items[4][20:] + make(9) + items[4][:20] + make(20), 4: make(50) + items[5][:12] + make(50), 5: [], 6: items[6][:22] + make(30)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] + [(None, " ".join(items[1])), (9, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(90, None), (91, ""), (92, "tiny")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(1, 2): (1.0, 1), (2, 3): (1.0, 1), (3, 4): (1.0, 2), (6, 6): (0.55, 1), (None, 1): (1.0, 1)}
    assert decontaminate.leaks(nothing, bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def tiled_by_brute_force(doc, item, k):
    """Covered tokens of an item: again and again the longest common run of unmarked tokens, first in item, then in document."""
    d, i, covered = [False] * len(doc), [False] * len(item), 0
    k = min(k, len(item))
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and not i[a + n] and not d[b + n]:
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < k:
            return covered
        i[a:a + n] = [True] * n
        d[b:b + n] = [True] * n
        covered += n


def test_tiling_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    make = lambda n: [f"t{x}" for x in rng.integers(0, 4, n)]
    items = {i: make(n) for i, n in enumerate([1, 2, 3, 3, 4, 5, 7, 9, 12, 15, 20, 20])}
    docs = {i: make(n) for i, n in enumerate(rng.integers(0, 40, 40).tolist())}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(0, " ".join(items[0]))], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = sorted((r.doc_id, r.item_id, round(r.coverage * len(items[r.item_id]))) for r in decontaminate.leaks(df, bench).collect())
    want = [(d, i, tiled_by_brute_force(w, x, 4)) for d, w in docs.items() for i, x in items.items()]
    want = [x for x in want if x[2] and x[2] / len(items[x[1]]) >= 0.5]
    assert got == sorted(want + [x for x in want if x[1] == 0]) and len({x[1] for x in want}) > 8


def test_tiles_cut_overlapping_runs():
    # the longest run is marked first; of the other only what stays free and long enough
    assert decontaminate.tiles([(10, 0, 0), (8, 5, 20)], 3) == [(0, 0, 10), (10, 25, 3)]
    assert decontaminate.tiles([(10, 0, 0), (8, 5, 20)], 4) == [(0, 0, 10)]
    assert decontaminate.tiles([(10, 0, 0), (8, 20, 5)], 3) == [(0, 0, 10), (25, 10, 3)]
