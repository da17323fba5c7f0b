"""Operators on single texts against the libraries, brute force and round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, langid, lm, pii, tokencount, warc, winnow
from skein.llm.shared import most_frequent

ODD_TEXTS = ["", "  ", "a  b\n\n c\td  ", "日本語テスト 🙂x é", "x" * 300, "▁a ▁", "<s> a</s><unk>", "it's we'll \x1c\x85 x  y 　", "a<|endoftext|> b<|endoftext|>", "é́ ٣٤ ²½", "\n", " \n ", "a\nb"]


@pytest.fixture(scope="module")
def texts(spark, corpus):
    _, held = corpus
    rows = list(held.items()) + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), dict(rows)


def test_token_counts_equal_the_library(texts, odd, nothing):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    df, held = texts
    for r in tokencount.token_counts(df, path, budget=100).collect():
        t = held[r.doc_id]
        n = len(library.encode(t))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(t.encode()), n > 100)
        if n > 100 and t.isascii():
            assert len(library.encode(t[:r.fits_chars])) <= 100 < len(library.encode(t[:r.fits_chars + 1]))
    assert tokencount.token_counts(nothing, path).count() == 0 and tokencount.token_counts(odd, path).count() == 4


def test_long_texts_without_spaces_equal_the_library():
    import base64
    import time

    counter = tokencount.PrefixCounter(P.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    cjk = "".join(rng.choice(["的", "是", chr(rng.randrange(0x4E00, 0x9FA5)), chr(rng.randrange(0x3041, 0x3090)), chr(rng.randrange(0xAC00, 0xD000))]) for _ in range(20_000))
    for text in (cjk, "=" * 5000, base64.b64encode(rng.randbytes(750_000)).decode()):
        began = time.perf_counter()
        chunks = counter.chunks(text)
        counter.learn(set(chunks))
        assert counter.count(chunks, len(text))[0] == len(counter.library.encode(text))
        assert time.perf_counter() - began < 30
    text = cjk[:150] + " hello wörld\n" + "QUJD" * 20 + "  \n\n x the end"
    assert counter.text_prefixes(text).tolist() == [len(counter.library.encode(text[:i])) for i in range(len(text) + 1)]
    assert not counter.overruled


def test_stored_prefixes_answer_budgets(spark, texts):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    df, held = texts
    for r in tokencount.prefix_table(df, path).withColumn("fits", tokencount.fits(F.col("counts"), 20)).collect():
        t = held[r.doc_id]
        assert len(r.counts) == len(t) + 1 and r.counts[-1] == len(library.encode(t))
        assert r.fits == max(i for i, c in enumerate(r.counts) if c <= 20)


def test_most_frequent_is_exact(spark):
    rows = [(f"w{i:03d}", 10 ** 6) for i in range(50)] + [(f"x{i:03d}", 1 + i % 7) for i in range(100)]
    counts = spark.createDataFrame(rows, "word string, n long")
    for most in (0, 1, 20, 50, 60, 149, 150, 400):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:most]
        assert sorted((r.word, r.n) for r in most_frequent(counts, "n", "word", most).collect()) == sorted(want)


def test_every_prefix_count_equals_the_library():
    counter = tokencount.PrefixCounter(P.path("piece_bpe_32k.model"))
    rng = random.Random(0)
    for _ in range(60):
        w = "".join(rng.choice("aeioustnrlé#1") for _ in range(rng.randrange(1, 15)))
        assert counter.prefix_counts("▁" + w)[2:].tolist() == [len(counter.library.encode(w[:i])) for i in range(1, len(w) + 1)]


def test_bpe_round_trip_and_library(texts, odd, nothing):
    path = P.path("byte_bpe_50k.json")
    library = bpe.Vocabulary(path).library
    df, held = texts
    for r in bpe.encode_digests(df, path).collect():
        ids = library.encode(held[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(held[r.doc_id].encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, path, words=5), path)
    assert back.where("text <> decoded").count() == 0
    assert bpe.encode_digests(nothing, path).count() == 0 and bpe.encode_digests(odd, path).count() == 4


def test_pii_base_and_disguises(spark, odd, nothing):
    shown = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b in sorted(sum(pii.spans(t), []))]
    for text, want in {
        "mail a.b@x.com or x@y.z@w.v": [("email", "a.b@x.com"), ("email", "x@y.z")],
        "10.0.0.1 300.1.1.1 1.2.3.4.5": [("ip", "10.0.0.1"), ("ip", "1.2.3.4")],
        "card 4111 1111 1111 1111, 4111 1111 1111 1112": [("card", "4111 1111 1111 1111")],
        "call +1 (578) 555-6437 now": [("phone", "+1 (578) 555-6437")],
        "john dot doe at mail dot example dot com": [("email", "john dot doe at mail dot example dot com")],
        "c (at) d [dot] org": [("email", "c (at) d [dot] org")],
        "jоhn@exаmple.com": [("email", "jоhn@exаmple.com")],
        "４１１１ １１１１ １１１１ １１１１": [("card", "４１１１ １１１１ １１１１ １１１１")],
        "plus one five five five one two three four five six seven": [("phone", "plus one five five five one two three four five six seven")],
        "+1 (578) 555-6437 4111111111111111 x": [("phone", "+1 (578) 555-6437"), ("card", "4111111111111111")],
        "rest at noon.Then we looked at one dot": [], "one two three four five": [], "": [],
    }.items():
        assert shown(text) == want, text
    df = spark.createDataFrame([(1, "é a@b.co 🙂 c@d.co"), (2, None)], "doc_id long, text string")
    r = {x.doc_id: x for x in pii.detect(df).collect()}
    assert r[1].spans == "email:2:8,email:11:17" and r[1].n_email == 2
    assert r[1].base_sha256 == hashlib.sha256(b"email:2:8,email:11:17").hexdigest() and r[2].spans == ""
    assert pii.redacted(df).where("doc_id = 1").first().text == "é [EMAIL] 🙂 [EMAIL]"
    assert pii.detect(nothing).count() == 0 and pii.detect(odd).count() == 4


def test_pii_disguise_gate_drops_nothing(monkeypatch):
    shown = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b in sorted(sum(pii.spans(t), []))]
    for text in ("jane at example.com", "jane { at } host.com", "jane <at> host.com", "jane (  at\t) host.com", "jane@host . com", "jane AT example.com", "jane arroba example.org"):
        assert shown(f"write to: {text}") == [("email", text)], text
    assert shown("at 10 . 20 . 30 . 40,") == [("ip", "10 . 20 . 30 . 40")] and shown("we meet at noon.Then we go") == []
    rng = random.Random(8)
    pieces = ["jane", "host", "com", "b-c", "ſ", "7", "10", "at", "AT", "arobase", "dot", "punto", "@", ".", ".", "[", "(", "{", "<", "]", ")", "}", ">", " ", " ", "  ", "\t", "\n", ",", "é", "at host.com", "( at )", "10.2.3"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(40_000)]
    gated = [pii.spans(t) for t in texts]
    monkeypatch.setattr(pii, "_DISGUISE_HINT", re.compile(""))
    assert gated == [pii.spans(t) for t in texts] and sum(bool(new) for _, new in gated) > 200


def test_pii_spelled_gate_drops_nothing(monkeypatch):
    shown = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b in sorted(sum(pii.spans(t), []))]
    for kind, text in (("phone", "plus one-five-five-five-oh-one-two-three-four-five-six"), ("phone", "plus 1 five 7 five 5 oh 1 two 3 four"), ("ip", "one.two.three.four"), ("ip", "10.two.three.four"),
                       ("card", ",".join(["four"] + ["one"] * 15)), ("card", "-".join(["four"] + ["one"] * 15)), ("card", "four 1 one 1 1 one 11 1111 1111")):
        assert shown(f'call "{text}".') == [(kind, text)], text
    rng = random.Random(9)
    pieces = ["one", "five", "FIVE", "ſix", "oh", "un", "neuf", "plus", "double", "triple", "dot", "1", "42", "4111", "+", "x", "_"]
    joins = [" ", " ", " ", "-", ",", ".", ", ", " (", ") ", "/", "", "    "]
    texts = ["".join(rng.choice(pieces) + rng.choice(joins) for _ in range(rng.randrange(1, 22))) for _ in range(30_000)]
    gated = [pii.spans(t) for t in texts]
    monkeypatch.setattr(pii, "_RUN_HINT", re.compile(""))
    monkeypatch.setattr(pii, "_WORDS", type("Always", (), {"findall": lambda self, text: ["one"] * 3})())
    assert gated == [pii.spans(t) for t in texts] and sum(bool(new) for _, new in gated) > 50


def test_pii_base_equals_plain_patterns():
    rng = random.Random(2)
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for _ in range(4000):
        t = "".join(rng.choice("ab@@..12345 -+()é") for _ in range(rng.randrange(40)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)] + [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        want += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))] + [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(digits(m)) <= 15]
        assert pii.find(t) == sorted(want), t


def test_language_id_held_out(spark, odd, nothing):
    rng = random.Random(4)
    syllables = {"aa": ["the", "ing", "wh", "ou", "er"], "bb": ["ção", "lho", "que", "os", "da"], "cc": ["sch", "ung", "ein", "ü", "ch"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(lang, rng.randrange(2, 60)), lang) for i in range(300) for lang in [rng.choice(list(syllables))]]
    train = spark.createDataFrame(rows[:200], "doc_id long, text string, lang string")
    model = langid.fit(train)
    test = spark.createDataFrame(rows[200:] + [(900, None, "aa"), (901, "12 !", "aa"), (902, "жжж ждщ цчш щъы эюя " * 9, "aa")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang, r.language) for r in langid.identify(test, model).collect()}
    assert sum(a == b.lang_pred for i, (a, b) in got.items() if i < 900) >= 98
    assert all(0 <= b.score <= 1 for _, b in got.values()) and not any(b.rejected for i, (_, b) in got.items() if i < 900)
    assert got[900][1].lang_pred == got[901][1].lang_pred == "und" and got[902][1].rejected
    assert langid.identify(nothing, model).count() == 0 and langid.identify(odd, model).count() == 4
    assert langid.fit(nothing) is None and langid.identify(nothing, None).count() == 0
    unlabelled = langid.identify(test, None)
    assert unlabelled.schema["language"].dataType.simpleString() == langid.identify(test, model).schema["language"].dataType.simpleString() == langid.RESULT.replace(": ", ":").replace(", ", ",")
    assert {tuple(r.language) for r in unlabelled.collect()} == {("und", 0.0, None, False)}


def test_lm_base_is_exact_and_model_is_normalised(corpus, odd, nothing):
    df, texts = corpus
    c = Counter()
    toks = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    for i, w in toks.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    for r in lm.score(df).collect():
        w = toks[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(w), sum(c[x] > 0 for x in w))
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9) and r.score < 0
    assert lm.score(nothing).count() == 0 and lm.score(odd).count() == 4
    net = lm.Network(np.array([50.0, 20, 9, 8, 7, 3, 2, 1]))
    h = np.random.default_rng(0).standard_normal((5, lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(net.outputs(h, np.full(5, y))[0]) for y in range(8))
    assert np.allclose(total, 1, atol=1e-5)
    # state is carried from window to window: the window's length changes nothing
    docs = [np.array([2, 3, 4, 5] * 40 + [1], np.int32), np.array([1], np.int32), np.array([6, 7, 1], np.int32)]
    assert np.allclose(net.log_probabilities(docs, 2, 7), net.log_probabilities(docs, 3, 64), rtol=1e-4)


def test_lm_gradient_and_learning():
    counts = np.array([40.0, 30, 20, 10, 5, 5])
    net = lm.Network(counts, seed=1)
    streams = np.tile(np.array([2, 3, 4, 5, 1], np.int32), 200).reshape(-1, 1).repeat(4, axis=1)
    fresh = streams == 2
    docs = [np.array([2, 3, 4, 5, 1], np.int32)]
    before = net.log_probabilities(docs)[0]
    net.train(streams, fresh, rate=1e-2)
    assert net.log_probabilities(docs)[0] > before / 2


def plain_lm(net, ids, fresh):
    """Log probability of each id of one stream, by the formulas of the unit and of the two softmaxes, in doubles."""
    w, u = {k: v.astype(float) for k, v in net.w.items()}, lm.HIDDEN
    sigmoid, log_softmax = (lambda x: 1 / (1 + np.exp(-x))), (lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max())
    h, before, out = np.zeros(u), 1, []
    for y, new in zip(ids, fresh, strict=True):
        h, before = (np.zeros(u), 1) if new else (h, before)
        p, q = w["E"][before] @ w["X"] + w["b"], h @ w["U"]
        keep, reset = sigmoid(p[:u] + q[:u]), sigmoid(p[u:2 * u] + q[u:2 * u])
        h = keep * h + (1 - keep) * np.tanh(p[2 * u:] + reset * q[2 * u:])
        m = net.members[net.cls[y]]
        out.append(log_softmax(h @ w["C"] + w["c"])[net.cls[y]] + log_softmax(w["W"][m] @ h + w["v"][m])[net.place[y]])
        before = y
    return np.array(out)


def test_lm_is_its_formula():
    rng = np.random.default_rng(4)
    net = lm.Network(np.sort(rng.integers(1, 900, 130))[::-1].astype(float), seed=3)
    for far in (1, 40):  # logits far from 0 too
        net.w["W"] *= np.float32(far)
        docs = [np.append(rng.integers(2, 130, n), 1).astype(np.int32) for n in (0, 1, 30, 70, 5)]
        want = [plain_lm(net, d, np.arange(len(d)) == 0).sum() for d in docs]
        assert np.allclose(net.log_probabilities(docs, 2, 8), want, rtol=1e-4)


def test_lm_trains_along_the_gradient():
    rng = np.random.default_rng(5)
    net = lm.Network(np.sort(rng.integers(1, 900, 130))[::-1].astype(float), seed=3)
    ids, fresh = rng.zipf(1.5, (lm.STEPS, 3)).clip(1, 129).astype(np.int32), rng.random((lm.STEPS, 3)) < 0.2
    fresh[0] = True
    loss = lambda: -np.mean([plain_lm(net, ids[:, s], fresh[:, s]) for s in range(3)])
    first = {k: v.astype(float) for k, v in net.w.items()}
    net.train(ids, fresh, rate=1e-3)
    moved = {k: v - first[k] for k, v in net.w.items()}  # the first update of a weight is the rate, against its gradient's sign
    checked = 0
    for k, w in first.items():
        net.w = {n: v.copy() for n, v in first.items()}
        for at in rng.choice(w.size, min(w.size, 25), replace=False):
            flat = net.w[k].ravel()
            sides = []
            for eps in (1e-4, -1e-4):
                flat[at] = w.flat[at] + eps
                sides.append(loss())
            flat[at] = w.flat[at]
            slope = (sides[0] - sides[1]) / 2e-4
            if abs(slope) > 1e-4:
                checked += 1
                assert moved[k].flat[at] * slope < 0 and math.isclose(abs(moved[k].flat[at]), 1e-3, rel_tol=0.05), (k, at)
    assert checked > 80


def test_lm_words_of_slices(monkeypatch):
    texts = [None, "", "  \n\t ", " Ab  C\x0b\x0cD\x1c\x1dE\x85f g\xa0\u00c9 I\u0130 x ", "".join("a" + chr(c) for c in range(0x2100)), "x", "日本 🙂", "a" * 90]
    want = [[w.encode() for w in re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for t in texts]
    for most in (16, 1 << 20):
        monkeypatch.setattr(lm, "SLICE_TEXT", most)
        got = []
        for piece in lm._pieces(pa.array([*texts, "cut"]).slice(0, len(texts))):
            words, text = lm._words(piece)
            got += [[w for w, t in zip(words.to_pylist(), text.tolist(), strict=True) if t == i] for i in range(len(piece))]
        assert got == want


def test_lm_spells_only_words_of_texts_not_learned_from(monkeypatch):
    spelt = []
    spelling = lm.Lexicon.spelling
    monkeypatch.setattr(lm.Lexicon, "spelling", lambda self, words: spelt.extend(words) or spelling(self, words))
    lexicon = lm.Lexicon([b"a", b"b"], np.array([3, 2]), 9, 6, 2)
    box = type("Box", (), {"value": (lm.Network(lexicon.model_counts()), lexicon)})()
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array([1, 2, None], pa.int64()), pa.array(["a rare rare Once", "b new a RARE new", None]), pa.array([True, False, False])], names=["uid", "doc_id", "text", "learned"])
    rows = [r for out in lm._score(box)([batch]) for r in out.to_pylist()]
    assert sorted(spelt) == [b"new", b"rare"]
    assert sorted((r["uid"], r["word"], r["tf"]) for r in rows if r["tf"]) == [(7, b"once", 1), (7, b"rare", 2), (8, b"new", 2), (8, b"rare", 1)]
    assert [(r["uid"], r["doc_id"], r["n_tokens"], r["n_known"]) for r in rows if not r["tf"]] == [(7, 1, 5, 2), (8, 2, 6, 3), (9, None, 1, 1)]
    assert all(r["spelled"] < 0 for r in rows if r["word"] in spelt and r["uid"] == 8)


def test_lm_sums_rows_by_symbol():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 300), (70_000, 900), (40, 40)):
        symbols, rows = rng.integers(0, n, m), rng.standard_normal((m, 3))
        want = np.zeros((n, 3))
        np.add.at(want, symbols, rows)
        assert np.allclose(lm._sum_by_symbol(rows, symbols, n), want)


@pytest.mark.parametrize("n", [300, 20_000])
def test_lm_shards_learn_from_every_document(spark, tmp_path, monkeypatch, n):
    def counting(box, weights, side, rate):
        def run(batches):
            import uuid

            docs = sum(b.num_rows for b in batches)
            (tmp_path / f"{'warm' if weights is None else 'shard'}-{uuid.uuid4()}").write_text(str(docs))
            yield lm._row(lm.Network(box.value.model_counts()).w, 1)
        return run

    monkeypatch.setattr(lm, "_fit", counting)
    lm.fit(spark.range(n).withColumn("text", F.lit("a b c")), lm.Lexicon([b"a", b"b", b"c"], np.array([n, n, n]), 4 * n, 4, n), n)
    seen = lambda kind: [int(p.read_text()) for p in tmp_path.glob(f"{kind}-*")]
    assert sum(seen("shard")) == n and len(seen("shard")) == max(1, n // lm.SHARD_DOCS) and 0 < sum(seen("warm")) <= 1100


def test_lm_learns_from_every_token():
    docs = [np.array([2, 3, 4, 5, 1], np.int32)] * 27
    ids, fresh = lm._streams(docs, 4)
    assert ids.T.ravel()[:135].tolist() == np.concatenate(docs).tolist() and fresh.sum() == 28
    box = type("Box", (), {"value": lm.Lexicon([b"a", b"b"], np.array([3, 2]), 6, 3, 1)})()
    batch = pa.RecordBatch.from_arrays([pa.array(["a b a"])], names=["text"])
    few = list(lm._fit(box, None, 64, 3e-3)([batch]))
    assert len(few) == 1 and few[0].column(0)[0].as_py() != lm._row(lm.Network(box.value.model_counts()).w, 1).column(0)[0].as_py()


def test_winnowing_guarantee_and_edits(spark, texts, odd, nothing):
    df, held = texts
    order = sorted(held, reverse=True)
    rows = {r.doc_id: r for r in winnow.edits(df).collect()}
    for j, i in enumerate(order):
        t, nxt = held[i], held[order[(j + 1) % len(order)]]
        third = len(t) // 3
        edited = t[:len(t) - third] + nxt[:third]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    rng = random.Random(0)
    shared = [f"s{rng.randrange(99)}" for _ in range(winnow.WINDOW + winnow.GRAM - 1)]
    pair = [" ".join([f"{x}{rng.random()}" for _ in range(30)] + shared + [f"{x}{rng.random()}" for _ in range(30)]) for x in "ab"]
    marks = [{m.split("@")[0] for m in r.fingerprint.split(",")} for r in winnow.fingerprints(spark.createDataFrame(list(enumerate(pair)), "doc_id int, text string")).collect()]
    assert marks[0] & marks[1]
    tie = spark.createDataFrame([(1, " ".join(["x"] * 40))], "doc_id int, text string").select(F.explode(winnow.picks(F.col("text"))).alias("v")).select((F.lit((1 << 31) - 1) - F.col("v").bitwiseAND(F.lit((1 << 31) - 1))).alias("p")).collect()
    assert [r.p for r in tie] == list(range(winnow.WINDOW, 38))
    assert winnow.edits(nothing).count() == 0 and winnow.edits(odd).count() == 4


def _kneser_ney(counts, context, letter, order):
    """Interpolated Kneser-Ney by its formula; counts: for each order, those of n-grams (tuples)."""
    if order == 0:
        return 1 / langid._UNICODE
    table, context = counts[order], context[len(context) - order + 1:]
    once, twice = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
    cut = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    after = {g[-1]: c for g, c in table.items() if g[:-1] == context}
    below = _kneser_ney(counts, context, letter, order - 1)
    if not after:
        return below
    return (max(after.get(letter, 0) - cut, 0) + cut * len(after) * below) / sum(after.values())


def test_language_models_are_kneser_ney_and_sum_to_one():
    rng = random.Random(8)
    said = {"aa": ["".join(rng.choice("abbccc  é") for _ in range(rng.randrange(1, 30))) for _ in range(12)], "bb": ["".join(rng.choice("xyzé ") for _ in range(9)) for _ in range(5)] + ["", " ", "q"]}
    alphabet = sorted({ord(c) for texts in said.values() for t in texts for c in t} | {32})
    count = langid._gram_counts(np.array(alphabet))
    both = pa.RecordBatch.from_arrays([pa.array([t for x in said.values() for t in x]), pa.array([k for k, x in said.items() for _ in x])], names=["text", "lang"])
    got = {lang: Counter() for lang in said}
    for b in count([both]):
        for lang, gram, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[lang][gram] += n
    model = langid.build(list(said), np.array(alphabet), {k: (np.array(list(c), np.int64).view(np.uint64), np.array(list(c.values()), float)) for k, c in got.items()})
    letters = [alphabet.index(ord(c)) for c in "abcxyzqé "] + [langid._LETTERS + 1]
    for j, (lang, texts) in enumerate(said.items()):
        tables = {langid.ORDER: Counter()}
        for t in texts:
            padded = " " * (langid.ORDER - 1) + " ".join(t.split()) + (" " if t.strip() and t[-1] == " " else "")
            ids = [alphabet.index(ord(c)) for c in padded]
            tables[langid.ORDER].update(tuple(ids[i:i + langid.ORDER]) for i in range(len(ids) - langid.ORDER + 1))
        for k in range(langid.ORDER - 1, 0, -1):
            tables[k] = Counter(g[1:] for g in tables[k + 1])
        for context in [tuple(rng.choice(letters) for _ in range(langid.ORDER - 1)) for _ in range(60)] + [g[:-1] for g in tables[langid.ORDER]]:
            packed = [sum(int(x) << langid._BITS * (langid.ORDER - 1 - i) for i, x in enumerate((*context, y))) for y in letters]
            p = np.exp(model.score(np.array(packed, np.uint64))[:, j].astype(float))
            assert np.allclose(p, [_kneser_ney(tables, context, y, langid.ORDER) for y in letters], rtol=1e-4)
            assert math.isclose(p[:-1].sum() + p[-1] * (langid._UNICODE - len(letters) + 1), 1, abs_tol=1e-4)


def _winnowed(text):
    """(hash, place) of each fingerprint: word hashes as Spark's, least of each window, rightmost of equal ones."""
    import xxhash

    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t-\r]+", text.lower()) if w]
    if not words:
        return []
    grams = []
    for i in range(max(1, len(words) - winnow.GRAM + 1)):
        h = 42
        for w in words[i:i + winnow.GRAM]:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), h)
        grams.append((h % (1 << 31), i + 1))
    out = []
    for i in range(max(1, len(grams) - winnow.WINDOW + 1)):
        least = min(h for h, _ in grams[i:i + winnow.WINDOW])
        pick = [g for g in grams[i:i + winnow.WINDOW] if g[0] == least][-1]
        if pick not in out:
            out.append(pick)
    return out


def test_winnowing_equals_brute_force(spark, texts):
    df, held = texts
    order = sorted(held, reverse=True)
    shown = lambda picks: ",".join(f"{h:x}@{i}" for h, i in picks)

    def likeness(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    rows = {r.doc_id: r for r in winnow.edits(df).collect()}
    assert len(rows) == len(held)
    for j, i in enumerate(order):
        t, nxt = held[i], held[order[(j + 1) % len(order)]]
        third = len(t) // 3
        own, edited, other = _winnowed(t), _winnowed(t[:len(t) - third] + nxt[:third]), _winnowed(nxt)
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (shown(own), shown(edited)), i
        assert math.isclose(rows[i].near_edited, likeness(own, edited)) and math.isclose(rows[i].near_next, likeness(own, other))


def test_warc_round_trip(spark):
    import io
    import zipfile

    big = "x" * 1000
    rows = [(1, "a", big), (2, "a b", big), (3, None, "é" * 499), (4, "b", "é" * 499), (5, "c", None), (6, "u", big), (None, "n", "lost")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    packages = warc.write_packages(pages)
    got = {r.page_id: r for r in warc.read_packages(packages).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert [got[i].refers_to for i in range(1, 7)] == [6, 6, None, None, None, None]
    for i, _, html in rows[:-1]:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    path = "/" + packages.first().path.removeprefix("file:").lstrip("/")
    assert zipfile.ZipFile(path).testzip() is None
    held = io.BytesIO()
    w = warc.PackageWriter(held, zip64=True)
    for name in ("a", "b"):
        w.begin(name)
        w.add(name.encode() * 3)
        w.end()
    w.close()
    raw = held.getvalue()
    for where in (raw, raw + b""):
        method, at, size = warc.directory(io.BytesIO(where), len(where))["b"]
        assert (method, where[at:at + size]) == (0, b"bbb")
    assert zipfile.ZipFile(held).read("b") == b"bbb"
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"nothing"), 7)
    assert warc.read_packages(warc.write_packages(pages.limit(0))).count() == 0
