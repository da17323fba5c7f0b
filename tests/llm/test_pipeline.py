"""The pipeline's stages on a small corpus, against brute force."""

import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_pairs_and_spans import classes, tiled_by_brute_force


def test_stages_match_brute_force(spark, tmp_path):
    rng = random.Random(11)
    sound = {"xa": ["ka", "to", "mi", "ru", "ne"], "xb": ["str", "elb", "ung", "ach", "ein"]}
    word = lambda lang: "".join(rng.choice(sound[lang]) for _ in range(rng.randrange(1, 4)))
    item = " ".join(word("xa") for _ in range(24))
    texts = []
    for i in range(120):
        lang = "xa" if i % 2 else "xb"
        texts.append((" ".join(word(lang) for _ in range(rng.choice([12, 60, 150]))), lang))
    for i in (3, 4, 10):
        w = texts[i][0].split()
        texts += [(texts[i][0], texts[i][1]), (" ".join(["altered", *w[1:]]), texts[i][1])]
    fresh = lambda n: " ".join(word("xa") for _ in range(n))
    texts += [(f"{fresh(40)} {item}", "xa"), (f"{fresh(40)} mail jane@host.example now", "xa"), (None, "xa"), ("", "xb"), ("12345 +++ 678", None)]
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    first = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert set(kept["language_id"]) == set(first)
    unique = {i for i, (_, component) in classes(first).items() if i == component}
    assert set(kept["near_duplicates"]) == unique and len(unique) < len(first) - 5
    holds = {i for i in unique if tiled_by_brute_force(first[i].split(), item.split(), 4) >= 12}
    assert len(holds) == 1 and set(kept["decontamination"]) == unique - holds
    assert all("jane@host.example" not in r.text and r.n_chars == len(r.text) for r in kept["pii"].values()) and set(kept["pii"]) == unique - holds
    assert sum(r.text != first[i] for i, r in kept["pii"].items()) == 1
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, r in kept["bpe"].items():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(kept["pii"][i].text, add_special_tokens=False).ids and r.n_tokens * 4 == len(r.ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(tuple(r) for r in kept["bpe"].values())


def test_stages_take_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_counting_words_holds_a_bounded_number(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    from skein.llm import bpe

    monkeypatch.setattr(bpe, "HELD_WORDS", 1000, raising=False)
    monkeypatch.setattr(bpe, "_SLICE", 500)
    texts = [" ".join(f"w{i % 37}x{(i * j) % 4099}" for i in range(60)) for j in range(200)]
    path = P.path("byte_bpe_50k.json")
    found, total = list(bpe._counts(path)(iter([pa.record_batch([pa.array(texts)], names=["text"])]))), Counter()
    for batch in found:
        total.update(dict(zip(*map(pa.Array.to_pylist, batch.columns), strict=True)))
    want = Counter(w for t in texts for w in bpe.vocabulary(path).words(t))
    assert total == want and len(want) > 2000 and len(found) > 1
    assert max(b.num_rows for b in found) <= 1000 + 2000


def test_batches_of_texts_are_small(spark):
    from skein.llm.shared import small_batches

    small_batches(spark)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    assert 0 < size <= 2 << 20
