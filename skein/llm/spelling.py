"""Spelling variants: words one edit apart by merging light subtrees of their trie, and the common form of each.

The trie of all words isn't built in one place: its edges are rows (node, child), a node being the hash of a prefix,
and one aggregate finds each node's heavy child, below which most words end. A word leaves heavy paths at no more
than log2(words) nodes. Only there is it copied into the errata tree of the node, small subtrees into the large one:
with the character at the node skipped, replaced by the heavy child's, or set behind it. Terminals that coincide are
words one edit apart, and each such pair meets once, at the node where the two words part:

* one of them goes on along the heavy path: the other one's copy, with the heavy character in place of its own or
  before it, coincides with that word, or its own copy without the character does;
* both leave it, by different characters: their copies with the character left open coincide. All words of such a
  group are one edit apart, no more of them than there are letters, so a window counts them and finds the best one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import mix
from .shared import bounded, materialise, small_batches

LETTERS = 7
TIMES = 2
RATIO = 10
#: One run in so many, by a checksum, has a letter deleted.
ERRATA = 31
#: Distinct words of a task's count before it is handed to the shuffle.
KEPT = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_OPEN = "*"


def _runs(least: int, errata: int):
    """(word, n) of the runs of letters of each text, a letter deleted where the checksum of id and run says so."""
    find = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), pc.ascii_lower(batch.column(1)), strict=True):
                if not text.is_valid:
                    continue
                prefix = f"{doc.as_py() if doc.is_valid else ''}:"
                for word, n in Counter(find(text.as_py())).items():
                    h = zlib.crc32((prefix + word).encode())
                    if h % errata == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) > KEPT:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)
    return run


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LETTERS, times: int = TIMES, errata: int = ERRATA) -> DataFrame:
    """(word, n) of the words of `least` letters or more that occur `times` times or more in all texts."""
    small_batches(docs.sparkSession)
    runs = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(_runs(least, errata), "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _edges(batches):
    """(node, child, depth, id) of the nodes along each word: hash of the prefix, and the next letter's code or 0."""
    for batch in batches:
        raw = [w.encode("latin-1") for w in batch.column(1).to_pylist()]
        ids = batch.column(0).to_numpy()
        lo = 0
        while lo < len(raw):  # about a million rows at a time
            hi, size = lo, 0
            while hi < len(raw) and (hi == lo or size + len(raw[hi]) < 1 << 20):
                size += len(raw[hi]) + 1
                hi += 1
            data = np.frombuffer(b"\0".join(raw[lo:hi]) + b"\0", np.uint8)
            length = np.array([len(w) + 1 for w in raw[lo:hi]])
            begin = np.repeat(np.cumsum(length) - length, length)
            n = len(data)
            up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * up)])[:-1]
            depth = np.arange(n) - begin
            node = mix((total - total[begin]) * down[begin] + mix(depth.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(data.astype(np.int16)), pa.array(depth.astype(np.int32)), pa.array(np.repeat(ids[lo:hi], length))], names=["node", "child", "depth", "id"])
            lo = hi


def heavy_children(edges: DataFrame) -> DataFrame:
    """(node, heavy): the letter below which most words end, of the nodes that have another child or end a word."""
    below = edges.groupBy("node", "child").agg(F.count("*").alias("words"))
    order = F.struct(F.when(F.col("child") > 0, F.col("words")).otherwise(0).alias("words"), F.col("child"))
    nodes = below.groupBy("node").agg(F.max(order).alias("best"), F.count("*").alias("children"))
    return nodes.where("children > 1").select("node", F.col("best.child").alias("heavy"))


def light_places(words: DataFrame) -> DataFrame:
    """(word, n, depth, heavy, own): where each word leaves a heavy path, and the heavy letter there; own is '' at its end.

    words: (id, word, n), written. Which child is heavy decides how many rows there are, not which pairs are found.
    """
    edges = words.select("id", "word").mapInArrow(_edges, "node long, child short, depth int, id long")
    heavy = materialise(heavy_children(edges), "heavy")
    left = edges.join(heavy, "node").where("child <> heavy").select("id", "depth", "heavy")
    # no more than log2(words) places for each word
    places = materialise(left.groupBy("id").agg(F.collect_list(F.struct("depth", "heavy")).alias("places")), "places")
    each = words.join(places, "id").select("word", "n", F.inline("places"))
    return each.select("word", "n", "depth", F.char(F.col("heavy").cast("int")).alias("heavy"), F.substring("word", F.col("depth") + 1, F.lit(1)).alias("own"))


def _better(n: Column, word: Column) -> Column:
    """Least for the largest n, ties for the smallest word."""
    return F.struct((-n).alias("n"), word.alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): the number of words one edit away, and (-n, word) of the most frequent one.

    words: (id, word, n), written; words without a near one are left out.
    """
    light = materialise(light_places(words), "light")
    head, tail = F.substring("word", F.lit(1), F.col("depth")), F.substring("word", F.col("depth") + 2, F.length("word"))
    after = F.substring("word", F.col("depth") + 2, F.lit(1))
    inserted = F.concat(head, F.col("heavy"), F.col("own"), tail)
    replaced = F.when(F.col("own") != "", F.concat(head, F.col("heavy"), tail))
    # without its letter, unless the next one is the same: that pair parts further on
    skipped = F.when((F.col("own") != "") & (F.col("own") != after), F.concat(head, tail))
    copies = light.select("word", "n", F.explode(F.array_compact(F.array(inserted, replaced, skipped))).alias("copy"))
    met = copies.join(words.select(F.col("word").alias("copy"), F.col("n").alias("m")), "copy")
    pairs = met.select(F.explode(F.array(
        F.struct(F.col("word"), F.lit(1).cast("long").alias("near"), _better(F.col("m"), F.col("copy")).alias("best")),
        F.struct(F.col("copy").alias("word"), F.lit(1).cast("long").alias("near"), _better(F.col("n"), F.col("word")).alias("best")))).alias("x")).select("x.*")
    group = Window.partitionBy("open")
    order = group.orderBy(F.desc("n"), "word")
    # the best other word of a group's first one is the second, of all others the first
    beside = F.when(F.row_number().over(order) == 1, F.lead(_better(F.col("n"), F.col("word"))).over(order)).otherwise(F.first(_better(F.col("n"), F.col("word"))).over(order))
    opened = light.where("own <> ''").select("word", "n", F.concat(head, F.lit(_OPEN), tail).alias("open"))
    groups = opened.select("word", (F.count("*").over(group) - 1).alias("near"), beside.alias("best")).where("near > 0")
    return pairs.unionByName(groups).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form), written, followed to their end by doubling; forms lead to ever rarer words' ends."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        step = at.join(bounded(at.select(F.col("word").alias("root"), F.col("root").alias("next"))), "root", "left")
        step = materialise(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LETTERS, times: int = TIMES, ratio: int = RATIO, errata: int = ERRATA) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary.

    form is the near word of largest n (ties: the smallest) where that is `ratio` times the word's own or more, else
    null; root the last of the forms of forms, the word itself where it has none. Null and empty texts have no
    words; a null id counts as an empty one in the checksum; repeated rows count each time. Runs of any length are
    words. An empty table gives no rows.
    """
    counted = vocabulary(docs, id_col, text_col, least, times, errata)
    words = materialise(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = materialise(near_words(words), "near")
    held = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best"))
    held = materialise(held.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n")), "forms")
    last = roots(materialise(held.where("form is not null").select("word", "form"), "forms"))
    return held.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
