"""Removal of long repeated word spans, by de Bruijn compaction over sampled token k-mers.

Every WINDOW-word window holds at least one of the k-mers that winnowing picks (the least hash among the window's
k-mers), and equal windows hold the same ones. So only picked k-mers are shuffled. Those of two documents or more
are the nodes of a de Bruijn graph whose edges join nodes that follow each other in a text at the same distance;
nonbranching paths are compacted to one span for each document they run through. Around these spans source
coordinates are verified: all windows there are hashed whole, to 128 bits, each window's least document is found, and
words of windows that a smaller document has are removed. Texts of equal words are one document from the start.

Rows are told apart by their id and `turn`: 0 where an id has one text of WINDOW words or more, the text's hash else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Words, slices, text_buffers
from .shared import BROADCAST_ROWS, bounded, materialise

WINDOW = 50
KMER = 12
#: Rows of a broadcast side of several columns at most.
_WIDE = BROADCAST_ROWS // 20
RESULT = "struct<n_words: long, n_removed: long, kept_sha256: string>"


def picked(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the k-mers picked by the windows of `window` words."""
    at, value = words.long_grams(k)
    w = window - k + 1
    n = len(words.hash)
    if n < window:
        return at[:0], value[:0]
    full = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    full[at] = value
    row = words.rows()
    start = np.flatnonzero(row[:n - window + 1] == row[window - 1:])
    # least of w k-mers by doubling, then the greatest of these leasts over the windows around a k-mer
    least = _slide(np.minimum, full, w)[start]
    around = np.zeros(n + w - 1, np.uint64)
    around[start + w - 1] = least
    found = np.flatnonzero(_slide(np.maximum, around, w) == full)
    return found, full[found]


def _slide(least, values: np.ndarray, w: int) -> np.ndarray:
    """least.reduce of values[i:i + w] for each i that has w values."""
    out, width = values, 1
    while width * 2 <= w:
        out = least(out[:len(out) - width], out[width:])
        width *= 2
    n = len(values) - w + 1
    return least(out[:n], out[w - width:w - width + n])


def _keys(batches):
    for batch in batches:
        at, data = text_buffers(batch.column(1))
        for lo, hi in slices(at):
            words = Words(at, data, lo, hi, fold=False)
            a, b = words.text_keys()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(words.count.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["doc", "tk", "n", "k1", "k2"])


def _seeds(window: int, k: int):
    def run(batches):
        for batch in batches:
            ids, turn = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            at, data = text_buffers(batch.column(1))
            for lo, hi in slices(at):
                words = Words(at, data, lo, hi, fold=False)
                place, value = picked(words, window, k)
                row = np.searchsorted(words.first, place, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array((value >> np.uint64(1)).view(np.int64)), pa.array(ids[lo + row]), pa.array(turn[lo + row]), pa.array((place - words.first[row]).astype(np.int32))], names=["seed", "doc", "turn", "at"])
    return run


def _windows(window: int, k: int):
    """Hashes of the windows that hold a seed of one of the row's spans (first and last seed, interleaved)."""
    def run(batches):
        for batch in batches:
            ids, turn = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            at, data = text_buffers(batch.column(1))
            spans = batch.column(3)
            for lo, hi in slices(at):
                words = Words(at, data, lo, hi, fold=False)
                near = np.zeros(len(words.hash) + 1, np.int32)
                for r in range(lo, hi):
                    span = np.array(spans[r].as_py() or [], np.int64).reshape(-1, 2)
                    base, last = words.first[r - lo], words.first[r - lo + 1]
                    np.add.at(near, np.clip(base + span[:, 0] + k - window, base, last), 1)
                    np.add.at(near, np.clip(base + span[:, 1] + 1, base, last), -1)
                start, value = words.long_grams(window)
                take = np.cumsum(near)[start] > 0
                other = words.long_grams(window, second=True)[1][take]
                start, value = start[take], value[take]
                row = np.searchsorted(words.first, start, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(other.view(np.int64)), pa.array(ids[lo + row]), pa.array(turn[lo + row]), pa.array((start - words.first[row]).astype(np.int32))], names=["win", "win2", "doc", "turn", "at"])
    return run


def _runs(window: int):
    """Runs of covered words (first, end, first, end ...) of window starts."""
    def run(starts: pa.Array) -> pa.Array:
        out = []
        for s in starts:
            at = np.unique(np.array(s.as_py(), np.int64))
            cut = np.flatnonzero(np.diff(at) > window) + 1
            out.append(np.column_stack([at[np.append(0, cut)], at[np.append(cut - 1, len(at) - 1)] + window]).ravel().tolist())
        return pa.array(out, pa.list_(pa.int32()))
    return run


def _kept(window: int):
    def run(text: pa.Array, runs: pa.Array, copy: pa.Array) -> pa.Array:
        n, gone, kept = [], [], []
        for t, s, c in zip(text, runs, copy, strict=True):
            words = (t.as_py() or "").encode().split()
            keep = words
            if len(words) < window:  # may share its id with a longer text
                pass
            elif c.as_py():
                keep = []
            elif s.is_valid:
                cover = np.zeros(len(words) + 1, np.int32)
                place = np.array(s.as_py(), np.int64)
                cover[place[::2]] += 1
                cover[place[1::2]] -= 1
                cover = np.cumsum(cover[:-1]) == 0
                keep = [w for w, k in zip(words, cover.tolist(), strict=True) if k]
            n.append(len(words))
            gone.append(len(words) - len(keep))
            kept.append(hashlib.sha256(b" ".join(keep)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept_sha256"])
    return run


ROW = ["doc", "turn"]


def compacted(seeds: DataFrame) -> DataFrame:
    """(doc, turn, first, last): spans of texts along nonbranching paths, by their first and last seed's place.

    seeds: (seed, doc, turn, at) of nodes that two documents or more hold.
    """
    along = Window.partitionBy(*ROW).orderBy("at")
    step = seeds.withColumn("next", F.lead("seed").over(along)).withColumn("gap", F.lead("at").over(along) - F.col("at"))
    edges = materialise(step, "edges")
    edge = materialise(edges.where("next is not null").groupBy("seed", "next", "gap").agg(F.lit(1).alias("one")), "steps")
    leaves = edge.groupBy("seed").agg(F.count("*").alias("out"))
    enters = edge.groupBy(F.col("next").alias("seed")).agg(F.count("*").alias("into"))
    plain = materialise(leaves.join(enters, "seed", "left").where((F.col("out") == 1) & (F.coalesce("into", F.lit(0)) <= 1)).select("seed", F.lit(True).alias("plain")), "plain")
    # an edge goes on along the path if the node it leaves does not branch; a last node ends its path anyway
    path = materialise(edges.join(bounded(plain, _WIDE), "seed", "left").withColumn("plain", F.when(F.col("next").isNull(), None).otherwise(F.coalesce("plain", F.lit(False)))), "paths")
    back = F.lag("plain").over(along)
    cut = path.withColumn("new", F.when(F.coalesce(back, F.lit(False)) & F.coalesce("plain", F.lit(True)), 0).otherwise(1))
    group = cut.withColumn("path", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return group.groupBy(*ROW, "path").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("path")


def repeated_starts(reps: DataFrame, window: int = WINDOW, k: int = KMER) -> DataFrame:
    """(doc, turn, at): starts of windows that also start in a document of smaller id; reps: (doc, text, turn)."""
    seeds = reps.select("doc", "text", "turn").mapInArrow(_seeds(window, k), "seed long, doc long, turn long, at int")
    seeds = materialise(seeds, "seeds")
    # shared seeds are written first: the join with them is broadcast, or a plain one that may be split where a seed is hot
    shared = materialise(seeds.groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("seed"), "shared")
    spans = compacted(seeds.join(bounded(shared, _WIDE), "seed").distinct())
    # a seed alone spans itself; windows around a span are those that hold one of its seeds
    lists = materialise(spans.groupBy(*ROW).agg(F.flatten(F.collect_list(F.array("first", "last"))).alias("spans")), "spans")
    texts = reps.join(bounded(lists.select(*ROW), _WIDE), ROW, "left_semi").join(lists, ROW).select("doc", "text", "turn", "spans")
    wins = materialise(texts.mapInArrow(_windows(window, k), "win long, win2 long, doc long, turn long, at int"), "windows")
    least = materialise(wins.groupBy("win", "win2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("win", "win2", "lo"), "least")
    return wins.join(bounded(least, _WIDE), ["win", "win2"]).where("doc > lo").select("doc", "turn", "at").distinct()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = KMER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row.

    Null and empty texts have no words; rows with a null id keep all theirs. Of rows that repeat an id each is
    judged by its own text; a repeat inside one id removes nothing.
    """
    frame = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    keyed = frame.select("doc", "text", F.xxhash64("text").alias("tk")).mapInArrow(_keys, "doc long, tk long, n long, k1 long, k2 long")
    keyed = materialise(keyed.where(f"doc is not null and n >= {window}"), "keys")
    several = materialise(keyed.groupBy("doc").agg(F.min("tk").alias("lo"), F.max("tk").alias("hi")).where("lo < hi").select("doc", F.lit(True).alias("several")), "several")
    alone = several.isEmpty()

    def turned(rows: DataFrame, key: Column) -> DataFrame:
        """rows with their turn; where no id has several texts all turns are 0, without a join."""
        if alone:
            return rows.withColumn("turn", F.lit(0).cast("long"))
        return rows.join(bounded(several), "doc", "left").withColumn("turn", F.when(F.col("several"), key).otherwise(F.lit(0).cast("long"))).drop("several")

    frame = turned(frame, F.xxhash64("text"))
    least = materialise(keyed.groupBy("k1", "k2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("k1", "k2", "lo"), "least")
    copies = materialise(turned(keyed.join(bounded(least, _WIDE), ["k1", "k2"]).where("doc > lo").select("doc", "tk"), F.col("tk")).select(*ROW).distinct(), "copies")
    reps = frame.where("doc is not null").join(bounded(copies), ROW, "left_anti")
    starts = repeated_starts(reps, window, k).groupBy(*ROW).agg(F.collect_list("at").alias("starts"))
    edits = materialise(starts.select(*ROW, F.arrow_udf(_runs(window), "array<int>")("starts").alias("runs"), F.lit(False).alias("copy")).unionByName(copies.select(*ROW, F.lit(None).cast("array<int>").alias("runs"), F.lit(True).alias("copy"))), "edits")
    small = edits.agg(F.sum(F.coalesce(F.size("runs"), F.lit(0))).alias("n"), F.count("*").alias("c")).first()
    side = F.broadcast(edits) if (small.n or 0) <= 4 * BROADCAST_ROWS and small.c <= BROADCAST_ROWS else edits
    both = frame.join(side, ROW, "left")
    return both.select(F.col("doc").alias("doc_id"), F.arrow_udf(_kept(window), RESULT).asNondeterministic()("text", "runs", "copy").alias("r")).select("doc_id", "r.*")
