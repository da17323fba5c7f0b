"""Benchmark passages in documents, by greedy string tiling over tokens.

Tokens are lower-cased runs of letters and digits. Documents and benchmark items are joined on shared seeds
(Karp-Rabin hashes of MIN_MATCH tokens, rolled over each side by prefix sums). For each pair that shares enough
seeds, common runs are tiled greedily: the longest common run whose tokens are all unmarked on both sides is
marked, again and again, until none of MIN_MATCH tokens is left; so a passage whose sentences are reordered is
covered piece by piece. A document holds an item if the tiles cover at least `coverage` of the item's tokens. An item
of fewer than MIN_MATCH tokens is its own seed: it is held where it occurs whole.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import MARKS, Words, slices, text_buffers
from .shared import small_batches

#: Shortest run of tokens that counts as a match.
MIN_MATCH = 4
#: Share of an item's tokens that tiles must cover.
COVERAGE = 0.5
#: Bytes of benchmark text that one pass over the documents takes; larger benchmarks go in blocks.
BLOCK_BYTES = 32 << 20
RESULT = "doc_id long, item_id long, coverage double, n_tiles int, longest int, tiles array<struct<doc_word: int, item_word: int, words: int>>"


def runs(doc_at: np.ndarray, item_at: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (words, document word, item word) of pairs of equal k-grams."""
    order = np.lexsort((doc_at, doc_at - item_at))
    d, i = doc_at[order], item_at[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] - d[:-1] != 1) | (i[1:] - i[:-1] != 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(d))) + k - 1
    return list(zip(length.tolist(), d[begin].tolist(), i[begin].tolist(), strict=True))


def tiles(common: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (document word, item word, words), longest first, ties to the earliest in item and document.

    A run that meets a marked token is cut at it; pieces of at least k words wait for their turn.
    """
    heap = [(-n, i, d) for n, d, i in common]
    heapq.heapify(heap)
    doc_marks, item_marks, out = set(), set(), []
    while heap:
        n, i, d = heapq.heappop(heap)
        free = [d + j not in doc_marks and i + j not in item_marks for j in range(-n)]
        if all(free):
            doc_marks.update(range(d, d - n))
            item_marks.update(range(i, i - n))
            out.append((d, i, -n))
            continue
        j = 0
        while j < -n:
            e = j
            while e < -n and free[e]:
                e += 1
            if e - j >= k:
                heapq.heappush(heap, (j - e, i + j, d + j))
            j = e + 1
    return out


class Items:
    """Token counts and seeds of a block of benchmark items; items without tokens are left out."""

    def __init__(self, ids: list[int], texts: list[str], k: int):
        at, data = text_buffers(pc.utf8_lower(pa.array(texts, pa.string())))
        words = Words(at, data, 0, len(ids), fold=True, breaks=MARKS)
        self.ids, self.size, self.k = np.array(ids, np.int64), words.count, k
        # seeds by their length: k tokens, or all of an item that has fewer
        self.seeds = {}
        for length in range(1, k + 1):
            row, first, seed = words.grams(length)
            mine = np.flatnonzero((self.size[row] == length) | (length == k))
            mine = mine[np.argsort(seed[mine], kind="stable")]
            if len(mine):
                self.seeds[length] = (seed[mine], row[mine], (first - words.first[row])[mine])

    def matches(self, words: Words):
        """(row, item, tiles) of rows that share seeds with an item."""
        for length in self.seeds:
            yield from self._matches(words, length)

    def _matches(self, words: Words, k: int):
        known, items, places = self.seeds[k]
        row, first, seed = words.grams(k)
        lo = np.searchsorted(known, seed, "left")
        hit = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == seed)
        if not len(hit):
            return
        lo, hi = lo[hit], np.searchsorted(known, seed[hit], "right")
        which = np.repeat(np.arange(len(hit)), hi - lo)
        entry = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
        row, item = row[hit][which], items[entry]
        doc_at, item_at = (first - words.first[row_of(words, first)])[hit][which], places[entry]
        order = np.lexsort((item_at, item, row))
        row, item, doc_at, item_at = row[order], item[order], doc_at[order], item_at[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        begin = np.append(np.flatnonzero(new), len(row))
        fresh = new.copy()
        fresh[1:] |= item_at[1:] != item_at[:-1]
        seeds = np.add.reduceat(fresh, begin[:-1])
        for j in np.flatnonzero(seeds * k >= np.ceil(self.need * self.size[item[begin[:-1]]])):
            a, b = begin[j], begin[j + 1]
            yield int(row[a]), int(item[a]), tiles(runs(doc_at[a:b], item_at[a:b], k), k)

    need = COVERAGE


def row_of(words: Words, first: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.first, first, "right") - 1


def _match(box, coverage: float):
    def run(batches):
        items = box.value
        items.need = coverage
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at, data = text_buffers(pc.utf8_lower(batch.column(1)))
            for lo, hi in slices(at):
                out = []
                for r, i, tiled in items.matches(Words(at, data, lo, hi, fold=True, breaks=MARKS)):
                    share = sum(t[2] for t in tiled) / int(items.size[i])
                    if share >= coverage:
                        out.append({"doc_id": ids[lo + r], "item_id": int(items.ids[i]), "coverage": share, "n_tiles": len(tiled), "longest": tiled[0][2], "tiles": [{"doc_word": d, "item_word": j, "words": n} for d, j, n in tiled]})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest", pa.int32()), ("tiles", pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())])))])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, k: int = MIN_MATCH) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest, tiles): the pairs whose tiles cover enough of the item.

    The benchmark is broadcast in blocks of bounded size, one pass over the documents each; no document is
    shuffled. Null and empty texts and items match nothing; repeated rows match each for itself.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        box = spark.sparkContext.broadcast(Items(part.column("item_id").to_pylist(), part.column("text").to_pylist(), k))
        found = texts.mapInArrow(_match(box, coverage), RESULT)
        out = found if out is None else out.unionByName(found)
    return out
