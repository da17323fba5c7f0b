"""Ranked lexical search by windowed bucket scoring: every document against a set of query items.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A first pass over
the texts writes postings of the items' terms, one row for each document (its length, its terms and how often each
occurs), and gives the statistics that scores need. Postings are then ranged by doc_id and scored window by window:
a window is WINDOW consecutive documents of a range in the order of their ids. The postings of each of an item's
terms are scattered into one array of a place for each document of the window, and a bitmap of groups of 64 places
tells which of them are occupied; only these are harvested, into a heap of the item's best documents of the task,
whose least score is the bound that later windows must beat. A task returns one heap for each item, and the best
of all heaps are ranked.

Items are taken in blocks of about BLOCK_TERMS terms, one pass over the documents each, so that the broadcast of a
block doesn't grow with the number of items; it is destroyed when the block is done.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import MARKS, Words, slices, text_buffers
from .shared import materialise, small_batches

TOP = 50
#: Documents of a window: their scores fit a processor's second-level cache.
WINDOW = 8192
#: Terms of a block of items in expectation, repeated for each item that has them.
BLOCK_TERMS = 1_000_000
_POSTINGS = "doc long, n long, terms array<int>, tf array<int>"
_GROUP = 64


def _item_terms(batches):
    """(item, term) of the distinct terms of each text."""
    for batch in batches:
        at, data = text_buffers(batch.column(1))
        for lo, hi in slices(at):
            words = Words(at, data, lo, hi, fold=True, breaks=MARKS)
            both = np.unique(np.stack([words.rows().astype(np.uint64), words.hash]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(both[0].astype(np.int64) + lo)), pa.array(both[1].view(np.int64))], names=["item", "term"])


class Block:
    """Items as lists of places in their common, sorted vocabulary of term hashes."""

    def __init__(self, table: pa.Table):
        items = table.column("item").combine_chunks()
        self.ids = items.unique()
        owner = items.dictionary_encode().indices.to_numpy()
        self.terms, place = np.unique(table.column("term").to_numpy().view(np.uint64), return_inverse=True)
        order = np.argsort(owner, kind="stable")
        self.lists = np.split(place[order], np.cumsum(np.bincount(owner, minlength=len(self.ids)))[:-1])


def _post(box):
    """Postings of each text that has a term: (doc, n, terms, tf); terms are places in the block's vocabulary."""
    def run(batches):
        vocabulary = box.value.terms
        for batch in batches:
            at, data = text_buffers(batch.column(1))
            for lo, hi in slices(at):
                words = Words(at, data, lo, hi, fold=True, breaks=MARKS)
                place = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
                held = vocabulary[place] == words.hash
                key, tf = np.unique(words.rows()[held] * len(vocabulary) + place[held], return_counts=True)
                row, term = np.divmod(key, len(vocabulary))
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)), pa.array(x.astype(np.int32))) for x in (term, tf)]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words.count.astype(np.int64)), *lists], names=["doc", "n", "terms", "tf"])
                yield out.filter(pa.array(words.count > 0))
    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 50 + (50 * n * documents) div total, by whole numbers of any size where 64 bits are too few."""
    if 50 * int(n.max(initial=0)) * documents < 1 << 63:
        return 50 + 50 * n * documents // total
    return np.array([50 + 50 * int(x) * documents // total for x in n], np.int64)


class Buckets:
    """The scores of one window, scattered term by term, and each item's heap over all windows of a task."""

    def __init__(self, block: Block, weights: np.ndarray, documents: int, total: int, top: int):
        self.block, self.weights, self.documents, self.total, self.top = block, weights, documents, total, top
        self.score = np.zeros(-(-WINDOW // _GROUP) * _GROUP, np.int64)
        self.occupied = np.zeros(len(self.score) // _GROUP, bool)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in block.lists]

    def window(self, doc: np.ndarray, n: np.ndarray, length: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """doc, n: ids, ascending, and terms of the documents; length: their postings in term and tf."""
        place = np.repeat(np.arange(len(doc)), length)
        tf = tf.astype(np.int64)
        gain = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * _lengths(n, self.documents, self.total)[place]))
        order = np.argsort(term, kind="stable")
        place, gain = place[order], gain[order]
        edge = np.searchsorted(term[order], np.arange(len(self.weights) + 1))
        grid = self.score.reshape(-1, _GROUP)
        for terms, heap in zip(self.block.lists, self.heaps, strict=True):
            for t in terms:
                a, b = edge[t], edge[t + 1]
                if a < b:  # a document is in a term's postings once, so that no place is added to twice
                    self.score[place[a:b]] += gain[a:b]
                    self.occupied[place[a:b] // _GROUP] = True
            groups = np.flatnonzero(self.occupied)
            self._harvest(heap, doc, groups, grid[groups])
            grid[groups] = 0
            self.occupied[groups] = False

    def _harvest(self, heap: list, doc: np.ndarray, groups: np.ndarray, scores: np.ndarray) -> None:
        """Ids ascend, so of equal scores those that came first stay."""
        row, column = np.nonzero(scores > (heap[0][0] if len(heap) == self.top else 0))
        found = scores[row, column]
        if len(found) > self.top:
            least = np.partition(found, -self.top)[-self.top]
            keep = found > least
            keep[np.flatnonzero(found == least)[:self.top - int(keep.sum())]] = True
            row, column, found = row[keep], column[keep], found[keep]
        for s, d in zip(found.tolist(), doc[groups[row] * _GROUP + column].tolist(), strict=True):
            if len(heap) < self.top:
                heapq.heappush(heap, (s, -d))
            elif (s, -d) > heap[0]:
                heapq.heapreplace(heap, (s, -d))


def _score(box, weights, documents: int, total: int, top: int):
    def run(batches):
        buckets = Buckets(box.value, weights.value, documents, total, top)
        for batch in batches:
            doc, n = (batch.column(i).to_numpy() for i in (0, 1))
            terms, tf = batch.column(2), batch.column(3)
            length = np.diff(terms.offsets.to_numpy())
            edge = np.concatenate([[0], np.cumsum(length)])
            terms, tf = terms.flatten().to_numpy(), tf.flatten().to_numpy()
            for lo in range(0, len(doc), WINDOW):
                hi = min(lo + WINDOW, len(doc))
                a, b = edge[lo], edge[hi]
                buckets.window(doc[lo:hi], n[lo:hi], length[lo:hi], terms[a:b], tf[a:b])
        for item, heap in enumerate(buckets.heaps):
            if heap:
                yield pa.RecordBatch.from_arrays([box.value.ids.take(pa.array([item] * len(heap))), pa.array([-d for _, d in heap], pa.int64()), pa.array([s for s, _ in heap], pa.int64())], names=["item_id", "doc_id", "score"])
    return run


def _block_best(docs: DataFrame, table: pa.Table, top: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of each task for each item of a block."""
    spark = docs.sparkSession
    block = Block(table)
    box = spark.sparkContext.broadcast(block)
    postings = materialise(docs.mapInArrow(_post(box), _POSTINGS), "postings")
    stats = postings.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
    df = np.zeros(len(block.terms), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # no more rows than the block has terms
        df[r["term"]] = r["count"]
    weights = spark.sparkContext.broadcast(np.array([weight(stats.documents, int(x)) for x in df], np.int64))
    # the row's number lets a repeated id fill several ranges
    numbered = postings.where("doc is not null").withColumn("place", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange("doc", "place").sortWithinPartitions("doc", "place").drop("place")
    item = spark.createDataFrame(table.slice(0, 0)).schema["item"].dataType.simpleString()
    best = ranged.mapInArrow(_score(box, weights, stats.documents, stats.total or 1, top), f"item_id {item}, doc_id long, score long")
    best = materialise(best, "best")
    box.destroy()
    weights.destroy()
    return best


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` documents of highest score above 0, ties by ascending id.

    Null and blank texts have no terms: such documents don't count and such items return nothing. Rows that repeat
    an id are documents of their own, with ranks of their own; a document without id counts in all statistics and
    is never returned. Items without id are left out; rows that share an item's id are one item with the terms of
    all of them. Empty tables give no rows. Terms are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    frame = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    kind = asked.schema["item"].dataType.simpleString()
    terms = materialise(asked.mapInArrow(_item_terms, f"item {kind}, term long").distinct(), "terms")
    blocks = -(-terms.count() // BLOCK_TERMS)
    best = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for i in range(blocks):
        table = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).toArrow()
        if len(table):
            best = best.unionByName(_block_best(frame, table, top))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
