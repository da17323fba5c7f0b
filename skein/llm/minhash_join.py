"""Near duplicates by an inverted join over MinHash coordinates, with prefix and skip merging.

A document's set of word shingles has a signature: for each of H hash functions the least hash, so that two sets
of Jaccard similarity J agree in a coordinate with probability J, each coordinate by itself. A pair is a candidate
if it agrees in at least `least` coordinates, chosen so that a pair at the threshold itself falls below it with
probability MISS; every candidate is confirmed on full sets, so nothing but a miss of that probability can differ.

Documents are posted under each (coordinate, value). Merging all postings would count the collisions of every pair
that shares a common passage, so they are merged like this:

* prefix: a document's postings are ordered by length, shortest first. A pair with `least` collisions of H has one
  among the first H - least + 1 of both, so only these are merged, and postings of one document not at all;
* skip: the long postings behind the prefix are never traversed; a pair that met in a prefix is looked up in both
  signatures, which counts all its collisions, and goes on from `least` upward.

Within a posting, documents meet a common hub first. Where that leaves several components in a posting, all pairs of
different components meet if it is short; documents of long ones get a longer signature, whose bound is nearer to
the threshold and whose prefix is a smaller share, and are merged once more. What is still unsettled after the last
level is compared in blocks of shingle sets, exactly, whatever its number.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Words, mix, slices, text_buffers
from .ngram_join import Verifier, _families
from .shared import bounded, components, materialise, small_batches

SHINGLE = 2
#: Coordinates of a signature on each level.
LEVELS = (96, 512)
#: Probability that a pair at the threshold agrees in fewer coordinates than a candidate must.
MISS = 1e-10
#: Documents of a posting up to which all its pairs of different components meet.
SHORT = 64
_SEEDS = np.random.Generator(np.random.PCG64(1812)).integers(1, 1 << 63, 2 * 1024, dtype=np.uint64)
_CHUNK = 1 << 13


def least_collisions(coordinates: int, num: int, den: int, miss: float = MISS) -> int:
    """The largest bound that a pair of similarity num / den falls below with probability `miss` at most."""
    p, below = num / den, 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * p ** t * (1 - p) ** (coordinates - t)
        if below > miss:
            return t
    return coordinates


def signatures(row: np.ndarray, token: np.ndarray, rows: int, coordinates: int) -> np.ndarray:
    """Least hashes, rows x coordinates of 32 bits, of sets given as (row, token) sorted by row; an empty set has zeros."""
    out = np.zeros((rows, coordinates), np.uint32)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    if not len(first):
        return out
    mixed = mix(token)
    for i in range(coordinates):
        h = mixed * (_SEEDS[2 * i] | np.uint64(1)) + _SEEDS[2 * i + 1]
        out[row[first], i] = np.minimum.reduceat(h, first) >> np.uint64(32)
    return out


def _digests(k: int, coordinates: int, keys: bool, texts: bool = False):
    """(doc, n, k1, k2, sig) of each text, or (doc, sig): size, two hashes of the set, and its signature; with texts, these too."""
    def run(batches):
        for batch in batches:
            at, data = text_buffers(batch.column(1))
            for lo, hi in slices(at):
                row, token = Words(at, data, lo, hi, fold=True).shingle_sets(k)
                sig = signatures(row, token, hi - lo, coordinates)
                columns, names = [batch.column(0).slice(lo, hi - lo)], ["doc"]
                if keys:
                    total = [np.zeros(len(token) + 1, np.uint64) for _ in range(2)]
                    np.cumsum(mix(token), out=total[0][1:])
                    np.cumsum(mix(token ^ np.uint64(0xA0761D6478BD642F)), out=total[1][1:])
                    edge = np.searchsorted(row, np.arange(hi - lo + 1))
                    columns += [pa.array(np.diff(edge).astype(np.int64)), *(pa.array((t[edge[1:]] - t[edge[:-1]]).view(np.int64)) for t in total)]
                    names += ["n", "k1", "k2"]
                columns.append(pa.array([x.tobytes() for x in sig], pa.binary()))
                names.append("sig")
                if texts:
                    columns, names = [*columns, batch.column(1).slice(lo, hi - lo)], [*names, "text"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def _post(coordinates: int):
    """(posting, doc): the coordinate in the high half and the value in the low half of a long."""
    def run(batches):
        high = np.arange(coordinates, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            for lo in range(0, len(batch), _CHUNK):
                part = batch.slice(lo, _CHUNK)
                value = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, coordinates)
                yield pa.RecordBatch.from_arrays([pa.array((value + high).ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), coordinates))], names=["posting", "doc"])
    return run


def _collide(coordinates: int, least: int):
    """Pairs whose signatures agree in `least` coordinates or more."""
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, coordinates) for i in (2, 3))
            good = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])
    return run


def prefixes(sigs: DataFrame, coordinates: int, least: int) -> DataFrame:
    """(posting, doc, c): the first coordinates - least + 1 postings of each document, shortest first, of those with c > 1 documents."""
    posted = sigs.select("doc", "sig").mapInArrow(_post(coordinates), "posting long, doc long")
    lengths = materialise(posted.groupBy("posting").agg(F.count("*").alias("c")).where("c > 1"), "lengths")
    shared = materialise(posted.join(bounded(lengths), "posting"), "postings")
    mine = Window.partitionBy("doc")
    place = F.row_number().over(mine.orderBy("c", "posting"))
    # postings of the document alone come first and are not rows
    alone = F.lit(coordinates) - F.count("*").over(mine)
    kept = shared.withColumn("place", place + alone).where(F.col("place") <= coordinates - least + 1)
    return materialise(kept.select("posting", "doc", "c"), "prefixes")


class Level:
    """One round of merging: links found between documents, and the documents of long postings it leaves open."""

    def __init__(self, reps: DataFrame, sigs: DataFrame, sizes: DataFrame, coordinates: int, k: int, num: int, den: int):
        self.sigs, self.coordinates, self.num, self.den = sigs, coordinates, num, den
        self.least = least_collisions(coordinates, num, den)
        rows = prefixes(sigs, coordinates, self.least)
        self.rows = materialise(rows.join(bounded(sizes), "doc"), "rows")
        self.fits = f"{den} * least(sa, sb) >= {num} * greatest(sa, sb)"
        self.check = Verifier(reps, self.rows, k, num, den)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Skip merging: all collisions of pairs (a, b) counted in both signatures; then exact tests."""
        side = lambda x: self.sigs.select(F.col("doc").alias(x), F.col("sig").alias(f"s{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
        return self.check.links(materialise(both.mapInArrow(_collide(self.coordinates, self.least), "a long, b long"), "collisions"))

    def stars(self) -> DataFrame:
        """Links of each document with its likeliest hub: what most of its postings have in common."""
        support = materialise(self.rows.groupBy("doc").agg(F.sum("c").alias("support")), "support")
        known = materialise(self.rows.join(bounded(support), "doc"), "supported")
        hub = F.min(F.struct((-F.col("support")).alias("h"), F.col("doc").alias("hub"), F.col("size").alias("sh"))).alias("hub")
        hubs = materialise(known.groupBy("posting").agg(hub).select("posting", F.col("hub.hub").alias("a"), F.col("hub.sh").alias("sa")), "hubs")
        met = known.select("posting", F.col("doc").alias("b"), F.col("size").alias("sb")).join(bounded(hubs), "posting").where(f"a <> b and {self.fits}")
        best = met.groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
        return self.confirmed(materialise(best.select("a", "b"), "pairs"))

    def short(self, live: DataFrame) -> DataFrame:
        """Links between documents of different components in the short ones of unsettled postings."""
        few = live.where(F.col("held") <= SHORT)
        side = lambda x: few.select("posting", F.col("doc").alias(x), F.col("size").alias(f"s{x}"), F.col("component").alias(f"c{x}"))
        pairs = side("a").join(side("b"), "posting").where(f"a < b and ca <> cb and {self.fits}").select("a", "b").distinct()
        return self.confirmed(materialise(pairs, "pairs"))


def unsettled(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Rows (posting, doc, size, component, held, hub) of the postings whose documents are in several components."""
    rows = rows.select("posting", "doc", "size")
    label = rows.withColumn("component", F.col("doc")) if comp is None else rows.join(bounded(comp), rows.doc == comp.node, "left").withColumn("component", F.coalesce("component", "doc")).drop("node")
    label = materialise(label, "labels")
    several = label.groupBy("posting").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held"), F.min("doc").alias("hub")).where("lo <> hi")
    several = materialise(several.select("posting", "held", "hub"), "several")
    return materialise(label.join(bounded(several), "posting"), "open")


def linked(reps: DataFrame, digests: DataFrame, k: int, num: int, den: int, levels: tuple[int, ...]) -> DataFrame | None:
    """(node, component) of documents (doc, text) of different sets that link with another; None where none do."""
    sizes = digests.select("doc", F.col("n").cast("int").alias("size"))
    sigs, links, left = digests.select("doc", "sig"), [], None
    for step, coordinates in enumerate(levels):
        if step:
            ids = materialise(left.select("doc").distinct(), "open")
            held = reps.join(bounded(ids), "doc", "left_semi")
            sigs = materialise(held.select("doc", "text").mapInArrow(_digests(k, coordinates, False), "doc long, sig binary"), "signatures")
        level = Level(reps, sigs, sizes, coordinates, k, num, den)
        links.append(level.stars())
        live = unsettled(level.rows, _components(links))
        links.append(level.short(live))
        comp = _components(links)
        left = unsettled(live.where(F.col("held") > SHORT), comp)
        if left.isEmpty():
            return comp
    return _components([*links, _families(left.withColumnRenamed("posting", "sig"), reps, k, num, den)])


def _components(links: list[DataFrame]) -> DataFrame | None:
    every = reduce(DataFrame.unionByName, links)
    return None if every.isEmpty() else components(every)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = 80, den: int = 100, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: components of links with den * |A & B| >= num * |A | B|.

    Words are lower-cased (A-Z) runs without white space; a text of fewer than k words has one shingle. component_id
    is the least id that links reach, the row's own where it has none; kept says that it is the row's own. Null and
    blank texts have no shingles and no links. Rows of equal sets are one class from the start; rows that repeat an
    id are one document of all their sets, linked with whatever one of them is linked with. A row with a null id
    keeps its count, has null component_id and kept, and takes no part in links. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = "doc long, n long, k1 long, k2 long, sig binary"
    digests = materialise(frame.mapInArrow(_digests(k, levels[0], True), schema), "digests")
    real = digests.where("doc is not null and n > 0")
    # an id of several sets is a node for each of them, named by a hash; their common id links them
    several = real.groupBy("doc").agg(F.count("*").alias("c"), *(f(x).alias(f"{f.__name__}{x}") for f in (F.min, F.max) for x in ("k1", "k2")))
    several = materialise(several.where("c > 1 and (mink1 <> maxk1 or mink2 <> maxk2)").select("doc"), "several")
    texts = frame.where("doc is not null").join(bounded(several), "doc", "left_anti")
    own = []
    if several.isEmpty():
        real = real.withColumn("node", F.col("doc"))
    else:
        name = F.xxhash64("doc", "k1", "k2")
        real = real.join(bounded(several.withColumn("split", F.lit(True))), "doc", "left").withColumn("node", F.when(F.col("split"), name).otherwise(F.col("doc"))).drop("split")
        real = materialise(real, "nodes")
        split = frame.join(bounded(several), "doc", "left_semi").mapInArrow(_digests(k, levels[0], True, True), f"{schema}, text string").where("n > 0")
        texts = texts.unionByName(split.withColumn("doc", name).select("doc", "text").dropDuplicates(["doc"]))
        own = [real.join(bounded(several), "doc", "left_semi").groupBy("doc").agg(F.min("node").alias("b")).join(real.select("doc", F.col("node").alias("a")), "doc").select("a", "b")]
    classes = materialise(real.groupBy("k1", "k2").agg(F.min("node").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    member = materialise(real.select("node", "k1", "k2").join(bounded(classes), ["k1", "k2"]).where("node <> rep").select("node", "rep").distinct(), "members")
    copies = bounded(member.select(F.col("node").alias("doc")))
    reps = texts.join(copies, "doc", "left_anti")
    first = real.select(F.col("node").alias("doc"), "n", "sig").join(copies, "doc", "left_anti").dropDuplicates(["doc"])
    found = linked(reps, materialise(first, "own"), k, num, den, levels)
    # everything that holds nodes together: links of sets, equal sets, equal ids
    ties = [member.select(F.col("node").alias("a"), F.col("rep").alias("b")), *own]
    ties += [] if found is None else [found.select(F.col("node").alias("a"), F.col("component").alias("b"))]
    comp = _components(ties)
    if comp is None:
        reached = None
    else:
        label = real.select("doc", "node").distinct().join(bounded(comp), "node")
        least = label.groupBy("component").agg(F.min("doc").alias("least"))
        reached = materialise(label.join(least, "component").select("doc", F.col("least").alias("component_id")).distinct(), "reached")
    out = digests.select("doc", F.col("n").alias("n_shingles"))
    out = out.withColumn("component_id", F.col("doc")) if reached is None else out.join(bounded(reached), "doc", "left").withColumn("component_id", F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", (F.col("component_id") == F.col("doc")).alias("kept"))
