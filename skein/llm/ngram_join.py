"""Exact Jaccard self-join of documents on word shingles, by a pigeonhole over partitions of the token universe.

Pairs fall into classes by the smaller set's size. Two sets a, b of similarity t = 0.8 or more differ in at most
floor((|a|+|b|)*(1-t)/(1+t)) shingles, D for the largest pair of a class. A hash deals the shingle universe into
D + 1 + slack segments, so at least 1 + slack segments of such a pair hold equal subsets. A document indexes the
fingerprint of each of its non-empty segments, in its own class and as a larger partner in the one below.

Allocation by cost: shingles that many documents hold (by a bounded sample; any set of shingles would do) make
costly groups, so they are left out of the segments (threshold -1 for what only they fill); differences in the
other shingles are no more than in all. A document may miss up to `slack` segments that way; the others are matched
exactly (threshold 0). A document that misses more also indexes the one-deletion neighbourhoods of its segments
(threshold 1). Where even that falls short (texts of common shingles), it is cut into segments of all its shingles
beside others of its kind, and as a last resort each shingle is a signature. A pair in which one side has enough
exact segments is found by these, one in which both fall short by the wider nets of both. No link is lost.

Candidates are verified on whole texts. Links inside a component that is known already are not verified again:
each document's likeliest hub comes first, then every pair of members of a group that are still in different
components. Where many documents share a segment these pairs don't become rows: blocks of shingle sets are held
against each other, and each pair of blocks returns only links that join two components, fewer than its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Words, mix, slices, text_buffers
from .shared import BROADCAST_ROWS, bounded, components, materialise, small_batches

#: Documents in the sample of common shingles, and the documents of it that a common one is in.
SAMPLE = 10_000
COMMON = 4
#: Documents that share a segment, beyond which its links are looked for in blocks; documents and shingles of a block.
HOT = 64
BLOCK = 1024
BLOCK_SHINGLES = 1 << 18
#: Documents of the sample that share a segment, beyond which its rows are not gathered in one task to be counted.
HEAVY = 10
SHINGLE = 5


def lowest(largest: int, num: int, den: int) -> np.ndarray:
    """The least size of each class. A class holds sizes below the next one's least, and all larger partners of these."""
    low = [1]
    while low[-1] <= largest + 1:
        low.append(max(low[-1] + 1, low[-1] * 3 // 2, -(-low[-1] * den // num)))
    return np.array(low, np.int64)


def segments(top: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest difference D, segments) of classes whose largest smaller size is top."""
    apart = (top + top * den // num) * (den - num) // (den + num)
    return apart, apart + 1 + np.where(apart == 0, 0, 1 + apart // 12)


def segment_rows(row: np.ndarray, token: np.ndarray, size: np.ndarray, common: np.ndarray, num: int, den: int):
    """Signatures of shingle sets: (row, signature, size, segments of the class, empty segments).

    row, token: the shingles of each row; size: their number; common: whether a shingle is one of the common ones.
    """
    hard = np.zeros(len(size), bool)
    for out, short in _segmented(row[~common], token[~common], size, num, den, 0):
        yield out
        hard |= short
    if hard.any():
        mine = hard[row]
        for out, short in _segmented(row[mine], token[mine], np.where(hard, size, 0), num, den, 1):
            yield out
            if short.any():  # every shingle is a signature
                take = short[row]
                none = np.zeros(int(take.sum()), np.int64)  # no segments: such rows meet whatever their sizes are
                yield row[take], mix(token[take] + np.uint64(77)) >> np.uint64(8), size[row[take]], none, none


def _segmented(row: np.ndarray, token: np.ndarray, size: np.ndarray, num: int, den: int, space: int):
    """Signatures of one way to cut the universe, and the rows for which even one-deletion signatures are too few."""
    rows = len(size)
    low = lowest(int(size.max(initial=1)), num, den)
    own = np.searchsorted(low, size, "right") - 1
    lo32, hi32 = (token & np.uint64(0xFFFFFFFF)).astype(np.float64), (token >> np.uint64(32)).astype(np.float64)
    place = mix(token ^ np.uint64(0x5851F42D4C957F2D + space))
    for step in (0, 1):
        use = np.maximum(own - step, 0)
        top = low[use + 1] - 1
        take = (size > 0) & (step == 0 or (own > 0) & (size <= top * den // num))
        apart, m = segments(top, num, den)
        begin = np.concatenate([[0], np.cumsum(np.where(take, m, 0))])
        keep = take[row]
        r = row[keep]
        key = begin[r] + (place[keep] % m[r].astype(np.uint64)).astype(np.int64)
        total = int(begin[-1])
        held = np.bincount(key, minlength=total)
        x, y = np.bincount(key, lo32[keep], total), np.bincount(key, hi32[keep], total)
        owner = np.repeat(np.arange(rows), np.diff(begin))
        salt = mix(((use[owner] * 2 + space) * 1_000_003 + np.arange(total) - begin[owner]).astype(np.uint64))

        def sign(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
            return mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(y.astype(np.uint64) + s)) >> np.uint64(8)

        full = held > 0
        empty = np.bincount(owner[~full], minlength=rows)
        o = owner[full]
        none = np.zeros(rows, bool)
        yield (o, sign(x[full], y[full], salt[full]), size[o], m[o], empty[o]), none
        poor = take & (empty > m - apart - 1)
        if poor.any():
            mine = poor[r] & (held[key] > 1)
            k, o = key[mine], r[mine]
            room = np.bincount(owner, (held > 0).astype(float) + (held > 1), rows)
            yield (o, sign(x[k] - lo32[keep][mine], y[k] - hi32[keep][mine], salt[k]), size[o], m[o], empty[o]), poor & (room < apart + 1)


def _keys(k: int):
    def run(batches):
        for batch in batches:
            at, data = text_buffers(batch.column(1))
            for lo, hi in slices(at):
                words = Words(at, data, lo, hi, fold=True)
                row, _ = words.shingle_sets(k)
                a, b = words.text_keys()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.bincount(row, minlength=hi - lo).astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["doc_id", "n_shingles", "k1", "k2"])
    return run


def _shingles(k: int):
    def run(batches):
        for batch in batches:
            at, data = text_buffers(batch.column(0))
            for lo, hi in slices(at):
                token, n = np.unique(Words(at, data, lo, hi, fold=True).shingle_sets(k)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])
    return run


def sampled(docs: DataFrame) -> DataFrame:
    """About SAMPLE documents, by a hash of their ids; no result depends on which they are."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    return docs.where(F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))


def common_shingles(sample: DataFrame, k: int) -> np.ndarray:
    """Shingles of COMMON or more documents of a sample, sorted."""
    counts = sample.select("text").mapInArrow(_shingles(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(counts.select("token").toArrow().column(0).to_numpy().view(np.uint64))


def _signatures(k: int, num: int, den: int, box):
    def run(batches):
        common = box.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at, data = text_buffers(batch.column(1))
            for lo, hi in slices(at):
                row, token = Words(at, data, lo, hi, fold=True).shingle_sets(k)
                held = common[np.minimum(np.searchsorted(common, token), len(common) - 1)] == token if len(common) else np.zeros(len(token), bool)
                for owner, sig, size, m, empty in segment_rows(row, token, np.bincount(row, minlength=hi - lo), held, num, den):
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids[lo + owner]), pa.array(size.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(empty.astype(np.int32))], names=["sig", "doc", "size", "m", "lost"])
    return run


def _parity(token: np.ndarray) -> bytes:
    """A bitmap of at least four bits a shingle, each the parity of the shingles that fall on it."""
    bits = 64 << max(0, int(len(token) * 4 // 64).bit_length())
    count = np.bincount((mix(token) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def _sketches(k: int, sets: bool = False):
    """(doc, n, bits) of each text, or with sets (doc, n, bits, shingles)."""
    def run(batches):
        for batch in batches:
            at, data = text_buffers(batch.column(1))
            for lo, hi in slices(at):
                row, token = Words(at, data, lo, hi, fold=True).shingle_sets(k)
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                own = [token[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(edge).astype(np.int32)), pa.array(map(_parity, own), pa.binary())]
                names = ["doc", "n", "bits"]
                if sets:
                    columns, names = [*columns, pa.array([x.tobytes() for x in own], pa.binary())], [*names, "shingles"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def _apart(a: bytes, b: bytes) -> int:
    """No more than the number of shingles in one set only: the longer bitmap is folded, then differing bits count."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _likely(num: int, den: int):
    """Pairs whose bitmaps don't rule the link out."""
    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            apart = [_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            good = pa.array(np.array(apart, np.int64) * (den + num) <= (na.astype(np.int64) + nb) * (den - num))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])
    return run


def _verify(k: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            sides = [text_buffers(batch.column(i)) for i in (2, 3)]
            good = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                x, y = (Words(*side, i, i + 1, fold=True).shingle_sets(k)[1] for side in sides)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both > 0 and den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])
    return run


class Verifier:
    """Exact tests of pairs: bitmaps rule most false ones out, whole texts decide the others."""

    def __init__(self, docs: DataFrame, rows: DataFrame, k: int, num: int, den: int):
        self.k, self.num, self.den, self.docs = k, num, den, docs
        ids = materialise(rows.select("doc").distinct(), "ids")
        self.bits = materialise(docs.join(bounded(ids), "doc", "left_semi").select("doc", "text").mapInArrow(_sketches(k), "doc long, n int, bits binary"), "bitmaps")

    def links(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.bits.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
        likely = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(_likely(self.num, self.den), "a long, b long")
        likely = materialise(likely, "likely")
        ids = likely.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        texts = self.docs.join(F.broadcast(ids) if likely.count() <= BROADCAST_ROWS // 2 else ids, "doc", "left_semi")
        both = likely.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
        return materialise(both.select("a", "b", "ta", "tb").mapInArrow(_verify(self.k, self.num, self.den), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: components of links with den * |A & B| >= num * |A | B|.

    component_id is the least id that links reach, the row's own where it has none. Null and blank texts have no
    shingles and no links; rows of equal words are one class from the start. A row with a null id keeps its
    count and has a null component_id, and takes no part in links. Repeated ids give one row for each input row.
    """
    small_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    keyed = materialise(frame.select("doc", "text").mapInArrow(_keys(k), "doc_id long, n_shingles long, k1 long, k2 long"), "keys")
    real = keyed.where("doc_id is not null and n_shingles > 0")
    # written first, so that the join below it is a plain one, which adaptive execution may split
    least = materialise(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    member = materialise(real.join(bounded(least), ["k1", "k2"]).select("doc_id", "rep").distinct(), "members")
    extra = materialise(member.where("doc_id <> rep").select(F.col("doc_id").alias("doc")), "copies")
    reps = frame.where("doc is not null").join(bounded(extra), "doc", "left_anti")
    comp = materialise(_join_components(reps, k, num, den), "classes")
    rep = keyed.join(member.withColumnRenamed("rep", "class"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("rep"))
    return rep.join(comp, rep.rep == comp.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def _shared_segments(reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(sig, doc, size, m, lost, c): rows of signatures that c rows have, two at least."""
    spark = reps.sparkSession
    sample = sampled(reps)
    box = spark.sparkContext.broadcast(common_shingles(sample, k))
    sign = lambda d: d.select("doc", "text").mapInArrow(_signatures(k, num, den, box), "sig long, doc long, size int, m int, lost int")
    # signatures of large families are known from the sample: no more of them than the sample has rows / HEAVY
    heavy = materialise(sign(sample).groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= HEAVY).select("sig"), "heavy")
    every = sign(reps)
    window = F.count("*").over(Window.partitionBy("sig"))
    if heavy.isEmpty():
        return materialise(every.withColumn("c", window).where("c > 1").dropDuplicates(["sig", "doc"]), "signatures")
    marked = every.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "sig", "left")
    # a row of a heavy signature is its own group in the window, so that no task gathers them
    spread = F.when(F.col("heavy"), F.xxhash64("sig", "doc")).otherwise(F.lit(0))
    counted = marked.withColumn("spread", spread).withColumn("c", F.count("*").over(Window.partitionBy("sig", "spread"))).where("heavy or c > 1")
    counted = materialise(counted.drop("spread").dropDuplicates(["sig", "doc"]), "signatures")
    counts = materialise(counted.where("heavy").groupBy("sig").agg(F.count("*").alias("all")).where(F.col("all") > 1), "heavy")
    light = counted.where("heavy is null").select("sig", "doc", "size", "m", "lost", "c")
    return light.unionByName(counted.where("heavy").drop("c").join(F.broadcast(counts), "sig").select("sig", "doc", "size", "m", "lost", F.col("all").alias("c")))


def _join_components(reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, component) of the distinct documents that link with another."""
    rows = _shared_segments(reps, k, num, den)
    # what a document's segments have in common with others: the source of a family of copies has most of it
    support = materialise(rows.groupBy("doc").agg(F.sum("c").alias("support")), "support")
    rows = rows.drop("c").join(bounded(support), "doc").select("sig", "doc", "size", "m", "lost", "support")
    check = Verifier(reps, rows, k, num, den)
    fits = f"{den} * least(sa, sb) >= {num} * greatest(sa, sb)"
    # first each document against its likeliest hub, which settles most components and is no more than a shortcut
    hub = F.min(F.struct((-F.col("support")).alias("h"), F.col("doc").alias("hub"), F.col("size").alias("sh"))).alias("hub")
    hubs = rows.groupBy("sig").agg(hub)
    stars = rows.join(hubs, "sig").where("doc <> hub.hub").select(F.col("hub.hub").alias("a"), F.col("hub.sh").alias("sa"), F.col("doc").alias("b"), F.col("size").alias("sb")).where(fits)
    pairs = stars.groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
    links = check.links(materialise(pairs.select("a", "b"), "pairs"))
    comp = None if links.isEmpty() else components(links)
    label = rows.withColumn("component", F.col("doc")) if comp is None else rows.join(bounded(comp), rows.doc == comp.node, "left").withColumn("component", F.coalesce("component", "doc")).drop("node")
    several = label.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c"), F.min("doc").alias("hub")).where("lo <> hi")
    live = materialise(label.join(several.select("sig", "c", "hub"), "sig"), "open")
    # then every pair of different components that shares a segment: by rows where few documents share it, in blocks else
    few = live.where(F.col("c") <= HOT)
    side = lambda x: few.select("sig", "m", F.col("doc").alias(x), F.col("size").alias(f"s{x}"), F.col("component").alias(f"c{x}"), F.col("lost").alias(f"l{x}"))
    # equal segments of a linked pair: m - (its largest difference) - (segments that are empty in both)
    least = F.expr(f"m - floor((sa + sb) * {den - num} / {den + num}) - least(la, lb)")
    light = side("a").join(side("b"), ["sig", "m"]).where(f"a < b and ca <> cb and {fits}")
    light = light.groupBy("a", "b", "m").agg(F.count("*").alias("n"), F.first("sa").alias("sa"), F.first("sb").alias("sb"), F.first("la").alias("la"), F.first("lb").alias("lb")).where(F.col("n") >= least).select("a", "b")
    more = check.links(materialise(light.distinct(), "pairs"))
    many = live.where(F.col("c") > HOT)
    if not many.isEmpty():
        more = more.unionByName(_families(many, reps, k, num, den))
    if more.isEmpty():
        return comp if comp is not None else rows.select(F.col("doc").alias("node"), F.col("doc").alias("component")).limit(0)
    return components(links.unionByName(more))


def _families(many: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): verified links that join the components of documents that common segments connect.

    A family is cut into bands of like size and these into blocks of at most about BLOCK documents and
    BLOCK_SHINGLES shingles; each pair of blocks whose sizes may link is one group, so that a family of any size is
    spread over many tasks. A group returns a spanning forest: a link only where it joins two components.
    """
    edges = materialise(many.select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct(), "families")
    family = components(edges)
    known = many.select("doc", "component").distinct().join(family.select(F.col("node").alias("doc"), F.col("component").alias("family")), "doc")
    known = materialise(known, "families")
    sets = reps.join(bounded(known.select("doc")), "doc", "left_semi").select("doc", "text").mapInArrow(_sketches(k, True), "doc long, n int, bits binary, shingles binary")
    docs = sets.join(bounded(known), "doc").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)))).cast("int"))
    docs = materialise(docs, "families")
    parts = docs.groupBy("family", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    near = docs
    for name, shift in (("here", 0), ("up", 1), ("down", -1)):
        near = near.join(parts.select("family", (F.col("band") - shift).alias("band"), F.col("parts").alias(name)), ["family", "band"], "left")
    part = F.pmod(F.xxhash64("doc"), F.col("here").cast("bigint")).cast("int")
    none = F.array().cast("array<struct<band: int, i: int, j: int, up: boolean>>")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    flag = lambda band, i, j, up: F.struct(band.alias("band"), i.alias("i"), j.alias("j"), F.lit(up).alias("up"))
    keys = F.concat(
        F.transform(span(F.col("here")), lambda j: flag(F.col("band"), F.least(part, j), F.greatest(part, j), False)),
        F.when(F.col("up").isNull(), none).otherwise(F.transform(span(F.col("up")), lambda j: flag(F.col("band"), part, j, True))),
        F.when(F.col("down").isNull(), none).otherwise(F.transform(span(F.col("down")), lambda j: flag(F.col("band") - 1, j, part, True))))
    dealt = near.select("family", "doc", "component", "n", "bits", "shingles", "band", part.alias("part"), F.explode(keys).alias("k"))
    dealt = dealt.select("family", F.col("k.band").alias("kb"), F.col("k.i").alias("ki"), F.col("k.j").alias("kj"), F.col("k.up").alias("ku"), "doc", "component", "n", "bits", "shingles", "band", "part")
    return materialise(dealt.groupBy("family", "kb", "ki", "kj", "ku").applyInArrow(_block_links(num, den), "a long, b long"), "links")


def _block_links(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        doc, label, n, band, part = (table.column(c).to_numpy() for c in ("doc", "component", "n", "band", "part"))
        label, n = label.copy(), n.astype(np.int64)
        kb, ki, up = table.column("kb")[0].as_py(), table.column("ki")[0].as_py(), table.column("ku")[0].as_py()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        raw = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("bits")]
        width = min(map(len, raw))
        folded = []
        for x in raw:
            while len(x) > width:
                x = x[:len(x) // 2] ^ x[len(x) // 2:]
            folded.append(x)
        bits = np.stack(folded)
        left = np.flatnonzero((band == kb) & (part == ki))
        right = np.arange(len(doc)) if not up and ki == table.column("kj")[0].as_py() else np.flatnonzero((band == kb + up) & ((part != ki) | up))
        a, b = [], []
        for i in left:
            apart = np.bitwise_count(bits[right] ^ bits[i]).sum(axis=1, dtype=np.int64)
            # what bitmaps and sizes don't rule out, likeliest first, until all of it is in i's component or tested
            likely = (apart * (den + num) <= (n[right] + n[i]) * (den - num)) & (den * np.minimum(n[right], n[i]) >= num * np.maximum(n[right], n[i]))
            for j in right[likely][np.argsort(apart[likely], kind="stable")]:
                if label[j] != label[i]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if den * both >= num * (n[i] + n[j] - both):
                        label[label == label[j]] = label[i]
                        a.append(doc[i])
                        b.append(doc[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run
