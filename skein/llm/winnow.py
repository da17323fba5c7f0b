"""Document fingerprints by winnowing, in DataFrame functions only.

The k-grams of a text's words (lower-cased runs without white space) are hashed; in each window of `window`
k-grams the least hash is picked, the rightmost of equal ones, and kept with its position. Any run of
window + k - 1 words that two texts share gives both the same fingerprint hash. Shorter texts have one window or
one gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

GRAM = 4
WINDOW = 8
_PLACES = (1 << 31) - 1


def picks(text: Column, k: int = GRAM, window: int = WINDOW) -> Column:
    """Fingerprints of a text in order: longs of a 31-bit hash and, for rightmost ties, the reversed word position.

    Null, empty and blank texts have none.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def packed(h: Column) -> Column:
        place = F.sequence(F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(1)))
        grams = F.transform(place, lambda i: F.shiftleft(F.xxhash64(F.slice(h, i, k)).bitwiseAND(F.lit(_PLACES)), 32).bitwiseOR((F.lit(_PLACES) - i).cast("long")))
        return _each(grams, lambda g: F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(g) - (window - 1), F.lit(1))), lambda i: F.array_min(F.slice(g, i, window)))))

    return F.when(text.isNull() | (F.trim(text) == ""), F.array().cast("array<long>")).otherwise(_each(hashed, lambda h: F.when(F.size(h) > 0, packed(h)).otherwise(F.array().cast("array<long>"))))


def _each(value: Column, make) -> Column:
    """make(value), with value computed once: the one element of an array is its own variable."""
    return F.element_at(F.transform(F.array(value), make), 1)


def hashes(picked: Column) -> Column:
    return F.array_distinct(F.transform(picked, lambda v: F.shiftright(v, 32)))


def shown(picked: Column) -> Column:
    """hash@position of each fingerprint, the hash in hexadecimal, joined by commas."""
    return F.array_join(F.transform(picked, lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 32))), F.lit("@"), (F.lit(_PLACES) - v.bitwiseAND(F.lit(_PLACES))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of fingerprint hashes; two texts without any are alike."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), shown(picks(F.col(text_col), k, window)).alias("fingerprint"))


def following(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc, next): the next smaller id of each distinct id; the largest after the smallest. Only ids are shuffled."""
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc")).distinct()
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(ids.repartitionByRange(parts, "doc").select("doc", F.spark_partition_id().alias("part")), "ranges")
    inside = ranged.withColumn("next", F.lead("doc").over(Window.partitionBy("part").orderBy(F.desc("doc"))))
    # one row for each range: its neighbour is the range below, the lowest one's the highest
    ends = ranged.groupBy("part").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    everything = Window.orderBy(F.desc("part"))
    below = ends.select("lo", F.coalesce(F.lead("hi").over(everything), F.first("hi").over(everything)).alias("wrap"))
    return inside.join(F.broadcast(below), inside.doc == below.lo, "left").select("doc", F.coalesce("next", "wrap").alias("next"))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Each text against an edited one, whose last third is the head of the next text by descending id.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row. Of
    rows that share an id, the least text is the next one of others; a null id has an empty next text.
    """
    frame = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = materialise(following(frame, "doc"), "next")
    real = frame.where("doc is not null")
    source = real if order.count() == real.count() else real.groupBy("doc").agg(F.min("text").alias("text"))
    # texts are dealt out by id once, for both sides, and a second time to the document that they follow
    after = source.join(order.select(F.col("next").alias("doc"), F.col("doc").alias("before")), "doc").select(F.col("before").alias("doc"), F.col("text").alias("next_text"))
    pairs = real.join(after, "doc").select("doc", "text", "next_text").unionByName(frame.where("doc is null").select("doc", "text", F.lit("").alias("next_text")))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    head = F.col("next_text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(head, F.lit(1), third))
    texts = pairs.select("doc", "text", head.alias("next_text"), n.cast("long").alias("n_chars"), edited.alias("edited"))
    marked = texts.select("doc", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), picks(F.col("text"), k, window).alias("a"), picks(F.col("edited"), k, window).alias("b"), picks(F.col("next_text"), k, window).alias("c"))
    kept = marked.select("*", hashes(F.col("a")).alias("ha"), hashes(F.col("b")).alias("hb"), hashes(F.col("c")).alias("hc"))
    return kept.select(F.col("doc").alias("doc_id"), "n_chars", "edited_sha256", shown(F.col("a")).alias("fingerprint"), shown(F.col("b")).alias("edited_fingerprint"), likeness(F.col("ha"), F.col("hb")).alias("near_edited"), likeness(F.col("ha"), F.col("hc")).alias("near_next"))
