"""Postings in segments: a base, deltas and tombstones that are read together, merged when the deltas have grown.

A segment holds postings (token, id, dl, positions) cut into ranges of (token, id), so that a token lies in few
ranges, however large the table is, and a token of every row in many; its `ranges` say from which token to which
each one goes, so that a query opens the ranges of its own tokens only. Beside them are the segment's rows (id, dl)
and the rows of earlier segments that it drops. A commit lists the live segments with their totals, so that
statistics are those of an index made anew. Texts never change under an id; a changed text is a new id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from skein.operators import search
from skein.operators.lineage import passing
from skein.sources import versions

#: Deltas beyond which all segments become one base; and the share of the base's rows that deltas may have together.
MOST_DELTAS = 8
MOST_SHARE = 0.5
#: Postings of a range in expectation.
RANGE_ROWS = 1_000_000
_COMMIT = "segment int, id_type string, rows bigint, total bigint, dropped bigint, dropped_total bigint"


@dataclass
class Segments:
    """The segments of a commit; `matches` of skein.operators.search takes it as an index."""

    spark: SparkSession
    path: str
    version: int
    live: list[Row]

    @property
    def rows(self) -> int:
        return sum(s.rows - s.dropped for s in self.live)

    @property
    def mean(self) -> float:
        return sum(s.total - s.dropped_total for s in self.live) / self.rows if self.rows else 0.0

    def _read(self, name: str, segment: Row) -> DataFrame:
        # schemas are given, since a table without rows may have no file
        schema = "range int, lo string, hi string" if name == "ranges" else f"id {segment.id_type}, dl int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/segment={segment.segment}/{name}")

    def _postings(self, segment: Row, *ranges: int) -> DataFrame:
        path = f"{self.path}/segment={segment.segment}/postings"
        return self.spark.read.schema(f"token string, id {segment.id_type}, dl int, positions array<int>").parquet(*([f"{path}/range={r}" for r in ranges] or [path])).drop("range")

    def _kept(self, parts: list[tuple[int, DataFrame]]) -> DataFrame:
        """Rows of segments without what later ones drop."""
        every = reduce(DataFrame.unionByName, [d.withColumn("segment", F.lit(s)) for s, d in parts])
        gone = [self._read("dropped", s).select("id", F.lit(s.segment).alias("by")) for s in self.live if s.dropped]
        if gone:
            every = _without(every, reduce(DataFrame.unionByName, gone))
        return every.drop("segment")

    def postings(self) -> DataFrame:
        return self._kept([(s.segment, self._postings(s)) for s in self.live])

    def ids(self) -> DataFrame:
        """(id, dl) of the live rows."""
        return self._kept([(s.segment, self._read("rows", s)) for s in self.live])

    def ranges_of(self, words: list[str]) -> list[tuple[Row, list[int]]]:
        """The ranges of each segment that may hold a token: for one word no more than its own rows fill, and one."""
        inside = [(F.col("lo") <= w) & (F.col("hi") >= w) for w in words]
        return [(s, [r["range"] for r in self._read("ranges", s).where(reduce(lambda x, y: x | y, inside)).select("range").collect()]) for s in self.live]

    def of(self, words: list[str]) -> DataFrame:
        """The postings of some tokens, from their ranges."""
        parts = [(s.segment, self._postings(s, *ranges).where(F.col("token").isin(words))) for s, ranges in self.ranges_of(words) if ranges]
        return self._kept(parts) if parts else self.postings().where("false")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (id, segment) that no later segment drops."""
    gone = gone.withColumnRenamed("id", "gone")
    return rows.join(gone, (rows.id == gone.gone) & (gone.by > rows.segment), "left_anti")


def _indexed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, toks) of rows with text."""
    return docs.where(F.trim(F.coalesce(text_col, F.lit(""))) != "").select(F.col(id_col).alias("id"), search.tokens(F.col(text_col)).alias("toks"))


def _ranged(postings: DataFrame, path: str) -> None:
    """Write postings in ranges of (token, id), each sorted, and the tokens that each range goes from and to.

    They are written as they come first: their number, the ranges' borders and the ranges each take a pass over them.
    """
    with passing(postings, "postings") as held:
        _write_ranges(held, path)


def _write_ranges(postings: DataFrame, path: str) -> None:
    spark = postings.sparkSession
    parts = max(1, -(-postings.count() // RANGE_ROWS))
    ranged = postings.repartitionByRange(parts, "token", "id").withColumn("range", F.spark_partition_id())
    ranged.sortWithinPartitions("range", "token", "id").write.mode("overwrite").partitionBy("range").parquet(f"{path}/postings")
    stored = spark.read.schema("token string, range int").parquet(f"{path}/postings")
    stored.groupBy("range").agg(F.min("token").alias("lo"), F.max("token").alias("hi")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def _segment(index: Segments, number: int, postings: DataFrame, rows: DataFrame, dropped: DataFrame, base: bool) -> Row | None:
    """Write a segment, and what a commit says of it; None for a delta that holds and drops nothing."""
    path, kind = f"{index.path}/segment={number}", rows.schema["id"].dataType.simpleString()
    for name, part in (("rows", rows), ("dropped", dropped)):
        part.select("id", F.col("dl").cast("int").alias("dl")).write.mode("overwrite").parquet(f"{path}/{name}")
    total = lambda name: index.spark.read.schema(f"id {kind}, dl int").parquet(f"{path}/{name}").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
    held, gone = total("rows"), total("dropped")
    if not base and not held.n and not gone.n:
        return None
    _ranged(postings, path)
    return Row(segment=number, id_type=kind, rows=held.n, total=held.dl, dropped=gone.n, dropped_total=gone.dl)


def open_segments(spark: SparkSession, path: str, version: int | None = None) -> Segments:
    """The latest commit's segments, or an earlier one's; none where nothing was committed."""
    version = versions.latest(spark, f"{path}/commits") if version is None else version
    live = spark.read.schema(_COMMIT).parquet(f"{path}/commits/v={version}").orderBy("segment").collect() if version else []  # MOST_DELTAS + 2 rows at most
    return Segments(spark, path, version, live)


def _commit(index: Segments, live: list[Row], replace: bool) -> Segments:
    versions.publish(index.spark.createDataFrame([tuple(s) for s in live], _COMMIT), f"{index.path}/commits", index.version + 1, replace)
    return open_segments(index.spark, index.path, index.version + 1)


def _next(index: Segments) -> int:
    return 1 + max((s.segment for s in index.live), default=0)


def add(spark: SparkSession, path: str, fresh: DataFrame, dropped: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", version: int | None = None) -> Segments:
    """Write rows that the index doesn't have, and ids (id, dl) of live rows that go, as a delta; the first one is a base.

    Only the delta is written, unless deltas have grown enough to be merged with all of the index. A version given is
    the commit to go on from, for a caller that keeps the number itself; later commits, which it never came to know
    of, are replaced.
    """
    index, replace = open_segments(spark, path, version), version is not None
    toks = _indexed(fresh, id_col, text_col)
    rows = toks.select("id", F.size("toks").alias("dl"))
    postings = search.by_token(fresh, id_col, text_col)
    gone = rows.where("false") if dropped is None or not index.live else dropped
    made = _segment(index, _next(index), postings, rows, gone, not index.live)
    if made is None:
        return index
    index = _commit(index, [*index.live, made], replace)
    base, deltas = index.live[0], index.live[1:]
    if len(deltas) > MOST_DELTAS or sum(s.rows + s.dropped for s in deltas) > MOST_SHARE * max(1, base.rows):
        return merged(index, replace)
    return index


def merged(index: Segments, replace: bool = False) -> Segments:
    """All live postings as one base; earlier commits stay readable, as their segments do."""
    if len(index.live) < 2:
        return index
    live = index.ids()
    number, postings = _next(index), index.postings().select("token", "id", "dl", "positions")
    return _commit(index, [_segment(index, number, postings, live, live.where("false"), True)], replace)


def refresh(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Segments:
    """Make the index that of docs: new ids come in, ids that are gone (or whose text is empty now) go."""
    index = open_segments(spark, path)
    if not index.live:
        return add(spark, path, docs, None, id_col, text_col)
    wanted = docs.where(F.trim(F.coalesce(text_col, F.lit(""))) != "")
    ids = index.ids()
    fresh = wanted.join(ids.select(F.col("id").alias(id_col)), id_col, "left_anti")
    gone = ids.join(wanted.select(F.col(id_col).alias("id")), "id", "left_anti")
    return add(spark, path, fresh, gone, id_col, text_col)
