"""Registered queries on what larger tables bring: long ids, tables of one split, many files in one ingest."""

import re

import pytest
from pyspark.sql import functions as F

from skein.plans import catalog

duckdb = pytest.importorskip("duckdb")


def _differs(spark, folder, name, tables):
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
        want = db.execute(catalog.ORACLES[name]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).collect()]
    assert want
    return set(got) ^ set(want)


def _events(spark, folder, first):
    rows = spark.range(first, first + 60).select(F.col("id").alias("event_id"), F.expr("timestamp_seconds(1700000000 + id % 1000)").alias("ts"), (F.col("id") % 4).alias("user_id"),
                                                 F.element_at(F.array(F.lit("error"), F.lit("view")), (F.col("id") % 2 + 1).cast("int")).alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"))
    rows.write.parquet(f"{folder}/events.parquet")


def test_invocations_of_events_with_long_ids(spark, tmp_path):
    _events(spark, tmp_path, 1_234_500)
    assert _differs(spark, tmp_path, "ingest_invocations", ["events"]) == set()


def test_lines_of_a_table_are_dealt_before_they_are_parsed(spark, tmp_path):
    spark.range(30).select(F.col("id").cast("bigint").alias("p_partkey"), F.lit(7).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = catalog.ingest_assets(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    dealt = [m.start() for m in re.finditer(r"Exchange hashpartitioning\(path", catalog.ingest_assets(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString())]
    assert "parse" in plan and len(dealt) == 1  # the one by file, below the parsing
    assert _differs(spark, tmp_path, "ingest_assets", ["part"]) == set()


def test_sizes_behind_many_segments(spark):
    from skein.functions import images

    frame = "FFC0000B08000500070101"
    rows = [(n, bytearray.fromhex("FFD8" + "FFFE0002" * n + frame)) for n in (0, images.RUN - 1, images.RUN, 5 * images.RUN)]
    found = spark.createDataFrame(rows, "n int, data binary").select("n", images.dimensions(F.col("data")).alias("d")).collect()
    assert {(r.n, r.d.width, r.d.height) for r in found} == {(n, 7, 5) for n, _ in rows}
