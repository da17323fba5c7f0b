"""From raw documents to token ids: language, near duplicates, benchmark leaks, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of
documents; the last returns ids. Between stages the rows are written as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontaminate, langid, ngram_join, pii
from skein.llm.shared import bounded, materialise, scratch, scratch_path

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects; models are fitted on the labelled documents.

    Where no document is labelled there is nothing to reject by, and all go on.
    """
    labelled = docs.where("text is not null and lang is not null")
    if labelled.isEmpty():
        return docs.select(_COLUMNS)
    return langid.identify(docs, langid.fit(labelled)).where("not language.rejected").select(_COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each component of near duplicates.

    An id stands for one document: rows that repeat it go or stay together. So exact repeats of a kept row stay, and of
    an id with two texts both go if one of them is a copy of a document with a smaller id. Documents without words stay.
    """
    found = ngram_join.jaccard_components(docs)
    extra = materialise(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-duplicates")
    return docs.join(bounded(extra), "doc_id", "left_anti").select(_COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = materialise(found.select("doc_id").distinct(), "leaks")
    return docs.join(bounded(leaked), "doc_id", "left_anti").select(_COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return pii.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(_COLUMNS)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as little-endian unsigned 32-bit integers, and their number; an empty text has none."""
    import public_tokenizers

    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return ids.select("doc_id", "lang", "source", "n_chars", "ids").withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [("language_id", identified), ("near_duplicates", deduplicated), ("decontamination", decontaminated), ("pii", redacted), ("bpe", tokenised)]

#: SQL has no language models, tilings, transducers or merges; tests/llm/test_pipeline.py has brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        # what a stage has written for itself goes once its rows are written
        with scratch(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
