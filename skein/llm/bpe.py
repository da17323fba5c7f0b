"""Byte-level BPE by a distinct-word table: words are split and counted in Spark, each encoded once, ids joined back.

The table keeps the words that occur at least twice, or as many of the most frequent as WORDS allows (a fixed
bound, so it may be broadcast); it is made by one distributed count and one distributed encoding of distinct
words. Ids are joined back by position: each word of a text is looked up in the table in order. Words outside the
table (rare ones, a few hundredths of a corpus) are encoded where they stand, once for each slice of texts. Ids
are decoded by a join with the id-to-piece table.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back, materialise, most_frequent, small_batches

#: Words of the broadcast table at most, and the bytes of the longest word it takes.
WORDS = 200_000
WORD_BYTES = 64
#: Distinct words that a task counts before it passes them on: a worker's memory, whatever the task's texts.
HELD_WORDS = 200_000
_SLICE = 500_000
# Fixed value: the split of byte-level BPE; white space is the Unicode property, as in the library.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


class Vocabulary:
    """The library's tokenizer, its special strings and the bytes of each id."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letter = _byte_letters()
        pieces = self.library.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(pieces.values()) + 1)
        for piece, i in pieces.items():
            self.pieces[i] = bytes(letter[c] for c in piece) if all(c in letter for c in piece) else piece.encode()

    def words(self, text: str) -> list[str]:
        if self.special_re is None or not self.special_re.search(text):
            return _SPLIT.findall(text)
        out = []
        for i, part in enumerate(self.special_re.split(text)):
            out += [part] if i % 2 else _SPLIT.findall(part)
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level piece stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _slices(values: list[str]):
    lo = 0
    while lo < len(values):
        hi, size = lo, 0
        while hi < len(values) and (hi == lo or size + len(values[hi]) < _SLICE):
            size += len(values[hi])
            hi += 1
        yield values[lo:hi]
        lo = hi


def _counts(path: str):
    from collections import Counter

    def run(batches):
        v = vocabulary(path)
        give_back()
        held: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for texts in _slices([x or "" for x in batch.column(0).to_pylist()]):
                for t in texts:
                    held.update(v.words(t))
                if len(held) > HELD_WORDS:
                    yield rows()
        if held:
            yield rows()
        give_back()
    return run


def word_table(docs: DataFrame, path: str, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(word, n, ids) of the most frequent distinct words, each encoded once; ids as little-endian 32-bit integers."""
    small_batches(docs.sparkSession)
    counts = docs.where(F.col(text_col) != "").select(F.col(text_col).cast("string")).mapInArrow(_counts(path), "word string, n long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") > 1) & (F.octet_length("word") <= WORD_BYTES))
    counts = materialise(counts, "words")
    def encode(batches):
        v = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v.encode(batch.column(0).to_pylist()), pa.binary())], names=["word", "n", "ids"])

    return most_frequent(counts, "n", "word", words).mapInArrow(encode, "word string, n long, ids binary")


def _encoded(path: str, box):
    def run(text: pa.Array) -> pa.Array:
        v = vocabulary(path)
        table = box.value
        give_back()
        out = []
        for texts in _slices([x or "" for x in text.to_pylist()]):
            split = [v.words(t) for t in texts]
            rare = [w for w in set().union(*split) if w not in table]
            known = dict(zip(rare, v.encode(rare), strict=True))
            for words in split:
                try:
                    out.append(b"".join(map(table.__getitem__, words)))
                except KeyError:
                    out.append(b"".join([table.get(w) or known[w] for w in words]))
        return pa.array(out, pa.binary())
    return run


def _decoded(path: str):
    def run(ids: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([v.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in ids], pa.string())
    return run


def _digests(path: str, box):
    encode = _encoded(path, box)

    def run(text: pa.Array) -> pa.Array:
        v = vocabulary(path)
        n, a, b = [], [], []
        for lo in range(0, len(text), 256):
            for ids in encode(text.slice(lo, 256)):
                raw = ids.as_py()
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(v.decode(np.frombuffer(raw, "<u4")).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _box(spark: SparkSession, table: DataFrame):
    """The word table of bounded size, sent once to each executor."""
    rows = table.select("word", "ids").toArrow()
    return spark.sparkContext.broadcast(dict(zip(rows.column("word").to_pylist(), rows.column("ids").to_pylist(), strict=True)))


def encode(docs: DataFrame, path: str, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs with `ids`, the text's ids as little-endian unsigned 32-bit integers; null and empty texts have none."""
    box = _box(docs.sparkSession, word_table(docs, path, text_col, words))
    return docs.withColumn("ids", F.arrow_udf(_encoded(path, box), "binary")(F.col(text_col).cast("string")))


def decode(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """docs with `decoded`, the text of ids_col by the id-to-piece table; null ids decode to the empty text."""
    return docs.withColumn("decoded", F.arrow_udf(_decoded(path), "string")(F.col(ids_col)))


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; ids may be null or repeated."""
    box = _box(docs.sparkSession, word_table(docs, path, text_col))
    found = docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(_digests(path, box), "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>").asNondeterministic()(F.col(text_col).cast("string")).alias("r"))
    return found.select("doc_id", "r.*")
