"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model for each language is fitted on a bounded sample of labelled rows (`sample_bytes` of text a language, in
expectation, drawn by a hash of the id). All languages share, for each order, one sorted array of n-gram hashes
with a matrix of log probabilities (already interpolated, so a hit needs one look-up) and one of contexts with
their back-off weights. A text goes to the language of lowest cross-entropy a character. Rejection is calibrated
on a part of the sample that no model has seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import mix, slices, text_buffers
from .shared import small_batches

ORDER = 4
#: Bytes of text a language that the models are fitted on, and the share of them kept for calibration.
SAMPLE_BYTES = 3_000_000
CALIBRATION = 0.2
#: Letters of the models at most: sixteen bits of a packed n-gram each. Rarer ones, and letters of no sample, are one.
_LETTERS = (1 << 16) - 2
_BITS = 16
#: Letters of all scripts, about: what a letter costs where nothing is known of it.
_UNICODE = 1 << 17
RESULT = "struct<lang_pred: string, score: double, cross_entropy: double, rejected: boolean>"
_fold: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Lower-case letter of each code point; a space for what is no letter. Higher planes: letters 0x20000-0x323AF."""
    if not _fold:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x20000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        table[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)
        _fold.append(table)
    return _fold[0]


def letters(at: np.ndarray, data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(letters and single spaces, offsets) of rows [lo, hi), each row after ORDER - 1 spaces that are not counted."""
    raw = data[int(at[lo]):int(at[hi])]
    code = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at[lo:hi + 1] - at[lo]]
    code = _folded()[np.minimum(code, 0x10FFFF)]
    row = np.repeat(np.arange(hi - lo), np.diff(chars))
    keep = code != 32
    keep[1:] |= code[:-1] != 32
    first = chars[:-1][np.diff(chars) > 0]
    keep[first] = code[first] != 32
    code, row = code[keep], row[keep]
    n = np.bincount(row, minlength=hi - lo)
    pad = ORDER - 1
    begin = np.concatenate([[0], np.cumsum(n + pad)])
    out = np.full(int(begin[-1]), 32, np.uint32)
    out[np.arange(len(code)) + (row + 1) * pad] = code
    return out, begin


def grams(ids: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each place from ORDER - 1 on, packed into _BITS a letter."""
    out = np.zeros(max(0, len(ids) - ORDER + 1), np.uint64)
    for j in range(order):
        at = ORDER - order + j
        out = (out << np.uint64(_BITS)) | ids[at:at + len(out)]
    return out


@dataclass
class Model:
    langs: list[str]
    alphabet: np.ndarray
    keys: dict
    logp: dict
    contexts: dict
    gamma: dict
    floor: np.ndarray
    beta: float = 1.0
    limit: float = float("inf")
    spread: float = 0.0

    def ids(self, code: np.ndarray) -> np.ndarray:
        table = np.full(0x110000, _LETTERS + 1, np.uint64)
        table[self.alphabet] = np.arange(len(self.alphabet))
        self.ids = lambda c: table[c]
        return table[code]

    def score(self, gram: np.ndarray) -> np.ndarray:
        """Log probability of the last letter of each packed n-gram, a column for each language."""
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        rest = np.arange(len(gram))
        for order in range(ORDER, 0, -1):
            g = gram[rest] & np.uint64((1 << _BITS * order) - 1)
            h = mix(g + np.uint64(order))
            at = np.minimum(np.searchsorted(self.keys[order], h), len(self.keys[order]) - 1)
            hit = self.keys[order][at] == h
            out[rest[hit]] += self.logp[order][at[hit]]
            rest = rest[~hit]
            if not len(rest):
                return out
            if order > 1:
                h = mix((g[~hit] >> np.uint64(_BITS)) + np.uint64(order))
                at = np.minimum(np.searchsorted(self.contexts[order], h), len(self.contexts[order]) - 1)
                seen = self.contexts[order][at] == h
                out[rest[seen]] += self.gamma[order][at[seen]]
        out[rest] += self.floor
        return out

    def entropies(self, column: pa.Array):
        """(cross-entropies of each row and language in bits, letters and spaces of each row, rows with a letter)."""
        at, data = text_buffers(column)
        n = len(at) - 1
        total, size, real = np.zeros((n, len(self.langs))), np.zeros(n, np.int64), np.zeros(n, bool)
        for lo, hi in slices(at):
            code, begin = letters(at, data, lo, hi)
            if not len(code):
                continue
            size[lo:hi] = np.diff(begin) - ORDER + 1
            real[lo:hi] = size[lo:hi] > 0
            logp = self.score(grams(self.ids(code), ORDER))
            sums = np.zeros((len(logp) + 1, len(self.langs)))
            np.cumsum(logp, axis=0, dtype=np.float64, out=sums[1:])
            total[lo:hi] = sums[np.maximum(begin[1:] - ORDER + 1, begin[:-1])] - sums[np.minimum(begin[:-1], len(logp))]
        return -total / np.maximum(size, 1)[:, None] / np.log(2), size, real

    def predict(self, column: pa.Array) -> pa.Array:
        ce, size, real = self.entropies(column)
        best = ce.argmin(axis=1)
        low = ce.min(axis=1)
        share = 1 / np.exp(-self.beta * (ce - low[:, None])).sum(axis=1)
        rejected = ~real | (low > self.limit + self.spread / np.sqrt(np.maximum(size, 1)))
        lang = np.where(real, np.array(self.langs, object)[best], "und")
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.where(real, share, 0.0)), pa.array(np.where(real, low, 0.0)), pa.array(rejected)], ["lang_pred", "score", "cross_entropy", "rejected"])


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, values, len(found))


def build(langs: list[str], alphabet: np.ndarray, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Kneser-Ney from each language's (packed n-grams of ORDER, counts): continuation counts below the top order."""
    model = Model(langs, alphabet, {}, {}, {}, {}, np.full(len(langs), -np.log(_UNICODE), np.float32))
    levels = {lang: {ORDER: counts[lang]} for lang in langs}
    for lang in langs:
        for order in range(ORDER - 1, 0, -1):
            g = levels[lang][order + 1][0] & np.uint64((1 << _BITS * order) - 1)
            levels[lang][order] = _sums(g, np.ones(len(g)))
    lower_keys, lower = None, None
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([levels[x][order][0] for x in langs]))
        contexts = np.unique(union >> np.uint64(_BITS))
        p, gamma = np.zeros((len(union), len(langs))), np.zeros((len(contexts), len(langs)))
        for j, lang in enumerate(langs):
            g, c = levels[lang][order]
            once, twice = (c == 1).sum(), (c == 2).sum()
            cut = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
            ctx, mass = _sums(g >> np.uint64(_BITS), c)
            _, follow = _sums(g >> np.uint64(_BITS), np.ones(len(g)))
            weight = np.ones(len(contexts))
            weight[np.searchsorted(contexts, ctx)] = cut * follow / mass
            gamma[:, j] = weight
            own = np.zeros(len(union))
            own[np.searchsorted(union, g)] = (c - cut) / mass[np.searchsorted(ctx, g >> np.uint64(_BITS))]
            below = lower[np.searchsorted(lower_keys, union & np.uint64((1 << _BITS * (order - 1)) - 1)), j] if order > 1 else 1 / _UNICODE
            p[:, j] = own + weight[np.searchsorted(contexts, union >> np.uint64(_BITS))] * below
        lower_keys, lower = union, p
        for name, keys, values in (("keys", union, p), ("contexts", contexts, gamma)):
            h = mix(keys + np.uint64(order))
            at = np.argsort(h)
            getattr(model, name)[order] = h[at]
            getattr(model, "logp" if name == "keys" else "gamma")[order] = np.log(values[at]).astype(np.float32)
        if order == 1:
            model.floor = (np.log(gamma[0]) - np.log(_UNICODE)).astype(np.float32)
    return model


def _letter_counts(batches):
    for batch in batches:
        at, data = text_buffers(batch.column(0))
        for lo, hi in slices(at):
            code, n = np.unique(letters(at, data, lo, hi)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])


def _gram_counts(alphabet: np.ndarray):
    model = Model([], alphabet, {}, {}, {}, {}, np.zeros(0))

    def run(batches):
        for batch in batches:
            for lang in batch.column(1).unique().to_pylist():
                own = batch.filter(pc.equal(batch.column(1), lang))
                at, data = text_buffers(own.column(0))
                for lo, hi in slices(at):
                    code, begin = letters(at, data, lo, hi)
                    ends = np.ones(len(code), bool)
                    for j in range(ORDER - 1):
                        ends[np.minimum(begin[:-1] + j, len(code) - 1)] = False
                    gram, n = np.unique(grams(model.ids(code), ORDER)[ends[ORDER - 1:]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fit and calibrate on rows with a text and a language; None where there are none."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(9)).alias("h"))
    sizes = {r.lang: r.b for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    draw = F.pmod("h", F.lit(1 << 20)) / float(1 << 20)
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample_bytes / max(1, sizes[lang]))))])
    # the sample is bounded in expectation, so it is kept in memory while it is read three times
    sample = rows.where(draw < share[F.col("lang")]).withColumn("u", F.pmod(F.xxhash64("h"), F.lit(1000)) / 1000.0).persist()
    train, held = sample.where(F.col("u") >= CALIBRATION), sample.where(F.col("u") < CALIBRATION)
    code = train.select("text").mapInArrow(_letter_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(_LETTERS).collect()
    alphabet = np.array([32, *[r.code for r in code if r.code != 32]], np.int64)[:_LETTERS]
    table = train.select("text", "lang").mapInArrow(_gram_counts(alphabet), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang in langs:
        own = table[table.lang == lang]
        counts[lang] = (own.gram.to_numpy(np.int64).view(np.uint64), own.n.to_numpy(float)) if len(own) else (np.zeros(1, np.uint64), np.ones(1))
    model = build(langs, alphabet, counts)
    _calibrate(model, held)
    sample.unpersist()
    return model


def _calibrate(model: Model, held: DataFrame) -> None:
    """Softness of the posterior by maximum likelihood; the highest cross-entropy of clean rows with a margin."""
    def run(batches):
        for batch in batches:
            ce, size, real = model.entropies(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(ce), pa.list_(pa.float64())), pa.array(size), pa.array(real)], names=["lang", "ce", "size", "real"])

    rows = held.select("text", "lang").mapInArrow(run, "lang string, ce array<double>, size long, real boolean").where("real").toPandas()
    if not len(rows):
        return
    ce = np.array(rows.ce.tolist())
    gold = np.array([model.langs.index(x) for x in rows.lang])
    apart = ce - ce.min(axis=1, keepdims=True)
    grid = [2.0 ** j for j in range(-1, 9)]
    model.beta = min(grid, key=lambda b: np.log(np.exp(-b * apart).sum(axis=1)).mean() + b * apart[np.arange(len(gold)), gold].mean())
    low = ce.min(axis=1)
    # a quarter above the 99.9 % quantile, and more room for short texts, whose cross-entropy spreads
    model.limit, model.spread = float(np.quantile(low, 0.999)) * 1.25, 8.0


def predictor(model: Model):
    """A column function of texts: RESULT."""
    box = SparkSession.getActiveSession().sparkContext.broadcast(model)  # its size is bounded by the sample's

    def predict(text: pa.Array) -> pa.Array:
        return box.value.predict(text)

    return F.arrow_udf(predict, RESULT).asNondeterministic()


def identify(docs: DataFrame, model: Model | None, text: Column | str = "text", name: str = "language") -> DataFrame:
    """docs with a column `name` (RESULT), in place of one that has this name. Null, empty and letterless texts: `und`, score 0, rejected.

    Without a model (nothing was labelled) every text is `und`, score 0, and none is rejected.
    """
    if model is None:
        known = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(False)}
        kinds = [part.strip().split(": ") for part in RESULT[len("struct<"):-1].split(",")]
        return docs.withColumn(name, F.struct(*[known.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds]))
    return docs.withColumn(name, predictor(model)(F.col(text) if isinstance(text, str) else text))
