"""A gated recurrent language model over words, and exact unigram counts of the whole corpus beside it.

Counts of all training words are one distributed aggregation. The words up to a fixed number are the model's own;
the output softmax is factored by frequency classes (class, then word in class); all other words share one symbol,
and which of them it is comes from their counts, with a discount that leaves room for words never seen, which are spelled
by a model of byte pairs, learned from the words seen once. Weights
are fitted in numpy by back-propagation through windows of STEPS tokens: one task warms the model up on a bounded
draw, then every shard goes on from there with all of its training documents, also where there is one shard only,
and the shards' weights are averaged.

Documents are scored whole: many are run side by side, the state is carried from window to window and cleared
between documents. Frequent words are looked up where they stand, in a table of bounded size; the others are
joined with the counts by word, one row for each document and word.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices, text_buffers
from .shared import crc_mod, materialise, most_frequent

HIDDEN = 32
EMBEDDED = 24
CLASSES = 40
#: Words of the model, and of the table that is sent to each executor.
MODEL_WORDS = 2000
TABLE_WORDS = 200_000
STEPS = 32
#: Documents of a training shard, and of the warm-up.
SHARD_DOCS = 8192
WARM_DOCS = 983
DISCOUNT = 0.5
#: Bytes of text that are split into words at once.
SLICE_TEXT = 4 << 20
#: Bytes of words that are counted at once.
COUNTED_BYTES = 36 << 20
_OTHER, _END = 0, 1
LN10 = math.log(10)


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words [^\\x20\\x09-\\x0D]+ of a slice of texts with A-Z in lower case, the text of each); splits and folds on ASCII only."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.cast(pa.string()).fill_null("")))
    text, words = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().cast(pa.binary())
    ink = pc.not_equal(pc.binary_length(words), 0)
    return words.filter(ink), text[ink.to_numpy(zero_copy_only=False)]


def _pieces(column: pa.Array):
    """Slices of a text column with about SLICE_TEXT bytes each."""
    offsets, _ = text_buffers(column)
    return (column.slice(lo, hi - lo) for lo, hi in slices(offsets, SLICE_TEXT))


def _keep_memory() -> None:
    """A large block, freed at once, makes the C library keep freed arrays up to its size instead of mapping each anew."""
    np.empty(31 << 20, np.uint8)


def _exponentials(logits: np.ndarray, far: bool) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials, their sums by column); logits are shifted by their columns' maxima first if any may be far from 0."""
    if far:
        logits -= logits.max(axis=0)
    e = np.exp(logits)
    return e, np.ones(len(e), e.dtype) @ e


def _step(p: np.ndarray, old: np.ndarray, inner: np.ndarray, gates: np.ndarray, new: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One step of the gated unit: fills gates (keep, reset), the new content and the state; sigmoid and tanh by exp.

    What belongs to a gate is a block of its own in p and inner, so that all arithmetic runs over whole blocks.
    """
    q = old @ inner
    np.add(p[:2], q[:2], out=gates)
    np.exp(gates, out=gates)
    gates += np.float32(1)
    np.reciprocal(gates, out=gates)
    np.multiply(gates[1], q[2], out=new)
    new += p[2]
    np.exp(new, out=new)
    new += np.float32(1)
    np.reciprocal(new, out=new)
    new *= np.float32(2)
    new -= np.float32(1)
    np.subtract(old, new, out=state)
    state *= gates[0]
    state += new
    return q[2]


def _sum_by_symbol(rows: np.ndarray, symbols: np.ndarray, n: int) -> np.ndarray:
    """For each of n symbols the sum of its rows (the axis before the last)."""
    order = np.argsort(symbols.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    symbols = symbols[order]
    begin = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    size = np.diff(np.append(begin, len(symbols)))
    out = np.zeros((*rows.shape[:-2], n, rows.shape[-1]), rows.dtype)
    # symbols of many rows by products with ones; all others side by side, those of most rows first
    few = 16
    one = np.ones(size.max(), rows.dtype)
    for lo, k in zip(begin[size > few].tolist(), size[size > few].tolist(), strict=True):
        out[..., symbols[lo], :] = one[:k] @ rows.take(order[lo:lo + k], axis=-2)
    by_size = np.argsort(-size, kind="stable")
    by_size = by_size[np.count_nonzero(size > few):]
    begin, size = begin[by_size], size[by_size]
    if len(begin):
        total = rows.take(order[begin], axis=-2)
        for r in range(1, size[0]):
            a = np.count_nonzero(size > r)
            total[..., :a, :] += rows.take(order[begin[:a] + r], axis=-2)
        out[..., symbols[begin], :] = total
    return out


class Network:
    """Weights of the recurrent model; plain arrays by name, so that they can be averaged and sent."""

    def __init__(self, counts: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(counts)
        normal = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
        # classes of equal frequency mass, words in order of frequency; symbols keep their own classes
        mass = np.maximum(counts, 1.0)
        order = np.argsort(-mass, kind="stable")
        share = np.cumsum(np.sqrt(mass[order]))
        self.cls = np.zeros(n, np.int32)
        self.cls[order] = np.minimum(CLASSES - 1, (share / share[-1] * CLASSES).astype(np.int32))
        _, self.cls = np.unique(self.cls, return_inverse=True)
        self.cls = self.cls.astype(np.int32)
        self.members = [np.flatnonzero(self.cls == c) for c in range(self.cls.max() + 1)]
        self.by_class = np.concatenate(self.members)
        self.begin = np.cumsum([0] + [len(m) for m in self.members])
        self.place = np.zeros(n, np.int32)
        for m in self.members:
            self.place[m] = np.arange(len(m))
        total = np.array([mass[m].sum() for m in self.members])
        self.w = {"E": normal(n, EMBEDDED) * np.float32(3), "X": normal(EMBEDDED, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32), "U": normal(HIDDEN, 3 * HIDDEN),
                  "C": normal(HIDDEN, len(total)) * np.float32(0.1), "c": np.log(total / total.sum()).astype(np.float32),
                  "W": normal(n, HIDDEN) * np.float32(0.1), "v": (np.log(mass) - np.log(total[self.cls])).astype(np.float32)}
        self.w["E"] /= np.float32(math.sqrt(EMBEDDED) / math.sqrt(n) * 3)

    def outputs(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each y after state h; with grad, adds gradients of its mean and returns that of h."""
        w, n = self.w, len(y)
        k = self.cls[y]
        # tokens of the same class side by side; few classes sort fastest as small numbers
        order = np.argsort(k.astype(np.uint8 if len(self.members) < 256 else np.int32), kind="stable")
        edge = np.searchsorted(k[order], np.arange(len(self.members) + 1)).tolist()
        # biases are weights of a last state that is always 1
        state = np.ones((n, h.shape[1] + 1), h.dtype)
        state[:, :-1] = h.take(order, axis=0)
        size = np.diff(edge)
        # where each token's own word is among the logits of its class
        own = self.place[y[order]] * np.repeat(size, size) + np.arange(n) - np.repeat(edge[:-1], size)
        C, W = (np.concatenate([x, b[:, None]], axis=1) for x, b in ((w["C"].T, w["c"]), (w["W"].take(self.by_class, axis=0), w["v"].take(self.by_class))))
        most = np.float32(max(state.max(initial=1), -state.min(initial=1)))
        far = most * max(np.abs(C).sum(axis=1).max(), np.abs(W).sum(axis=1).max()) > 60
        # a row for each class or word, a column for each token: sums run along whole rows
        logits = C @ state.T
        e, s = _exponentials(logits, far)
        found, inside = np.empty(n, logits.dtype), np.ones(n, logits.dtype)
        for c in range(len(self.members)):
            found[edge[c]:edge[c + 1]] = logits[c, edge[c]:edge[c + 1]]
        dh = None
        if grad is not None:
            e *= 1 / (s * n)
            for c in range(len(self.members)):
                e[c, edge[c]:edge[c + 1]] -= np.float32(1 / n)
            d = e @ state
            grad["C"] += d[:, :-1].T
            grad["c"] += d[:, -1]
            dh = e.T @ C[:, :-1]
            dW = np.zeros_like(W)
        for c in range(len(self.members)):
            lo, hi, a, b = edge[c], edge[c + 1], self.begin[c], self.begin[c + 1]
            if lo == hi or b - a == 1:
                continue
            logits = W[a:b] @ state[lo:hi].T
            at = own[lo:hi]
            e, inside[lo:hi] = _exponentials(logits, far)
            found[lo:hi] += logits.ravel().take(at)
            if grad is not None:
                e *= 1 / (inside[lo:hi] * n)
                e.ravel()[at] -= np.float32(1 / n)
                np.matmul(e, state[lo:hi], out=dW[a:b])
                dh[lo:hi] += e.T @ W[a:b, :-1]
        out = np.empty_like(found)
        out[order] = found - np.log(s) - np.log(inside)
        if grad is not None:
            grad["W"][self.by_class] += dW[:, :-1]
            grad["v"][self.by_class] += dW[:, -1]
            back = np.empty_like(order)
            back[order] = np.arange(n)
            dh = dh.take(back, axis=0)
        return out, dh

    def gated(self) -> tuple[np.ndarray, np.ndarray]:
        """What each symbol and each state adds to the gates, a block for each gate, times -1 or, for the new content, -2, as _step takes them."""
        w, sign = self.w, np.array([-1, -1, -2], np.float32)[:, None, None]
        blocks = lambda x: np.ascontiguousarray(x.reshape(-1, 3, HIDDEN).transpose(1, 0, 2)) * sign
        table = w["E"] @ blocks(w["X"])
        table += blocks(w["b"])
        return table, blocks(w["U"])

    @np.errstate(over="ignore")
    def train(self, streams: np.ndarray, fresh: np.ndarray, rate: float = 3e-3) -> None:
        """One pass of Adam over token streams (steps, streams), windows of STEPS; fresh marks begins of documents."""
        w, u = self.w, HIDDEN
        first, second, tick = {n: np.zeros_like(x) for n, x in w.items()}, {n: np.zeros_like(x) for n, x in w.items()}, 0
        lanes = streams.shape[1]
        h = np.zeros((lanes, u), np.float32)
        before = np.vstack([np.full((1, lanes), _END, streams.dtype), streams[:-1]])
        before = np.where(fresh, _END, before)
        space = lambda *shape: np.empty((*shape, lanes, u), np.float32)
        held, gates, news, recurrent, states = space(STEPS), space(STEPS, 2), space(STEPS), space(STEPS), space(STEPS)
        # by step what reaches the new content, keep, reset, and the new content's recurrent part
        deltas, a, b = space(4, STEPS), space(), space()
        one = np.float32(1)
        for lo in range(0, len(streams), STEPS):
            x, y = before[lo:lo + STEPS], streams[lo:lo + STEPS]
            m = len(y)
            new = [np.flatnonzero(f) for f in fresh[lo:lo + STEPS]]
            table, inner = self.gated()
            for t in range(m):
                held[t] = h
                held[t][new[t]] = 0
                recurrent[t] = _step(table.take(x[t], axis=1), held[t], inner, gates[t], news[t], states[t])
                h = states[t]
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            _, dout = self.outputs(states[:m].reshape(-1, u), y.ravel(), grad)
            dout = dout.reshape(m, -1, u)
            h, dh = h.copy(), np.zeros_like(h)
            back = np.ascontiguousarray(w["U"].reshape(u, 3, u).transpose(1, 2, 0))
            for t in range(m - 1, -1, -1):
                dn, keep, reset, dr = deltas[0, t], deltas[1, t], deltas[2, t], deltas[3, t]
                z, r, n = gates[t, 0], gates[t, 1], news[t]
                dh += dout[t]
                np.subtract(one, z, out=a)
                # new content: (1 - z) (1 - n n)
                np.multiply(n, n, out=b)
                np.subtract(one, b, out=b)
                np.multiply(a, b, out=dn)
                dn *= dh
                # keep: (old - n) z (1 - z); what goes on to the old state is dh z
                dh *= z
                np.subtract(held[t], n, out=keep)
                keep *= a
                keep *= dh
                # reset: recurrent r (1 - r), where recurrent has a factor of -2
                np.multiply(dn, r, out=dr)
                np.subtract(r, one, out=reset)
                reset *= np.float32(0.5)
                reset *= recurrent[t]
                reset *= dr
                for part in deltas[1:, t] @ back:
                    dh += part
                dh[new[t]] = 0
            flat = deltas[:, :m].reshape(4, -1, u)
            beside = lambda blocks: np.concatenate([blocks[1], blocks[2], blocks[0]], axis=1)
            grad["U"] = np.concatenate(list(held[:m].reshape(-1, u).T @ flat[1:]), axis=1)
            dtable = beside(_sum_by_symbol(flat[:3], x.ravel(), table.shape[1]))
            grad["E"], grad["X"], grad["b"] = dtable @ w["X"].T, w["E"].T @ dtable, dtable.sum(axis=0)
            norm = math.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            tick += 1
            step = rate * math.sqrt(1 - 0.999 ** tick) / (1 - 0.9 ** tick)
            for k, g in grad.items():
                g *= np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
                first[k] += np.float32(0.1) * (g - first[k])
                second[k] += np.float32(0.001) * (g * g - second[k])
                w[k] -= np.float32(step) * first[k] / (np.sqrt(second[k]) + np.float32(1e-8))

    @np.errstate(over="ignore")
    def log_probabilities(self, docs: list[np.ndarray], side: int = 256, span: int = 64) -> np.ndarray:
        """Natural log probability of each document's ids; `side` documents run beside each other."""
        size = np.array([len(d) for d in docs])
        total = np.zeros(len(docs))
        if not len(docs):
            return total
        side = min(side, len(docs))
        load = [(0, s, []) for s in range(side)]
        for d in np.argsort(-size, kind="stable"):
            n, s, held = load[0]
            held.append(int(d))
            heapq.heapreplace(load, (n + int(size[d]), s, held))
        load.sort(key=lambda x: -x[0])
        steps = load[0][0]
        length = np.array([x[0] for x in load])
        ids, owner = np.zeros((steps, side), np.int32), np.zeros((steps, side), np.int32)
        fresh = np.zeros((steps, side), bool)
        for s, (n, _, held) in enumerate(load):
            ids[:n, s] = np.concatenate([docs[d] for d in held]) if n else 0
            owner[:n, s] = np.repeat(held, size[held])
            begins = np.cumsum(size[held])[:-1]
            fresh[np.append(0, begins[begins < n]) if n else [], s] = True
        u = HIDDEN
        table, inner = self.gated()
        h = np.zeros((side, u), np.float32)
        states = np.empty((span * side, u), np.float32)
        last = np.full(side, _END, np.int32)
        live = np.searchsorted(-length, -np.arange(steps), "left").tolist()
        for lo in range(0, steps, span):
            hi = min(steps, lo + span)
            n = 0
            gates, news = np.empty((2, live[lo], u), np.float32), np.empty((live[lo], u), np.float32)
            for t in range(lo, hi):
                a = live[t]
                if a < news.shape[0]:
                    gates, news = np.empty((2, a, u), np.float32), np.empty((a, u), np.float32)
                new = np.flatnonzero(fresh[t, :a])
                last, old = last[:a].copy(), h[:a].copy()
                last[new], old[new] = _END, 0
                h = states[n:n + a]
                _step(table.take(last, axis=1), old, inner, gates, news, h)
                n += a
                last = ids[t, :a]
            h = h.copy()
            out, _ = self.outputs(states[:n], np.concatenate([ids[t, :live[t]] for t in range(lo, hi)]))
            total += np.bincount(np.concatenate([owner[t, :live[t]] for t in range(lo, hi)]), out, len(docs))
        return total


class Lexicon:
    """The frequent words with their counts, and what is needed of all the others."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, kinds: int, ends: int, letters: np.ndarray | None = None):
        letters = np.zeros((257, 257)) if letters is None else letters
        # pairs of bytes, smoothed towards how often the right one occurs at all
        right = letters.sum(axis=0) + 1.0
        self.spelled = np.log10((letters + 4 * right / right.sum()) / (letters.sum(axis=1, keepdims=True) + 4)).astype(np.float32).ravel()
        self.words, self.counts, self.tokens, self.kinds, self.ends = words, counts, tokens, kinds, ends
        own = int(counts[:MODEL_WORDS].sum())
        self.other_tokens, self.other_kinds = tokens - ends - own, max(0, kinds - 1 - min(len(words), MODEL_WORDS))

    def model_counts(self) -> np.ndarray:
        return np.concatenate([[max(1, self.other_tokens), max(1, self.ends)], self.counts[:MODEL_WORDS]]).astype(np.float64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Each word's place in the table, or -1."""
        if not hasattr(self, "_table"):
            self._table = pa.array(self.words, pa.binary())
        return pc.index_in(words, value_set=self._table).fill_null(-1).to_numpy()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def model_ids(self, at: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
        """Model symbols of n texts, each with its end, from its words' places."""
        size = np.bincount(text, minlength=n) + 1
        out = np.full(len(at) + n, _END, np.int32)
        out[np.arange(len(at)) + text] = np.where((at >= 0) & (at < MODEL_WORDS), at + 2, _OTHER)
        return np.split(out, np.cumsum(size)[:-1]) if n else []

    def spelling(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word's letters, given that it is one never seen."""
        if not words:
            return np.zeros(0)
        pair, first = _pairs_of(words)
        return np.add.reduceat(self.spelled[pair].astype(np.float64), first)

    def share_of_other(self, count: np.ndarray) -> np.ndarray:
        """log10 probability of a word of this count among words outside the model."""
        unseen = max(DISCOUNT * self.other_kinds, DISCOUNT)
        return np.log10(np.where(count > 0, count - DISCOUNT, unseen) / max(self.other_tokens, 1.0))


def _count(batches):
    held, size = [], 0

    def rows():
        found = pc.value_counts(pa.chunked_array(held))
        held.clear()
        return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "c"])

    for batch in batches:
        for piece in _pieces(batch.column(0)):
            words, _ = _words(piece)
            held.append(words)
            size += words.nbytes
            if size > COUNTED_BYTES:
                yield rows()
                size = 0
    if size:
        yield rows()


def _streams(docs: list[np.ndarray], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another, cut into `side` streams of equal length; the last is filled up from the first document on."""
    ids, fresh = np.concatenate(docs), np.zeros(sum(map(len, docs)), bool)
    fresh[np.append(0, np.cumsum([len(d) for d in docs])[:-1])] = True
    n = -(-len(ids) // side)
    return np.resize(ids, n * side).reshape(side, n).T.copy(), np.resize(fresh, n * side).reshape(side, n).T.copy()


def _fit(box, weights, side: int, rate: float):
    """Weights after one pass over a task's documents, in fewer streams if they are short; a task without any reports none."""
    def run(batches):
        _keep_memory()
        lexicon = box.value
        docs = []
        for batch in batches:
            for piece in _pieces(batch.column(0)):
                words, text = _words(piece)
                docs += lexicon.model_ids(lexicon.places(words), text, len(piece))
        if docs:
            net = Network(lexicon.model_counts())
            if weights is not None:
                net.w = {k: v.copy() for k, v in weights.value.items()}
            net.train(*_streams(docs, max(1, min(side, sum(map(len, docs)) // STEPS))), rate)
            yield _row(net.w, 1)
    return run


def _row(w: dict, n: int) -> pa.RecordBatch:
    flat = np.concatenate([w[k].ravel() for k in sorted(w)])
    return pa.RecordBatch.from_arrays([pa.array([flat.astype("<f4").tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])


def _average(batches):
    total, n = None, 0
    for batch in batches:
        for raw, k in zip(batch.column(0), batch.column(1), strict=True):
            w = np.frombuffer(raw.as_py(), "<f4").astype(np.float64) * k.as_py()
            total, n = (w if total is None else total + w), n + k.as_py()
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype("<f4").tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])


def _unpacked(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def fit(texts: DataFrame, lexicon: Lexicon, n_docs: int) -> Network:
    """Warm up on a bounded draw of texts (id, text), then average the weights of shards that hold all of them."""
    spark = texts.sparkSession
    box = spark.sparkContext.broadcast(lexicon)
    shards = max(1, n_docs // SHARD_DOCS)
    net = Network(lexicon.model_counts())
    draw = texts.withColumn("h", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1 << 20)) / float(1 << 20))
    schema = "weights binary, n long"
    warm = draw.where(F.col("h") < min(1.0, WARM_DOCS / max(1, n_docs))).select("text").repartition(1)
    first = warm.mapInArrow(_fit(box, None, 32, 3e-3), schema).collect()
    if first:
        net.w = _unpacked(np.frombuffer(first[0].weights, "<f4"), net.w)
    weights = spark.sparkContext.broadcast(net.w)
    rows = texts.repartition(shards, F.xxhash64("id", F.lit(5))).select("text").mapInArrow(_fit(box, weights, 256, 6e-3), schema)
    rows, left = materialise(rows, "weights"), shards
    while left > 16:
        left = -(-left // 16)
        rows = materialise(rows.repartition(left).mapInArrow(_average, schema), "weights")
    found = rows.collect()
    if found:
        n = sum(r.n for r in found)
        net.w = _unpacked(sum(np.frombuffer(r.weights, "<f4").astype(np.float64) * (r.n / n) for r in found), net.w)
    return net


def _score(box):
    def run(batches):
        _keep_memory()
        net, lexicon = box.value
        known = lexicon.counts.astype(np.float64)
        log_count = np.append(np.log10(known + 1), 0.0)
        other = np.append(lexicon.share_of_other(known), 0.0)
        other[:MODEL_WORDS] = 0.0
        base_all = math.log10(lexicon.tokens + lexicon.kinds + 1)
        end = math.log10(lexicon.ends + 1) - base_all
        for batch in batches:
            symbols, stats, first = [], [], 0
            for piece in _pieces(batch.column(2)):
                words, text = _words(piece)
                n, at = len(piece), lexicon.places(words)
                uids, learned = (batch.column(c).slice(first, n).to_numpy(zero_copy_only=False) for c in (0, 3))
                first += n
                symbols += lexicon.model_ids(at, text, n)
                size = np.bincount(text, minlength=n)
                stats.append((size + 1, np.bincount(text[at >= 0], minlength=n) + (lexicon.ends > 0), np.bincount(text, log_count[at], n) - base_all * size + end, np.bincount(text, other[at], n)))
                yield from _rare_rows(lexicon, words.filter(pa.array(at < 0)), text[at < 0], uids, learned)
            if not symbols:
                continue
            size, seen, base, share = (np.concatenate(x) for x in zip(*stats, strict=True))
            score = net.log_probabilities(symbols) / LN10 + share
            n = len(size)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1).cast(pa.int64()), pa.array([b" %d" % u for u in batch.column(0).to_pylist()], pa.binary()), pa.array(np.zeros(n, np.int64)), pa.array(size, pa.int64()), pa.array(seen, pa.int64()),
                pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(np.zeros(n, np.float32))], names=_NAMES)
    return run


def _rare_rows(lexicon: Lexicon, words: pa.Array, text: np.ndarray, uids: np.ndarray, learned: np.ndarray):
    """A row for each text and word outside the table. Words of texts that were learned from are counted, so never spelled."""
    if not len(words):
        return
    coded = words.dictionary_encode()
    kinds = len(coded.dictionary)
    key, tf = np.unique(text * kinds + coded.indices.to_numpy(), return_counts=True)
    text, code = np.divmod(key, kinds)
    spelled = np.zeros(kinds, np.float32)
    unsure = np.unique(code[~learned[text]])
    spelled[unsure] = lexicon.spelling(coded.dictionary.take(pa.array(unsure)).to_pylist())
    for lo in range(0, len(key), 100_000):
        part = slice(lo, lo + 100_000)
        m = len(key[part])
        zero, none = pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m))
        yield pa.RecordBatch.from_arrays([pa.array(uids[text[part]]), pa.nulls(m, pa.int64()), coded.dictionary.take(pa.array(code[part])), pa.array(tf[part], pa.int64()), zero, zero, none, none, pa.array(spelled[code[part]])], names=_NAMES)


_NAMES = ["uid", "doc_id", "word", "tf", "n_tokens", "n_known", "base", "score", "spelled"]


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all words of all texts."""
    return materialise(texts.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")


def lexicon(counts: DataFrame, n_docs: int) -> Lexicon:
    """The most frequent words within the bound of the table, exactly, and the letters of words seen once."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    table = most_frequent(counts.where(F.octet_length("word") <= 256), "c", "word", TABLE_WORDS).toPandas()
    table = table.sort_values(["c", "word"], ascending=[False, True])
    pairs = counts.where("c = 1").select("word").mapInArrow(_letter_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    letters = np.zeros(257 * 257)
    letters[pairs.pair.to_numpy(np.int64)] = pairs.n.to_numpy(float)
    return Lexicon(table.word.map(bytes).tolist(), table.c.to_numpy(np.int64), int(total.n or 0) + n_docs, int(total.v) + (n_docs > 0), n_docs, letters.reshape(257, 257))


def _letter_pairs(batches):
    """Pairs of neighbouring bytes of words as 257 * left + right; 256 is a word's begin and its end."""
    for batch in batches:
        pair, n = np.unique(_pairs_of(batch.column(0).to_pylist())[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(n.astype(np.int64))], names=["pair", "n"])


def _pairs_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of all words in order, place of each word's first pair)."""
    size = np.array([len(w) + 1 for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    right = np.full(int(first[-1]), 256, np.int64)
    inner = np.ones(len(right), bool)
    inner[first[1:] - 1] = False
    right[inner] = np.frombuffer(b"".join(words), np.uint8)
    left = np.roll(right, 1)
    left[first[:-1]] = 256
    return left * 257 + right, first[:-1]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from the rest.

    A row is held out if crc32 of its id as text leaves `held` modulo `modulus`; rows without an id are neither
    held out nor learned from. Null and empty texts are their end alone. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(crc_mod(F.col(id_col), modulus) == held, F.lit(False)).alias("held_out"))
    train = frame.where("not held_out and doc_id is not null")
    n_docs = train.count()
    counts = corpus_counts(train)
    lex = lexicon(counts, n_docs)
    net = fit(train.select(F.col("doc_id").alias("id"), "text"), lex, n_docs)
    box = spark.sparkContext.broadcast((net, lex))
    # a row's own number joins its parts again; it is the same when a lost task reads the same part of the input
    rows = frame.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", F.expr("not held_out and doc_id is not null").alias("learned")).mapInArrow(_score(box), "uid long, doc_id long, word binary, tf long, n_tokens long, n_known long, base double, score double, spelled float")
    joined = rows.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    unseen = max(DISCOUNT * lex.other_kinds, DISCOUNT)
    # an unseen word has its share of what all unseen words have together by its letters
    each = F.log10(F.when(c > 0, c - DISCOUNT).otherwise(unseen) / float(max(lex.other_tokens, 1))) + F.when(c > 0, 0.0).otherwise(F.col("spelled").cast("double"))
    other = F.when(F.col("tf") > 0, F.col("tf") * each).otherwise(0.0)
    rare_base = F.col("tf") * F.log10(c + 1)
    parts = joined.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"), F.sum(F.col("base") + rare_base).alias("base_score"), F.sum(F.col("score") + other).alias("score"))
    return parts.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(lex.tokens).cast("long").alias("train_tokens"), "base_score", "score")
