"""Exact token counts of every prefix of a text, by prefix dynamic programming over a BPE vocabulary.

The encoding of a prefix ends in exactly one token t, and what precedes t is the encoding of the shorter prefix:
so count[i] = count[i - len(t)] + 1, where t is the vocabulary piece ending at i that may follow the last token of
that shorter prefix. Two tokens may follow each other if the library encodes their joined text as just these two.
With the counts kept, "how many tokens has text[:i]" and "how much text fits in a budget" need no encoding.

A white-space mark only begins a piece, and a character without a piece falls back to its bytes, so a text falls
into chunks that are counted alone. The recurrence runs over all new distinct short chunks of a slice at once, and
along a long chunk (a text without spaces) with the pieces that an automaton finds to end at each place. The counts
of a chunk's prefixes are stored, and budgets are answered from them. Totals of chunks with unusual characters are
compared with the library's, whose count holds if they ever differ; `overruled` says in how many chunks of a text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix

LIMIT = 4096
MARK = "▁"
RESULT = "struct<n_tokens: long, fits_chars: long, overruled: long>"
#: Chunks whose counts a worker keeps; the store is emptied beyond it.
KEPT = 700_000
_LONG = 48
_PAIRS = 2_000_000
#: Chunks of other characters than these are also counted by the library, whose count holds if they ever differ.
_PLAIN = re.compile(r" ?[!-~À-ÖØ-öø-ÿŒœŸ]+")
_CHUNK = re.compile(r" *[^ \n]+| +|\n")
_B = np.uint64(0x9E3779B97F4A7C15)
_UNB = np.uint64(pow(int(_B), -1, 1 << 64))


class PrefixCounter:
    """Counts prefixes with the pieces of a sentencepiece BPE model."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) or self.library.is_byte(i))]
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(p) for i in usable if len(p := self.pieces[i]) == 1]] = True
        if self.known[10]:
            raise ValueError("a piece holds a line break; chunks end at these")
        self.longest = max(len(self.pieces[i]) for i in usable)
        hashes = np.array([self._hash(self.pieces[i]) for i in usable], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(usable, np.int64)[order]
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.hashes >> np.uint64(46)).astype(np.int64)] = True
        # a direct-mapped store of pairs known to (not) stand side by side; id n is the begin of a chunk
        self.begin = n
        self.pair = np.full(1 << 21, -1, np.int64)
        self.fits = np.zeros(1 << 21, bool)
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.counts: dict[str, int] = {}
        self.prefixes: dict[str, bytes] = {}
        self.overruled: set[str] = set()

    @staticmethod
    def _hash(piece: str) -> int:
        value = 0
        for j, c in enumerate(piece):
            value += (ord(c) * 2 + 1) * 0xD6E8FEB86659FD93 % (1 << 64) * pow(int(_B), j, 1 << 64)
        return int(mix(np.array([value % (1 << 64) + 0], np.uint64) + np.uint64(len(piece)))[0])

    def _may_follow(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = last * (self.begin + 1) + token
        slot = (mix(key.astype(np.uint64)) >> np.uint64(43)).astype(np.int64)
        new = np.unique(key[self.pair[slot] != key])
        out = self.fits[slot]
        if len(new):
            sides = [divmod(int(k), self.begin + 1) for k in new]
            joined = ["\n" + (("" if a == self.begin else self.pieces[a]) + self.pieces[b]).replace(MARK, " ") for a, b in sides]
            got = [x[2:] == ([b] if a == self.begin else [a, b]) for x, (a, b) in zip(self.library.encode(joined, num_threads=1), sides, strict=True)]
            got = np.array(got, bool)
            out = np.where(self.pair[slot] == key, out, got[np.minimum(np.searchsorted(new, key), len(new) - 1)])
            at = (mix(new.astype(np.uint64)) >> np.uint64(43)).astype(np.int64)
            self.pair[at], self.fits[at] = new, got
        return out

    def table(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts at every prefix of every chunk, offsets): chunks of known characters, marks for spaces."""
        size = np.array([len(c) for c in chunks], np.int64)
        first = np.concatenate([[0], np.cumsum(size + 1)])
        code = np.frombuffer("".join(c + "\n" for c in chunks).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(code)
        up, down = np.full(n, _B, np.uint64), np.full(n, _UNB, np.uint64)
        up[:1], down[:1] = 1, 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((code * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * up, out=total[1:])
        # place of prefix i of chunk c: first[c] + i
        count, last = np.zeros(n, np.int32), np.full(n, -1, np.int64)
        last[first[:-1]] = self.begin
        order = np.argsort(-size, kind="stable")
        sorted_first, sorted_size = first[:-1][order], size[order]
        for i in range(1, int(size.max(initial=0)) + 1):
            rest = sorted_first[:np.searchsorted(-sorted_size, -i, "right")]
            for l in range(min(i, self.longest), 0, -1):
                a = rest + i - l
                h = mix((total[rest + i] - total[a]) * down[a] + np.uint64(l))
                some = np.flatnonzero(self.maybe[(h >> np.uint64(46)).astype(np.int64)] & (last[a] >= 0))
                at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
                real = self.hashes[at] == h[some]
                some, at = some[real], at[real]
                if len(some):
                    token = self.ids[at]
                    good = self._may_follow(last[a[some]], token)
                    hit = some[good]
                    last[rest[hit] + i] = token[good]
                    count[rest[hit] + i] = count[a[hit]] + 1
                    left = np.ones(len(rest), bool)
                    left[hit] = False
                    rest = rest[left]
                if not len(rest):
                    break
        return count, first

    def _parts(self, chunk: str) -> list[str]:
        """Runs of known characters, and each unknown character alone."""
        out, begin = [], 0
        for j, c in enumerate(chunk):
            if not self.known[ord(c)]:
                out += [chunk[begin:j], c] if j > begin else [c]
                begin = j + 1
        return out + [chunk[begin:]] if begin < len(chunk) else out

    def _follows(self, last: int, token: int) -> bool:
        key = last * (self.begin + 1) + token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            head, want = ("", [token]) if last == self.begin else (self.pieces[last], [last, token])
            found = self.pairs[key] = self.library.encode("\n" + (head + self.pieces[token]).replace(MARK, " "))[2:] == want
        return found

    def _along(self, part: str) -> list[int]:
        """Counts of the prefixes of a run of known characters, from its first one on.

        Exactly one of the pieces that end at a place may follow; the shortest needs no test when no other does.
        """
        count, last = [0] * (len(part) + 1), [self.begin] * (len(part) + 1)
        place, ending = -1, []

        def settle(i: int) -> None:
            for n, token in ending[:-1]:
                if self._follows(last[i - n], token):
                    break
            else:
                n, token = ending[-1]
            count[i], last[i] = count[i - n] + 1, token

        for end, found in self.automaton.iter(part):
            if end != place:
                if ending:
                    settle(place + 1)
                place, ending = end, []
            ending.append(found)
        settle(place + 1)
        return count[1:]

    def prefix_counts(self, chunk: str) -> np.ndarray:
        """The token counts of chunk[:0], chunk[:1], ... with marks for spaces."""
        out = [0]
        for part in self._parts(chunk):
            if len(part) == 1 and not self.known[ord(part)]:
                # the bytes of one character come and go together
                out.append(out[-1] + len(part.encode("utf-8", "replace")))
            else:
                out += [out[-1] + x for x in self._along(part)]
        return np.array(out)

    def chunk_prefixes(self, chunk: str) -> np.ndarray:
        """prefix_counts of a chunk of a text; stored ones where it is short and of known characters."""
        found = self.prefixes.get(chunk)
        return self.prefix_counts(chunk.replace(" ", MARK)) if found is None else np.frombuffer(found, np.uint8).astype(np.int64)

    def text_prefixes(self, text: str) -> np.ndarray:
        """The token counts of text[:0], text[:1], ... of a whole text."""
        chunks = self.chunks(text)
        self.learn(set(chunks))
        out, total = [np.zeros(1, np.int64)], 0
        for c in chunks:
            # the first letter of the first chunk is the mark that the library puts before every text
            inside = self.chunk_prefixes(c)[1:] + total
            if not total:
                inside = inside[1:]
            out.append(inside)
            total += self.counts[c]
        return np.concatenate(out)

    def learn(self, chunks: set[str]) -> None:
        """Count new distinct chunks, all at once."""
        if len(self.counts) > KEPT:
            self.counts.clear()
            self.prefixes.clear()
            self.overruled.clear()
        counts = self.counts
        new = [c for c in chunks if c not in counts]
        if not new:
            return
        letters = set("".join(new).replace(" ", MARK))
        odd = [c for c in letters if not self.known[ord(c)]]
        hard = re.compile("[" + "".join(map(re.escape, odd)) + "]") if odd else None
        easy = [c for c in new if len(c) <= _LONG and not (hard and hard.search(c))]
        for lo in range(0, len(easy), 100_000):
            part = easy[lo:lo + 100_000]
            count, first = self.table([c.replace(" ", MARK) for c in part])
            counts.update(zip(part, count[first[1:] - 1].tolist(), strict=True))
            # a short chunk's counts fit in a byte each
            raw, edge = count.astype(np.uint8).tobytes(), first.tolist()
            self.prefixes.update((c, raw[edge[j]:edge[j + 1]]) for j, c in enumerate(part))
        for c in new:
            if c not in counts:
                counts[c] = int(self.prefix_counts(c.replace(" ", MARK))[-1])
        unusual = [c for c in new if not _PLAIN.fullmatch(c)]
        for c, x in zip(unusual, self.library.encode(["\n" + c for c in unusual], num_threads=1), strict=True):
            if counts[c] != len(x) - 2:
                counts[c] = len(x) - 2
                self.overruled.add(c)

    @staticmethod
    def chunks(text: str) -> list[str]:
        return _CHUNK.findall(" " + text) if text else []

    def count(self, chunks: list[str], size: int, budget: int = LIMIT) -> tuple[int, int]:
        """(tokens of the text that the learned chunks make up, length of its longest prefix within the budget)."""
        counts = self.counts
        total = sum(map(counts.__getitem__, chunks))
        if total <= budget:
            return total, size
        done, at = 0, -1
        for c in chunks:
            if done + counts[c] > budget:
                inside = self.chunk_prefixes(c)
                return total, max(0, at + int(np.flatnonzero(inside <= budget - done)[-1]))
            done, at = done + counts[c], at + len(c)
        return total, size


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _count(path: str, budget: int):
    def run(text: pa.Array) -> pa.Array:
        counter = _counter(path)
        values = [v or "" for v in text.to_pylist()]
        n, fits, odd, lo = [], [], [], 0
        while lo < len(values):
            hi, size = lo, 0
            while hi < len(values) and (hi == lo or size + len(values[hi]) < 2_000_000):
                size += len(values[hi])
                hi += 1
            found = [counter.chunks(v) for v in values[lo:hi]]
            counter.learn(set().union(*found))
            for v, chunks in zip(values[lo:hi], found, strict=True):
                a, b = counter.count(chunks, len(v), budget)
                n.append(a)
                fits.append(b)
                odd.append(sum(map(counter.overruled.__contains__, chunks)) if counter.overruled else 0)
            lo = hi
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(fits, pa.int64()), pa.array(odd, pa.int64())], ["n_tokens", "fits_chars", "overruled"])
    return run


def _prefixes(path: str):
    def run(text: pa.Array) -> pa.Array:
        counter = _counter(path)
        return pa.array([counter.text_prefixes(t.as_py() or "") for t in text], pa.list_(pa.int32()))
    return run


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts) of every row: counts[i] is the tokens of the text's first i characters; null texts are empty.

    To be written once: `fits` and `counts[i]` then answer truncation and budget questions without the tokenizer.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(_prefixes(path), "array<int>").asNondeterministic()(F.col(text_col).cast("string")).alias("counts"))


def fits(counts: Column, budget: Column | int) -> Column:
    """Length of the longest prefix within a budget; counts of a prefix may be larger than those of a longer one."""
    return F.coalesce(F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i))), F.lit(0))


def token_counts(docs: DataFrame, path: str, budget: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fits_chars, overruled) of every row; null and empty texts have no tokens.

    fits_chars is the length of the longest prefix of at most `budget` tokens. Ids may be null or repeated.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.arrow_udf(_count(path, budget), RESULT).asNondeterministic()(text).alias("r"))
    return found.select("doc_id", "n_bytes", "r.n_tokens", (F.col("r.n_tokens") > budget).alias("over_limit"), "r.fits_chars", "r.overruled")
