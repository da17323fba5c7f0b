"""Personal data in texts: plain identifiers, and disguised ones found on a normalised text with an offset map.

Transducers rewrite a text step by step and keep, for each output character, the source range it stands for:
homoglyphs and full-width forms to ASCII, invisible characters to nothing, spelled digits to digits, and the
disguises of @ and dots (" at ", "(at)", "[dot]" ...) to the characters. Identifiers found in the result are mapped
back to source characters. Plain identifiers of the source always stay; found ones that overlap a plain one of
any kind are the same datum and are dropped. Where a plain match fails because it ran from one identifier into the
next ("+1 (555) 555-0100 4111..."), what it holds by usual grouping is added too.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, small_batches

KINDS = ("email", "ip", "card", "phone")
RESULT = "struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string, n_disguised: long>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS, _DIGIT = re.compile(r"[^0-9]"), re.compile(r"[0-9]")
_CARD_GROUPS = re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")
_PHONE_GROUPS = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, by the @ signs, so that long runs cost no more than once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            done = found.end()
            out.append((begin, done))
            at = text.find("@", done)
        else:
            done, at = at + 1, text.find("@", at + 1)
    return out


def _is_card(m: re.Match) -> bool:
    digits = _DIGITS.sub("", m[0])
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_phone(m: re.Match) -> bool:
    return 10 <= len(_DIGITS.sub("", m[0])) <= 15


def _split(m: re.Match) -> list[tuple[int, int, int]]:
    """Identifiers in a match that ran over the end of one into the next, by their usual grouping."""
    inside = [(x.start(), 3, x.end()) for x in _PHONE_GROUPS.finditer(m.string, m.start(), m.end()) if _is_phone(x)]
    return inside + [(x.start(), 2, x.end()) for x in _CARD_GROUPS.finditer(m.string, m.start(), m.end()) if _is_card(x)]


def find(text: str, dropped: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of plain identifiers, leftmost and non-overlapping in each kind, by start and kind.

    What failing matches hold by usual grouping is added to `dropped`, where it is given.
    """
    lost: list[re.Match] = []

    def kept(pattern: re.Pattern, good) -> list[tuple[int, int]]:
        found = list(pattern.finditer(text))
        lost.extend(m for m in found if m.end() - m.start() > 13 and not good(m))
        return [m.span() for m in found if good(m)]

    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) < 4 for x in m[0].split("."))]
    out += [(a, 2, b) for a, b in kept(_CARD, _is_card)]
    if "+" in text:
        out += [(a, 3, b) for a, b in kept(_PHONE, _is_phone)]
    if dropped is not None:
        dropped += {x for m in lost for x in _split(m)}
    return sorted(out)


# Letters of other scripts that look like ASCII ones, then punctuation, spaces and invisible characters.
_CYRILLIC = {"а": "a", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
             "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y"}
_GREEK = {"α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
          "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X"}
_MARKS = {"\u2219": ".", "\u2024": ".", "\u3002": ".", "\ufe52": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\ufe63": "-", "\u2212": "-", "\ufe6b": "@", "\u00a0": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ", "\u0131": "i", "\u0261": "g", "\u0251": "a"}
_GONE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_DIGIT_FORMS = {chr(base + d): str(d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_DIGIT_FORMS |= {c: str(d) for d, c in enumerate("⁰¹²³⁴⁵⁶⁷⁸⁹")} | {c: str(d) for d, c in enumerate("₀₁₂₃₄₅₆₇₈₉")}
_LETTER_FORMS = {chr(base + i): chr(first + i) for base in (0x1D400, 0x1D434, 0x1D468, 0x1D5A0, 0x1D5D4, 0x1D608, 0x1D63C, 0x1D670) for first, shift in ((65, 0), (97, 26)) for i in range(26) for base in (base + shift,)}
FOLD = _LETTER_FORMS | _CYRILLIC | _GREEK | _MARKS | _WIDE | _DIGIT_FORMS | dict.fromkeys(_GONE, "")
_FOLD_RE = re.compile("[" + "".join(map(re.escape, FOLD)) + "]")

# Digits as words in the languages of the corpus.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
            "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
            "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
            "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
_DIGIT_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_JOIN = r"[\s,.()-]{1,3}"
_PART = rf"(?:{_DIGIT_WORD}|(?:double|triple)\s+{_DIGIT_WORD}|plus|[0-9]+)"
_RUN = re.compile(rf"(?<!\w)(?:plus\s+|\+\s?)?{_PART}(?:{_JOIN}(?:dot\s+|point\s+|punkt\s+|punto\s+)?{_PART}){{3,}}(?!\w)", re.I)
_WORD = re.compile(r"\w+|[^\w]+")
_DOT_WORDS = {"dot", "point", "punkt", "punto"}
# True wherever a _RUN holds the three digit words that _spelled asks for.
_BETWEEN = r"(?:[\s,.()+0-9-]++|plus|dot|point|punkt|punto|double|triple)++"
_RUN_HINT = re.compile(rf"(?<!\w){_DIGIT_WORD}(?:{_BETWEEN}{_DIGIT_WORD}){{2}}(?!\w)", re.I)
_WORDS = re.compile(r"\w+")

_AT = r"(?:\s*[\[({<]\s*(?:at|@|arobase|arroba)\s*[\])}>]\s*|\s+(?:at|arobase|arroba)\s+|\s+@\s*|\s*@\s+|@)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|point|punkt|punto|\.)\s*[\])}>]\s*|\s+(?:dot|point|punkt|punto)\s+|\s+\.\s+|\.)"
_ATOM = r"[A-Za-z0-9_%+-]{1,64}"
_DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+-]){_ATOM}(?:{_DOT}{_ATOM}){{0,4}}?{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}(?![A-Za-z0-9])", re.I)
# True wherever _DISGUISED or _IP_DISGUISED would rewrite anything: a bracketed sign, a spaced @ or dot, a dot word, or a plain "at" before a dotted host.
_DISGUISE_HINT = re.compile(r"[\s\[({<@](?:(?<=[\[({<])\s*(?:at|@|arobase|arroba|dot|point|punkt|punto|\.)\s*[\])}>]|(?<=\s)(?:@|\.\s|(?:dot|point|punkt|punto)\s|(?:at|arobase|arroba)\s+[A-Za-z0-9-]{1,63}\.[A-Za-z0-9-])|(?<=@)\s)", re.I)
# Endings that let a plain "name at host.ending" count as an address.
_PLAIN_TAIL = re.compile(r"\.(?:com|org|net|edu|gov|mil|info|biz|io|ai|dev|app|co|uk|us|eu|de|fr|es|it|nl|ch|at|be|pt|pl|se|ru|cn|jp|in|br|mx|ar|ca|au|test|example|invalid)$", re.I)
_IP_DISGUISED = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_AT_RE, _DOT_RE = re.compile(_AT, re.I), re.compile(_DOT, re.I)


class Mapped:
    """A rewritten text; character i stands for source characters begin[i] to end[i]."""

    def __init__(self, text: str):
        self.text, self.begin, self.end, self.changed = text, list(range(len(text))), list(range(1, len(text) + 1)), False

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply non-overlapping edits (from, to, new text), in order; new characters stand for the whole range."""
        if not edits:
            return
        text, begin, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            begin += self.begin[at:a] + [self.begin[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.begin, self.end, self.changed = begin + self.begin[at:], end + self.end[at:], True


def _spelled(run: str) -> str | None:
    """The digits of a run of spelled ones; None if hardly any word is a spelled digit."""
    out, times, words = [], 1, 0
    for m in _WORD.finditer(run):
        w = m[0].lower()
        if w in _SPELLED:
            out.append(_SPELLED[w] * times)
            times, words = 1, words + 1
        elif w in ("double", "triple"):
            times = 2 if w == "double" else 3
        elif w == "plus":
            out.append("+")
        elif w in _DOT_WORDS:
            out.append(".")
        elif w.isdigit():
            out.append(w)
        elif "+" in w:
            out.append("+")
        elif w.strip() == ".":
            out.append(".")
    return "".join(out) if words >= 3 else None


def normalise(text: str) -> Mapped:
    """The text after all transducers."""
    out = Mapped(text)
    if not text.isascii() and _FOLD_RE.search(text):
        out.replace([(m.start(), m.end(), FOLD[m[0]]) for m in _FOLD_RE.finditer(text)])
    # cheap tests first, true wherever the scan behind them finds anything: most texts have no spelled digit and no disguise
    if sum(map(_SPELLED.__contains__, _WORDS.findall(out.text.lower()))) >= 3 and _RUN_HINT.search(out.text):
        out.replace([(m.start(), m.end(), new) for m in _RUN.finditer(out.text) if (new := _spelled(m[0]))])
    if _DISGUISE_HINT.search(out.text):
        edits = []
        for m in _DISGUISED.finditer(out.text):
            body, at = m[0], _AT_RE.search(m[0])
            tail = body[at.end():]
            if at[0].strip().isalpha() and not _PLAIN_TAIL.search(tail) and all(d[0] == "." for d in _DOT_RE.finditer(tail)):
                continue  # "rest at noon.Then" is prose
            for d in _DOT_RE.finditer(body, 0, at.start()):
                edits.append((m.start() + d.start(), m.start() + d.end(), "."))
            edits.append((m.start() + at.start(), m.start() + at.end(), "@"))
            for d in _DOT_RE.finditer(body, at.end()):
                edits.append((m.start() + d.start(), m.start() + d.end(), "."))
        out.replace(edits)
        out.replace([(m.start() + d.start(), m.start() + d.end(), ".") for m in _IP_DISGUISED.finditer(out.text) for d in _DOT_RE.finditer(m[0]) if d[0] != "."])
    return out


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(plain spans, spans added by the transducers) of (start, kind, end) in source characters."""
    added: list[tuple[int, int, int]] = []
    base = find(text, added)
    mapped = normalise(text)
    if mapped.changed:
        more: list[tuple[int, int, int]] = []
        for a, kind, b in find(mapped.text, more) + more:
            lo, hi = mapped.begin[a], mapped.end[b - 1]
            # only what touches something rewritten is new
            if hi - lo != b - a or text[lo:hi] != mapped.text[a:b]:
                added.append((lo, kind, hi))
    taken, new = sorted((a, b) for a, _, b in base), []
    for a, kind, b in sorted(set(added)):
        i = bisect_left(taken, (b,))
        if not any(x < b and a < y for x, y in taken[max(0, i - 6):i]):
            new.append((a, kind, b))
            taken.insert(bisect_left(taken, (a, b)), (a, b))
    return base, new


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def _report(text: pa.Array) -> pa.Array:
    counts, hashes, told, more = [[], [], [], []], [], [], []
    for value in text:
        s = value.as_py() or ""
        base, added = spans(s)
        for k in range(4):
            counts[k].append(sum(x[1] == k for x in base))
        plain = _joined(base)
        hashes.append(hashlib.sha256(plain.encode()).hexdigest())
        told.append(_joined(base + added) if added else plain)
        more.append(len(added))
    return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(told, pa.string()), pa.array(more, pa.int64())], ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"])


def redact(text: str) -> str:
    """The text with each identifier, plain or disguised, replaced by its kind in brackets."""
    out, at = [], 0
    for a, kind, b in sorted(sum(spans(text), [])):
        if b <= at:
            continue
        out += [text[at:max(at, a)], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _redacted(text: pa.Array) -> pa.Array:
    give_back()
    return pa.array([None if (s := v.as_py()) is None else redact(s) for v in text], pa.string())


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, plain counts, hash of plain spans, all spans, number of disguised ones.

    Null and empty texts have no spans; ids may be null or repeated. Positions are code points, ends exclusive.
    """
    small_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(_report, RESULT).asNondeterministic()(F.col(text_col).cast("string")).alias("r"))
    return found.select("doc_id", "r.*")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with identifiers in text_col replaced; null stays null."""
    small_batches(docs.sparkSession)
    return docs.withColumn(text_col, F.arrow_udf(_redacted, "string")(F.col(text_col)))
