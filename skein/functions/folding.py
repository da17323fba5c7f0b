"""Texts and queries as tokens that fold alike."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Combining marks that a token drops, and letters that fold to another than their lower case.
MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
VARIANTS = {"µ": "μ", "ſ": "s", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε", "ẛ": "s", "\u1fbe": "ι"}


def _plain(c: str) -> str:
    """The ASCII letter below a lower-case letter's one mark, else the letter: two marks, or other alphabets, stay."""
    parts = unicodedata.normalize("NFD", c)
    return parts[0] if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() else c


_MARKED = {c: _plain(c) for c in map(chr, range(0xC0, 0x2000)) if _plain(c) != c and c.islower()} | VARIANTS
FOLD_FROM, FOLD_TO = "".join(_MARKED), "".join(_MARKED.values())
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO, MARKS)


def folded(text: Column) -> Column:
    """Lower case, without the marks of letters of the Latin alphabet, composed or not; queries fold alike."""
    # what stands behind the letters has no counterpart and goes
    return F.translate(F.lower(text), FOLD_FROM + MARKS, FOLD_TO)


def tokens(text: Column) -> Column:
    """Runs of letters, digits and private characters, folded."""
    return F.filter(F.split(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def phrases(query: str) -> list[list[str]]:
    """The phrases of a query: one for each white-space separated field; quotes and operators are plain text."""
    out = []
    for field in query.split():
        text = field.lower().translate(_FOLD)
        words = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in text).split()
        if words:
            out.append(words)
    return out
