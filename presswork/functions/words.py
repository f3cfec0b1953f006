"""Plain Python twins of the token expressions, for grouped functions that work on words."""

from __future__ import annotations

import re

from . import lexicon as L

WORD = re.compile(r"[가-힣]+|[a-z][a-z0-9+]*|\d+(?:\.\d+)?%?")
SUFFIXES = [re.compile(f"^(.{{2,}}?)(?:{'|'.join(sorted(x, key=len, reverse=True))})$") for x in (L.ENDINGS, L.PARTICLES)]


def stem(word: str) -> str:
    """word without its longest ending and then its longest particle, two characters or more being left."""
    if not word[:1].isdigit():
        for suffix in SUFFIXES:
            word = suffix.sub(r"\1", word)
    return word


def tokens(text: str) -> list[str]:
    return [w for w in map(stem, WORD.findall(text.casefold())) if len(w) >= 2 and w not in L.CONTENT_STOPWORDS]


def grams(words: list[str]) -> set[str]:
    """Adjacent character pairs of each word; short words and numbers stay whole."""
    whole = {w for w in words if len(w) <= 2 or w[0].isdigit()}
    return whole.union(*({a + b for a, b in zip(w, w[1:], strict=False)} for w in words if w not in whole))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0
