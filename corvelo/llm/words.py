"""Words of texts and their hashes, for operators on shingles."""

from __future__ import annotations

import unicodedata

import numpy as np
import regex
import xxhash

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MARKS = regex.compile(r"\p{M}+")
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def plain_words(text: str | None) -> list[str]:
    """Lower-case words without accents, punctuation or layout; none for null."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text)


class WordHashes:
    """64-bit hashes of words, remembered as far as `most` different words."""

    def __init__(self, most: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words, by place of its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = words[:n].copy()
        for k in range(1, width):
            total = scramble(total + _MIX[0]) + words[k : k + n]
    return scramble(total)
