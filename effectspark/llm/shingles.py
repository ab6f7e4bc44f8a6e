"""Word shingles of a text as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from effectspark.llm.words import WordCodes

WORDS = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    """Sets of distinct ``WORDS``-word shingles."""

    def __init__(self) -> None:
        self.words = WordCodes()

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; with fewer words one hash for all of them; none without a word.

        A-Z are lower-cased; words are separated by ASCII white space alone.
        """
        codes = self.words.spaced(text or "")
        if not len(codes):
            return codes
        span = min(WORDS, len(codes))
        out = np.full(len(codes) - span + 1, span, np.uint64)
        for k in range(span):
            out = out * _MULTIPLIER + codes[k : len(codes) - span + 1 + k]
        out ^= out >> np.uint64(31)
        out *= _MIX
        out ^= out >> np.uint64(29)
        return np.unique(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    common = int((b[place] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
