"""Words of a text as numbers, for texts of any length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

CACHED_WORDS = 300_000
PIECE = 4 << 20  # bytes or characters of a long text split at once
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_WORD = re.compile(r"\w+")


def pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` in pieces that end at ASCII white space, so that no word is cut."""
    start = 0
    while start < len(raw):
        cut = _SPACE.search(raw, start + PIECE) if start + PIECE < len(raw) else None
        stop = cut.start() if cut else len(raw)
        yield raw[start:stop]
        start = stop


class WordCodes:
    """64-bit codes of words; keeps the codes of words it has met."""

    def __init__(self) -> None:
        self.known: dict = {}

    def of(self, words: list) -> np.ndarray:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def spaced(self, text: str) -> np.ndarray:
        """Words between ASCII white space, A-Z lower-cased."""
        found = [self.of(p.split()) for p in pieces(text.encode().lower())]
        return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.uint64), *found])

    def plain(self, text: str) -> np.ndarray:
        """Runs of letters, digits and underscores, lower-cased; punctuation is left out."""
        text = text.lower()
        if len(text) <= PIECE:
            return self.of(_WORD.findall(text))
        parts, block = [np.zeros(0, np.uint64)], []
        for m in _WORD.finditer(text):
            block.append(m.group())
            if len(block) == CACHED_WORDS:
                parts.append(self.of(block))
                block = []
        return np.concatenate([*parts, self.of(block)])
