"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: words whose hashes a task remembers
MEMO_WORDS = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class _Memo(dict):
    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = self[word] = self.hash(word)
        return h


class Shingler:
    """Texts (UTF-8 bytes) to word hashes and shingle hashes.

    A-Z is lowered; words are runs of bytes other than space and tab to carriage return.
    """

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, _Memo()

    def word_hashes(self, raw: bytes) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        words = raw.lower().split()
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.uint64, count=len(words))

    def windows(self, hashes: np.ndarray) -> np.ndarray:
        """The shingle at every position; the whole sequence as one if it is shorter; none without words."""
        n = len(hashes)
        if n == 0:
            return hashes
        k = min(self.words, n)
        out = np.full(n - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = (out + hashes[i : n - k + 1 + i]) * _MULTIPLIER
            out ^= out >> np.uint64(31)
        return mix(out)

    def distinct(self, raw: bytes) -> np.ndarray:
        """The sorted distinct shingles."""
        return np.unique(self.windows(self.word_hashes(raw)))
