"""Whole texts as arrays of code points, with 64-bit hashes of words and word windows.

Hashes are polynomials modulo 2^64 over mixed code points, read off a running sum; words and
windows thus cost a few array operations per character and no Python object each."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_WINDOW = np.uint64(0xD6E8FEB86659FD93)
#: Characters that are hashed at a time; their 64-bit numbers fit a core's cache.
SEGMENT = 1 << 16

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64."""
    found = _powers.get(base)
    if found is None or len(found) <= n:
        steps = np.full(max(n, SEGMENT) + 1, base, np.uint64)
        steps[0] = 1
        found = _powers[base] = np.multiply.accumulate(steps)
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Texts:
    """Texts in one array of code points, a line break after each."""

    def __init__(self, texts: list[str], lower: bool = False):
        joined = "\n".join(texts) + "\n"
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if lower:
            self.codes = np.where((self.codes >= 65) & (self.codes <= 90), self.codes + 32, self.codes).astype(np.uint32)
        self.count = len(texts)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]]).astype(np.int64)
        blank = (self.codes == 32) | ((self.codes >= 9) & (self.codes <= 13))
        edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(self.first, self.starts, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.count)
        self.word_chars = np.bincount(self.doc, weights=self.ends - self.starts, minlength=self.count).astype(np.int64)

    def word_hashes(self) -> np.ndarray:
        """One 64-bit hash per word. Works through segments of whole words."""
        out = np.empty(len(self.starts), np.uint64)
        lo = 0
        while lo < len(out):
            begin = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, begin + SEGMENT, "right")))
            chars = self.codes[begin : self.ends[hi - 1]].astype(np.uint64)
            terms = mix(chars + _WINDOW) * _power(_BASE, len(chars))[: len(chars)]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
            s, e = self.starts[lo:hi] - begin, self.ends[lo:hi] - begin
            out[lo:hi] = mix((sums[e] - sums[s]) * _power(_BACK, len(chars))[s])
            lo = hi
        return out

    def windows(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each window of `size` words inside one text."""
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(n, np.uint64)
        for i in range(size):
            total = mix(total * _WINDOW + words[i : i + n])
        inside = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return total[inside], inside

    def spans(self) -> np.ndarray:
        """Index of each text's first word, and the number of all words."""
        return np.concatenate([[0], np.cumsum(self.n_words)])


def sums_by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring bounds."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]
