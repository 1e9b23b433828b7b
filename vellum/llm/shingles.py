"""Five-word shingle sets as sorted 64-bit hashes, and their signatures."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Odd multipliers that set the places of a shingle's words apart.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text; with fewer words, of the whole sequence."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    width = min(WORDS, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mixed(total + h[k : k + n] * PLACES[k])
    return np.unique(total)


class Signer:
    """Minima of multiply-shift hashes (2-universal on 32-bit keys), in bands of rows."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        r = np.random.default_rng(seed)
        draw = lambda: r.integers(0, 1 << 63, (bands * rows, 1), np.uint64) << np.uint64(1) | np.uint64(1)
        self.bands, self.rows, self.a, self.b = bands, rows, draw(), draw()
        self.place = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def minima(self, hashes: np.ndarray, step: int = 512) -> np.ndarray:
        """The least value of every hash function over a non-empty set."""
        x = (hashes >> np.uint64(32)).reshape(1, -1)
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, x.shape[1], step):
            v = x[:, at : at + step] * self.a
            v += self.b
            np.minimum(out, v.min(1), out=out)
        return out >> np.uint64(32)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; keys of different bands differ."""
        m = self.minima(hashes).reshape(self.bands, self.rows)
        h = self.place.copy()
        for k in range(self.rows):
            h = mixed(h + m[:, k] * PLACES[k % len(PLACES)])
        return h


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection is at least `percent` times the union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
