"""Word shingles as sets of 64-bit numbers, computed whole texts at a time with numpy."""

import hashlib

import numpy as np
import xxhash

#: Words whose hash a worker remembers; it forgets all of them beyond that.
REMEMBERED = 100_000
_FACTORS = np.array([0x9E3779B97F4A7C15], np.uint64)


class _Words(dict):
    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of so many words, hashed and in order; empty for a text without words.

    A-Z count as a-z, and words are parted by ASCII white space.  A text of fewer words is one shingle.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    found = np.full(len(parts) - width + 1, width, np.uint64)
    for k in range(width):
        found = _mixed(found * _FACTORS + hashes[k : len(parts) - width + 1 + k])
    return np.unique(found)


def set_key(found: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()
