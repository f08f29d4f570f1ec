"""Words and shingles of texts as 64-bit hashes, shared by the operators on near copies and repeats."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

#: Odd multipliers of the polynomial over word hashes and of the final mix.
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SPACE = re.compile(rb"[ \t-\r]")
#: Bytes whose words are held at once.
PART = 1 << 20


class Powers:
    """Powers of a factor modulo 2^64, grown as texts need them."""

    def __init__(self, factor: np.uint64):
        self.factor, self.held = factor, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.held):
            grown = np.full(max(n, 2 * len(self.held)), self.factor, np.uint64)
            grown[0] = 1
            self.held = np.cumprod(grown)
        return self.held[:n]


def inverse(factor: np.uint64) -> np.uint64:
    return np.uint64(pow(int(factor), -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word, cut at space and \\x09-\\x0D, which is what bytes.split() does."""
    return np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(xxhash.xxh3_64_intdigest, p.split()), np.uint64) for p in parts(raw))])


def parts(raw: bytes, size: int = PART) -> Iterator[bytes]:
    """raw in parts of about that size, cut at white space."""
    at = 0
    while len(raw) - at > size and (gap := SPACE.search(raw, at + size)):
        yield raw[at : gap.start()]
        at = gap.start()
    yield raw[at:]


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of so many words, by its start: a polynomial over hashes that are no polynomials themselves."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * FACTOR + words[k : k + n]
    return mixed(h)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct shingles; with fewer words the whole sequence is one; none without words.

    bytes.lower() lowers A-Z alone.
    """
    found = word_hashes((text or "").encode().lower())
    if not len(found):
        return found
    # a sequence of fewer words is told from others by its length
    own = runs(found, size) if len(found) >= size else runs(found, len(found)) + np.uint64(len(found))
    own.sort()
    return own[np.concatenate([[True], own[1:] != own[:-1]])]
