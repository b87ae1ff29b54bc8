"""Word shingles of whole texts as sorted arrays of 64-bit hashes (numpy, on the executors)."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import CACHES

U = np.uint64
_A, _B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)  # splitmix64's multipliers

#: Words whose hashes a worker remembers.
WORDS_KEPT = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _A
    x = (x ^ (x >> U(27))) * _B
    return x ^ (x >> U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()
CACHES.append(_words)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; fewer words make one run; none: empty.

    A-Z become lower case; words are what ASCII white space (0x20, 0x09-0x0D) separates.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(_words.__getitem__, words), U, len(words))
    n = min(k, len(h))
    runs = len(h) - n + 1
    acc = np.full(runs, n, U)
    for j in range(n):
        acc = mix(acc + h[j : j + runs])
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))] if runs > 1 else acc


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())
