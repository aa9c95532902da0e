"""Words, shingles and MinHash values of whole texts, as numpy arrays inside tasks.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased; texts come as UTF-8 bytes (a binary column), so
nothing is decoded. A shingle is the 64-bit hash of ``width`` successive words; a shorter text is one shingle of all its words.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: Words kept in a worker's cache before it starts anew; a bound on memory, not on results.
CACHE = 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits, in place on a fresh array."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit multipliers: the hash functions of a MinHash family."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_weights = odd_numbers(64, 5)


def word_hashes(text: bytes | None) -> np.ndarray:
    words = text.lower().split() if text else []
    return np.fromiter(map(_hashes.__getitem__, words), U, len(words))


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of successive word windows in text order; one hash if there are fewer words; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    total = words[: n - k + 1] * _weights[0]
    for i in range(1, k):
        total += words[i : n - k + 1 + i] * _weights[i]
    return mix(total + U(k))


def minhashes(values: np.ndarray, family: np.ndarray, block: int = 2048) -> np.ndarray:
    """The least value of each hash function over the set, in blocks so that a very long text needs little memory."""
    out = np.full(len(family), ~U(0))
    for i in range(0, len(values), block):
        np.minimum(out, (family[:, None] * values[None, i : i + block]).min(axis=1), out=out)
    return out
