"""Hashed word shingles of whole texts, vectorised over the bytes of a batch.

A word's hash is a polynomial of random numbers for its bytes modulo 2**64, mixed; a shingle's is a
polynomial of its words' hashes, mixed again. Shingles count as equal when their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np

_DRAW = np.random.default_rng(20240613)
_BYTE = _DRAW.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PI = pow(_P, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text (A-Z count as a-z)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_P, len(data)), out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * _powers(_PI, len(data))[starts])
    return words, np.diff(np.searchsorted(starts, ends_of_text), prepend=0)


def shingle_sets(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other and sorted; their numbers.

    Texts of fewer than k words have their whole sequence as the one shingle; texts without words, none.
    """
    words, n = word_hashes(texts)
    first = np.cumsum(n) - n
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + first[text]
    long = np.minimum(n, k)[text]
    q, total = _powers(_Q, k), np.zeros(len(text), np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        total += np.where(j < long, padded[at + j] * q[j], np.uint64(0))
    hashes = mix(total + long.astype(np.uint64) * np.uint64(_P))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(text), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[keep], np.bincount(text[keep], minlength=len(texts))
