"""Word shingles of whole texts as sorted 64-bit hashes, vectorised over bytes."""

from __future__ import annotations

import numpy as np

WORDS = 5
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_JOIN = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves no pattern."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word: maximal runs other than space and bytes 9 to 13, A-Z as a-z."""
    b = np.frombuffer(data, dtype=np.uint8)
    word = np.concatenate([[False], ~_SPACE[b], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(b))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[b] * up, dtype=np.uint64)])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, sorted; fewer words than a shingle are one shingle; no words: none."""
    w = word_hashes((text or "").encode())
    if not len(w):
        return w
    n = max(1, len(w) - words + 1)
    h = np.full(n, min(len(w), words), dtype=np.uint64)
    for k in range(min(words, len(w))):
        h = h * _JOIN + w[k : k + n]
    return np.unique(mixed(h))
