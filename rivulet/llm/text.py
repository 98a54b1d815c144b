"""Words and shingles of many texts at once, as arrays of 64-bit hashes.

A word is a maximal run of letters and digits in lower case.  Texts are handled as code points in numpy:
word hashes come from prefix sums of a polynomial, so no Python object is made for a word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Characters that are hashed in one go; bounds memory, not the length of a text.
SLICE = 1 << 20


@lru_cache(1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


@lru_cache(2)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _hash_slice(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``codes`` and where each starts."""
    inside = _alnum()[codes]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, U64), starts
    size = max(len(codes), SLICE)
    power, inverse = _tables(1 << (size - 1).bit_length())
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * power[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64)), starts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and per text the offset of its first word (one more offset at the end)."""
    hashes, counts = [], []
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size + len(texts[at]) < SLICE):
            group.append(texts[at].lower())
            size += len(group[-1]) + 1
            at += 1
        codes = np.frombuffer("\n".join(group).encode("utf-32-le", "replace"), np.uint32)
        h, starts = _hash_slice(codes)
        bounds = np.cumsum([0] + [len(t) + 1 for t in group])
        counts.append(np.diff(np.searchsorted(starts, bounds)))
        hashes.append(h)
    if not counts:
        return np.empty(0, U64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int64)


def shingle_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words in order, with repeats, and per text the offset of its first run."""
    words, offsets = word_hashes(texts)
    counts = np.maximum(np.diff(offsets) - (n - 1), 0)
    out_offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    total = int(out_offsets[-1])
    if not total:
        return np.empty(0, U64), out_offsets
    first = np.repeat(offsets[:-1] - out_offsets[:-1], counts) + np.arange(total)
    h = words[first]
    for k in range(1, n):
        h = mix(h * U64(0x2545F4914F6CDD1D) + words[first + k])
    return h, out_offsets
