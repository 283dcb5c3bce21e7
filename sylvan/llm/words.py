"""Hashes of words, word prefixes and word n-grams for many texts at once, with NumPy.

A word is a run of bytes (UTF-8 of the lower-cased text) without ASCII white
space, or, with ``letters``, without any ASCII character that is no letter or
digit. Its hash is a polynomial over a fixed random table of the bytes,
modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
OTHER = np.ones(256, bool)
for _c in range(256):
    OTHER[_c] = _c < 128 and not chr(_c).isalnum()
CHUNK = 1 << 20
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), BASE)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, start of each text in bytes) of consecutive texts, about CHUNK bytes each."""
    i = 0
    while i < len(texts):
        parts, size, j = [], 0, i
        while j < len(texts) and (j == i or size < CHUNK):
            parts.append((texts[j] or "").lower().encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            j += 1
        at = np.zeros(j - i + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=at[1:])
        yield i, j, np.frombuffer(b"\n".join([*parts, b""]), np.uint8), at
        i = j


def spans(data: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of every word."""
    gap = (OTHER if letters else SPACE)[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word; words must be the non-gap runs of ``data``."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    index = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    values = TABLE[data[np.repeat(start, length) + index]] * powers(int(length.max()))[index]
    return mix(np.add.reduceat(values, np.cumsum(length) - length) + length.astype(np.uint64))


def grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of each text's words, and where each text's n-grams start (one entry more than texts).

    ``first``: where each text's words start, one entry more than texts. A
    text of fewer than n words, but at least one, has one n-gram of them all.
    """
    count = np.diff(first)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    at = np.concatenate(([0], np.cumsum(size)))
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    owner = np.repeat(np.arange(len(count)), size)
    begin = first[owner] + np.arange(at[-1]) - at[owner]
    stop = np.minimum(begin + n, first[owner + 1])
    total = (stop - begin).astype(np.uint64)
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    for k in range(n):
        total = total + np.where(begin + k < stop, padded[begin + k], np.uint64(0)) * STEP[k]
    return mix(total), at


def gram_sets(texts: list[str | None], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, n-gram hashes, starts) for consecutive texts; repeats within a text are kept."""
    for i, j, data, at in chunks(texts):
        start, end = spans(data)
        g, where = grams(hashes(data, start, end), np.searchsorted(start, at), n)
        yield i, j, g, where
