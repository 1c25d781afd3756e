"""Vectorised word and shingle hashes over the bytes of many texts at once.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased. A word's
hash is a polynomial over the 64-bit integers, taken as a difference of prefix
sums, so no Python code runs for each word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): all texts' bytes with A-Z lower-cased, and where words start and end.

    Text i has the words first[i]:first[i + 1].
    """
    buf = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    texts_end = np.cumsum([len(t) + 1 for t in texts])
    return buf, starts, ends, np.concatenate([[0], np.searchsorted(starts, texts_end - 1, "left")]).astype(np.int64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    power, inverse = _powers(1 << max(20, int(len(buf)).bit_length()))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_byte_values()[buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the word hashes of all texts in order."""
    buf, starts, ends, first = word_spans(texts)
    return span_hashes(buf, starts, ends), first


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all runs of ``width`` words; a text of fewer words, but not none, has one."""
    hashes, first = words(texts)
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(len(texts)), made)
    start = first[owner] + (np.arange(at[-1]) - at[owner])
    out = np.zeros(len(start), np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    short = (counts < width)[owner]
    length = counts[owner]
    for k in range(width):
        part = mix(padded[start + k] + np.uint64((0xA0761D6478BD642F * (k + 1)) % (1 << 64)))
        out += np.where(short & (k >= length), np.uint64(0), part) if short.any() else part
    return mix(out), at
