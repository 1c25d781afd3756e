"""Suffix arrays by Larsson-Sadakane refinement and Kasai common prefixes, in numpy.

Both run over whole arrays at a time: refinement sorts all unsorted groups of a
round together, and Kasai's scan runs in many lanes, each with its own stretch of
the text and its own carried prefix length.
"""

from __future__ import annotations

import numpy as np

_LANES = 16384


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, rank) of ``text`` (uint8): suffixes in order, and each one's place. Texts of under 2**31 bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    # the first bytes of each suffix side by side in one word, in as many bits as the text's bytes need; zero is the end
    used = np.zeros(256, bool)
    used[text] = True
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, int(used.sum()) + 1)
    bits = int(used.sum()).bit_length()
    h = 64 // bits
    wide = np.zeros(n + h, np.uint64)
    wide[:n] = code[text]
    key = np.zeros(n, np.uint64)
    for k in range(h):
        key |= wide[k : n + k] << np.uint64(bits * (h - 1 - k))
    sa = np.argsort(key).astype(np.int32)
    key = key[sa]
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key, wide
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    new[:-1] &= new[1:]  # alone in its group
    at = np.flatnonzero(~new).astype(np.int32)
    while len(at):
        suffix = sa[at]
        after = suffix + np.int32(h)
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[suffix].astype(np.uint64) << np.uint64(32) | follow.astype(np.uint64)
        order = np.argsort(both)
        both = both[order]
        suffix = suffix[order]
        new = np.ones(len(at), bool)
        np.not_equal(both[1:], both[:-1], out=new[1:])
        sa[at] = suffix
        rank[suffix] = np.maximum.accumulate(np.where(new, at, 0))
        new[:-1] &= new[1:]
        at = at[~new]
        h *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, limit: int | None = None) -> np.ndarray:
    """For each place in ``sa``, the length of the common prefix with the suffix before it (0 for the first).

    With ``limit``, lengths of at least ``limit`` may come out shorter, but not below it.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    eight = np.zeros(n + 1, np.uint64)
    for k in range(8):
        eight |= padded[k : n + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    of = np.zeros(n, np.int64)
    stretch = -(-n // _LANES)
    at = np.arange(0, n, stretch)
    end = np.minimum(at + stretch, n)
    length = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        far = np.maximum(at, other) + length
        differ = eight[np.minimum(at + length, n)] ^ eight[np.minimum(np.maximum(other, 0) + length, n)]
        more = _same_bytes(differ)
        grown = length + more
        done = (other < 0) | (more < 8) | (far + 8 >= n)
        if limit:
            done |= grown >= limit
        capped = np.where(other < 0, 0, np.minimum(grown, n - np.maximum(at, other)))
        of[at[done]] = capped[done]
        length = np.where(done, np.maximum(capped - 1, 0), grown)
        at = at + done
        alive = at < end
        if not alive.all():
            at, end, length = at[alive], end[alive], length[alive]
    return of[sa]


def _same_bytes(differ: np.ndarray) -> np.ndarray:
    """How many low bytes of each word are zero."""
    count = np.zeros(len(differ), np.int64)
    rest = differ.copy()
    for step, mask in ((4, 0xFFFFFFFF), (2, 0xFFFF), (1, 0xFF)):
        zero = (rest & np.uint64(mask)) == 0
        count += np.where(zero, step, 0)
        rest = np.where(zero, rest >> np.uint64(8 * step), rest)
    return np.where(differ == 0, 8, count)
