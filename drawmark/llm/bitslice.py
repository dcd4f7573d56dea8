"""Hamming neighbours among 64-bit fingerprints by bit-sliced comparison, within one task.

Fingerprints are stored as 64 bit planes: plane j holds bit j of 64 fingerprints (lanes) in each word. A query is
compared with a word's 64 lanes at once: the differing lanes of a plane are a query bit's XOR with the plane's word,
and per-lane distances are counted in a few bit planes of counters, two planes at a time through a carry-save adder.
Counters start so that the carry out of the highest one marks a lane beyond the radius; words in which all lanes
asked for are beyond it are abandoned."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = 8  # planes between two looks for words to abandon
_TASKS = 1 << 15  # (query, word) comparisons in memory at a time


def bit_planes(fingerprints: np.ndarray) -> np.ndarray:
    """(64, words) matrix of the planes; unused lanes of the last word are zero."""
    n = len(fingerprints)
    bits = np.zeros((-(-max(n, 1) // 64) * 64, 64), dtype=np.uint8)
    bits[:n] = np.unpackbits(fingerprints.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)


def _low_ones(k: np.ndarray) -> np.ndarray:
    """Words whose lowest k (0 to 64) bits are set."""
    k = k.astype(np.uint64)
    return np.where(k >= 64, _ONES, (np.uint64(1) << np.minimum(k, np.uint64(63))) - np.uint64(1))


def near_lanes(planes: np.ndarray, queries: np.ndarray, words: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (query, word) the lanes of ``asked`` within ``radius``: (index of the comparison, lanes as bits), if any."""
    at = np.arange(len(words))
    width = max(1, int(radius).bit_length())
    begin = (1 << width) - 1 - radius
    counters = [np.full(len(words), _ONES if begin >> t & 1 else 0, dtype=np.uint64) for t in range(width)]
    alive = asked.copy()
    for first in range(0, 64, _STEP):
        for j in range(first, first + _STEP, 2):
            a, b = (planes[k][words] ^ (np.uint64(0) - ((queries >> np.uint64(k)) & np.uint64(1))) for k in (j, j + 1))
            # full adder: the lowest counter and two planes give a sum and a carry
            both = a ^ b
            carry = (a & b) | (counters[0] & both)
            counters[0] = counters[0] ^ both
            for t in range(1, width):
                counters[t], carry = counters[t] ^ carry, counters[t] & carry
            alive &= ~carry
        left = alive != 0
        n_left = int(np.count_nonzero(left))
        if not n_left:
            return at[:0], alive[:0]
        if n_left < 0.75 * len(alive):
            at, words, queries, alive = at[left], words[left], queries[left], alive[left]
            counters = [c[left] for c in counters]
    left = alive != 0
    return at[left], alive[left]


def near_pairs(fingerprints: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), lo[i] <= j < hi[i], at most ``radius`` bits apart, in portions of bounded size."""
    planes = bit_planes(fingerprints)
    asking = np.flatnonzero(hi > lo)
    n_words = ((hi[asking] - 1) >> 6) - (lo[asking] >> 6) + 1
    ends = np.cumsum(n_words)
    total = int(ends[-1]) if len(ends) else 0
    for begin in range(0, total, _TASKS):
        task = np.arange(begin, min(begin + _TASKS, total))
        which = np.searchsorted(ends, task, side="right")
        i = asking[which]
        word = (lo[i] >> 6) + task - (ends[which] - n_words[which])
        asked = _low_ones(np.clip(hi[i] - word * 64, 0, 64)) & ~_low_ones(np.clip(lo[i] - word * 64, 0, 64))
        at, lanes = near_lanes(planes, fingerprints[i].astype(np.uint64), word, asked, radius)
        if len(at):
            hit, lane = np.nonzero(np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield i[at[hit]], word[at[hit]] * 64 + lane


def joined_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (of each element the smallest of its class) after joining the classes of each a[k] and b[k]."""
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        root = root.copy()
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            higher = root[root]
            if np.array_equal(higher, root):
                break
            root = higher
