"""Suffix trees of integer sequences (Ukkonen) and longest common extensions in constant time.

The tree is toured once; the string depths along the tour form an Euler tour, in which the least depth between two
leaves is the depth of their lowest common ancestor, that is the length of the two suffixes' common prefix. Range
minima take blocks of ``BLOCK`` entries: minima from a block's ends, and a sparse table over whole blocks."""
from __future__ import annotations

import numpy as np

BLOCK = 16


class SuffixTree:
    """Suffix tree of ``sequence`` (integers above zero). ``rank`` orders the suffixes, the empty one first."""

    def __init__(self, sequence: list[int]):
        self.size = len(sequence)
        text = [*sequence, 0]  # a smallest letter that occurs once: each suffix ends in a leaf of its own
        first, stop, kids, leaves = _grown(text)
        tour, self._place, order = _toured(text, first, stop, kids, leaves)
        self.rank = np.empty(len(text), dtype=np.int64)
        self.rank[order] = np.arange(len(text))
        self._minima(np.asarray(tour, dtype=np.int32))

    def _minima(self, tour: np.ndarray) -> None:
        n_blocks = -(-len(tour) // BLOCK)
        padded = np.full(n_blocks * BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        padded[:len(tour)] = tour
        blocks = padded.reshape(n_blocks, BLOCK)
        self._from_left = np.minimum.accumulate(blocks, axis=1).ravel()
        self._to_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self._tour, self._table = padded, [blocks.min(axis=1)]
        width = 1
        while 2 * width <= n_blocks:
            low = self._table[-1]
            self._table.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def extensions(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at ``i`` and ``j``, elementwise different places up to ``size``."""
        a, b = self._place[i], self._place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        left, right = a // BLOCK, b // BLOCK
        found = np.minimum(self._to_right[a], self._from_left[b])
        span = right - left - 1
        for level in range(len(self._table)):
            at = np.flatnonzero((span >= 1 << level) & (span < 2 << level))
            if len(at):
                row = self._table[level]
                found[at] = np.minimum(found[at], np.minimum(row[left[at] + 1], row[right[at] - (1 << level)]))
        inside = np.flatnonzero(left == right)
        if len(inside):
            low = self._tour[a[inside]]
            for step in range(1, BLOCK):
                low = np.minimum(low, self._tour[np.minimum(a[inside] + step, b[inside])])
            found[inside] = low
        return found.astype(np.int64)


def _grown(text: list[int]) -> tuple[list[int], list[int], list[dict | None], list[int]]:
    """Edges (first and one past the last letter), children and leaves (in the order of their suffixes) of the tree."""
    n = len(text)
    first, stop, link, leaves = [0], [0], [0], []
    kids: list[dict | None] = [{}]
    node = edge = length = pending = 0
    for i, letter in enumerate(text):
        pending += 1
        fresh = 0  # an inner node of this round that has no suffix link yet
        while pending:
            if not length:
                edge = i
            at = text[edge]
            child = kids[node].get(at)
            if child is None:
                kids[node][at] = len(first)
                leaves.append(len(first))
                first.append(i)
                stop.append(n)
                link.append(0)
                kids.append(None)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                begin, end = first[child], stop[child]
                span = (end if end <= i else i + 1) - begin
                if length >= span:
                    node = child
                    edge += span
                    length -= span
                    continue
                turn = text[begin + length]
                if turn == letter:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                inner = len(first)
                kids[node][at] = inner
                leaves.append(inner + 1)
                first += (begin, i)
                stop += (begin + length, n)
                link += (0, 0)
                kids += ({letter: inner + 1, turn: child}, None)
                first[child] = begin + length
                if fresh:
                    link[fresh] = inner
                fresh = inner
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return first, stop, kids, leaves


def _toured(text, first, stop, kids, leaves) -> tuple[list[int], np.ndarray, list[int]]:
    """String depths along the Euler tour, each suffix's place in it, and the suffixes in their order."""
    suffix = dict(zip(leaves, range(len(leaves))))
    place = np.empty(len(text), dtype=np.int64)
    tour, order, stack, depths = [], [], [0], [0] * len(first)
    while stack:
        node = stack.pop()
        if node < 0:  # back at a node of this depth
            tour.append(-node - 1)
            continue
        depth = depths[node]
        below = kids[node]
        if below is None:
            place[suffix[node]] = len(tour)
            order.append(suffix[node])
        else:
            for letter in sorted(below, reverse=True):
                child = below[letter]
                depths[child] = depth + stop[child] - first[child]
                stack += (-depth - 1, child)
        tour.append(depth)
    return tour, place, order
