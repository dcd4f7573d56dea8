"""Hash trees of a bounded height in van Emde Boas layout.

A tree of ``levels`` levels is split at half height: the upper half is stored first, then the lower subtrees from left to
right, each laid out in the same way. Neighbours on a path then share cache lines and pages at every block size, and a
node's place follows from its depth and number alone. Slots of nodes that a block with few leaves lacks stay unused."""
from __future__ import annotations

from hashlib import sha256

import numpy as np

DIGEST = 32


def n_nodes(levels: int, arity: int) -> int:
    return (arity ** levels - 1) // (arity - 1)


def addresses(levels: int, depth: int, index: np.ndarray, arity: int) -> np.ndarray:
    """Slots of the nodes ``index`` (numbered from the left) at ``depth`` below the root."""
    base = np.zeros(len(index), dtype=np.int64)
    index = np.asarray(index, dtype=np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth -= upper
        width = arity ** depth  # nodes of this depth in one lower subtree
        lower = levels - upper
        base += n_nodes(upper, arity) + index // width * n_nodes(lower, arity)
        index, levels = index % width, lower
    return base


def joined_hash(digests: list[bytes]) -> bytes:
    """The digest of digests, which are put one after the other as hexadecimal text."""
    return sha256(b"".join(digests).hex().encode()).digest()


def level_sizes(n: int, height: int, arity: int) -> list[int]:
    """Nodes at each level, leaves first."""
    sizes = [n]
    for _ in range(height):
        sizes.append(-(-sizes[-1] // arity))
    return sizes


def built(leaves: list[bytes], height: int, arity: int) -> bytes:
    """All nodes above and with ``leaves``, in the layout. The root is at slot 0."""
    slots = np.zeros((n_nodes(height + 1, arity), DIGEST), dtype=np.uint8)
    here = leaves
    for level in range(height + 1):
        if level:
            here = [joined_hash(here[k:k + arity]) for k in range(0, len(here), arity)]
        slots[addresses(height + 1, height - level, np.arange(len(here)), arity)] = np.frombuffer(b"".join(here), dtype=np.uint8).reshape(-1, DIGEST)
    return slots.tobytes()


def siblings(nodes: bytes, n: int, height: int, arity: int) -> list[list[tuple[str, str]]]:
    """For each level below the root and each node there: the digests of its run to its left, and to its right."""
    slots = np.frombuffer(nodes, dtype=np.uint8).reshape(-1, DIGEST)
    out = []
    for level, size in enumerate(level_sizes(n, height, arity)[:height]):
        index = np.arange(size)
        text = slots[addresses(height + 1, height - level, index, arity)].tobytes().hex()
        wide = 2 * DIGEST
        first = index // arity * arity
        last = np.minimum(first + arity, size)
        out.append([(text[wide * a:wide * i], text[wide * (i + 1):wide * b]) for i, a, b in zip(index.tolist(), first.tolist(), last.tolist())])
    return out
