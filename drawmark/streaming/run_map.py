"""Runs of equal facts along a path's observations, kept as a map that takes observations in any order.

The map lists disjoint runs in time order; neighbouring runs have different facts. A new observation extends a run at one
of its ends, falls inside one of equal facts, splits one of other facts in two, or stands between two runs; runs of equal
facts that meet become one. Only runs that new observations fall into or beside are looked at again."""
from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

import numpy as np

NONE = np.iinfo(np.int64).min  # stands for null


class Run(NamedTuple):
    """Observations (times and numbers, ascending) with one size and modification time; no size: the file was gone."""
    size: int
    mtime: int
    times: np.ndarray
    numbers: np.ndarray

    def stable_at(self, wait: int) -> int | None:
        """The first later observation that is ``wait`` or more after the first one."""
        k = max(int(np.searchsorted(self.times, self.times[0] + wait)), 1)
        return int(self.times[k]) if self.size != NONE and k < len(self.times) else None


class Observations(NamedTuple):
    """Columns of new observations, null as ``NONE``."""
    times: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray
    mtimes: np.ndarray

    def taken(self, which) -> Observations:
        return Observations(*(c[which] for c in self))


def _runs_of(seen: Observations) -> list[Run]:
    """The runs of observations, which may come unordered and repeated."""
    order = np.lexsort((seen.mtimes, seen.sizes, seen.numbers, seen.times))
    seen = seen.taken(order)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in seen], axis=0)
    seen = seen.taken(new)
    cuts = np.flatnonzero((seen.sizes[1:] != seen.sizes[:-1]) | (seen.mtimes[1:] != seen.mtimes[:-1])) + 1
    edges = [0, *cuts.tolist(), len(seen.times)]
    return [Run(int(seen.sizes[a]), int(seen.mtimes[a]), seen.times[a:b], seen.numbers[a:b]) for a, b in zip(edges, edges[1:])]


def _with_runs(runs: list[Run], seen: Observations) -> Observations:
    sizes = [np.full(len(r.times), r.size) for r in runs]
    mtimes = [np.full(len(r.times), r.mtime) for r in runs]
    return Observations(*(np.concatenate([*old, new]) for old, new in zip(
        ([r.times for r in runs], [r.numbers for r in runs], sizes, mtimes), seen)))


def merged(runs: list[Run], seen: Observations) -> tuple[list[Run], list[Run], list[Run]]:
    """The map after more observations, with the runs that went and the runs that came in their place."""
    order = np.lexsort((seen.numbers, seen.times))
    seen = seen.taken(order)
    firsts = [(int(r.times[0]), int(r.numbers[0])) for r in runs]
    places = [bisect_right(firsts, p) - 1 for p in zip(seen.times.tolist(), seen.numbers.tolist())]
    touched = {k for p in places for k in (p, p + 1) if 0 <= k < len(runs)}
    out: list[Run] = []
    went: list[Run] = []
    came: list[Run] = []
    place, k = np.asarray(places), 0
    while k < len(runs) or not runs:
        if runs and k not in touched:
            out.append(runs[k])
            k += 1
            continue
        end = k
        while end in touched:
            end += 1
        # observations before the first run count for it
        mine = (place >= (k if k else -1)) & (place < max(end, 1))
        fresh = _runs_of(_with_runs(runs[k:end], seen.taken(mine)))
        out += fresh
        went += runs[k:end]
        came += fresh
        k = end
        if not runs:
            break
    return out, went, came


def compacted(runs: list[Run], wait: int, late: int) -> list[Run]:
    """The map without what observations up to ``late`` before its latest one cannot change: of earlier times, the last
    run with its first, its stable and its last observation."""
    horizon = int(runs[-1].times[-1]) - late
    first = max(bisect_right([int(r.times[0]) for r in runs], horizon) - 1, 0)
    kept = []
    for r in runs[first:]:
        keep = r.times >= horizon
        keep[[0, -1]] = True
        keep[np.searchsorted(r.times, r.times[0] + wait).clip(1 if len(r.times) > 1 else 0, len(r.times) - 1)] = True
        kept.append(r._replace(times=r.times[keep], numbers=r.numbers[keep]))
    return kept


def packed(runs: list[Run]) -> tuple[list[int], list[int], list[int], bytes, bytes]:
    """Sizes, modification times, numbers of observations, and all times and observation numbers as bytes."""
    return ([r.size for r in runs], [r.mtime for r in runs], [len(r.times) for r in runs],
            b"".join(r.times.tobytes() for r in runs), b"".join(r.numbers.tobytes() for r in runs))


def unpacked(sizes: list[int], mtimes: list[int], counts: list[int], times: bytes, numbers: bytes) -> list[Run]:
    cuts = np.cumsum(counts)[:-1]
    parts = (np.split(np.frombuffer(b, dtype=np.int64), cuts) for b in (times, numbers))
    return [Run(int(s), int(m), t, n) for s, m, t, n in zip(sizes, mtimes, *parts)]
