"""Maximal runs of words that repeat with a period, found with suffix-tree extensions.

Every run contains a Lyndon root: a word sequence that is the longest Lyndon word from its first word on, in the order
of words or in its reverse. The longest Lyndon word at a place ends before the next smaller suffix. So each place gives
at most two candidates, and a candidate is extended in both directions: to the right by the common prefix of two
suffixes, to the left by that of two suffixes of the reversed sequence. Both come from Ukkonen's trees in constant time.

A run of at least ``MIN_LENGTH`` words with period q holds ``length - q`` >= MIN_LENGTH / 2 pairs of equal words q apart
in a row, so all its words lie in sequences of MIN_LENGTH / 2 words that occur again in the same text. Trees are only grown
over stretches of such words; all others cannot belong to a run. A worker's memory grows with the longest stretch of one
text, by about half a kilobyte a word."""
from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawmark.llm.common import free_name, give_back
from drawmark.llm.suffix_tree import SuffixTree

MIN_LENGTH = 12
RUN_COLUMNS = ("n_words", "runs", "collapsed")
FOUND = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_PASSES = 3


def runs_of(sequence: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of at least ``min_length`` and two periods, by start and period."""
    n = len(sequence)
    letters = (np.unique(sequence, return_inverse=True)[1] + 1).tolist()
    forth, back = SuffixTree(letters), SuffixTree(letters[::-1])
    start, period = _lyndon_roots(forth.rank[:n])
    right = forth.extensions(start, start + period)
    left = back.extensions(n - start, n - start - period)
    found = np.stack([start - left, left + period + right, period])
    found = found[:, found[1] >= np.maximum(min_length, 2 * period)]
    # the same stretch also has the multiples of its period that fit twice
    found = found[:, np.lexsort((found[2], found[1], found[0]))]
    new = np.ones(found.shape[1], dtype=bool)
    new[1:] = (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])
    return sorted(zip(*found[:, new].tolist()), key=lambda r: (r[0], r[2]))


def _lyndon_roots(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the longest Lyndon words of each place, in both orders, that another word follows."""
    n = len(rank)
    starts, lengths = [], []
    for values in (rank.tolist(), (-rank).tolist()):
        stack: list[int] = []
        for i in range(n - 1, -1, -1):
            here = values[i]
            while stack and values[stack[-1]] > here:
                stack.pop()
            if stack:
                starts.append(i)
                lengths.append(stack[-1] - i)
            stack.append(i)
    return np.asarray(starts, dtype=np.int64), np.asarray(lengths, dtype=np.int64)


def _stretches(codes: np.ndarray, group: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and stretch numbers of the words that may belong to a run; ``group`` numbers the texts."""
    half = min_length // 2
    place = np.arange(len(codes))
    odd = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    odd ^= odd >> np.uint64(29)
    for _ in range(_PASSES):
        m = len(place) - half + 1
        if m < 2:
            return place[:0], group[:0]
        key = np.zeros(m, dtype=np.uint64)
        for k in range(half):
            key = key * np.uint64(0xD1342543DE82EF95) + odd[place[k:m + k]]
        key ^= group[:m].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        whole = np.flatnonzero(group[:m] == group[half - 1:])
        order = whole[np.argsort(key[whole])]
        same = key[order[1:]] == key[order[:-1]]
        steps = np.zeros(len(place) + 1, dtype=np.int64)
        again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        steps[again] += 1
        steps[again + half] -= 1
        inside = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
        opens = np.ones(len(inside), dtype=bool)
        opens[1:] = (inside[1:] != inside[:-1] + 1) | (group[inside[1:]] != group[inside[:-1]])
        number = np.cumsum(opens) - 1
        long = np.bincount(number, minlength=1)[number] >= min_length if len(number) else number > 0
        place, group = place[inside[long]], number[long]
    return place, group


def text_runs(texts: list[str | None], min_length: int = MIN_LENGTH) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """For each text its number of words, runs, and its words outside repetitions joined by single spaces."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    before = np.concatenate([[0], np.cumsum(sizes)])
    every = np.empty(before[-1], dtype=object)
    every[:] = list(chain.from_iterable(words))
    codes = pd.factorize(every)[0]
    place, number = _stretches(codes, np.repeat(np.arange(len(words)), sizes), min_length)
    cuts = np.flatnonzero(np.diff(number)) + 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for at in np.split(place, cuts) if len(place) else ():
        text = int(np.searchsorted(before, at[0], side="right")) - 1
        shift = int(at[0] - before[text])
        runs[text] += [(shift + a, n, q) for a, n, q in runs_of(codes[at], min_length)]
    out = []
    for own, found in zip(words, runs):
        if found:
            steps = np.zeros(len(own) + 1, dtype=np.int64)
            for a, n, q in found:
                steps[a + q] += 1
                steps[a + n] -= 1
            kept = np.cumsum(steps[:-1]) == 0
            collapsed = b" ".join([w for w, k in zip(own, kept.tolist()) if k])
        else:
            collapsed = b" ".join(own)
        out.append((len(own), found, collapsed.decode("utf-8", "surrogatepass")))
    return out


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period in words, by start and period) and collapsed (the words left
    without those that repeat a run's first period, joined by single spaces); columns of these names are replaced.

    Words are what stands between ASCII white space. A run has at least ``min_length`` words (an even number) and two periods,
    its period is the smallest, and no neighbouring word extends it. Null and empty texts have no words, no runs and
    an empty ``collapsed``. Repeated rows each give a row; ties do not arise, as all runs are given. An empty table
    gives none. A very long text is read whole, in one task."""
    if min_length < 4 or min_length % 2:
        raise ValueError("min_length must be even and at least 4")

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        out = [(n, [{"start": a, "length": m, "period": q} for a, m, q in runs], collapsed)
               for n, runs, collapsed in text_runs(texts.tolist(), min_length)]
        give_back()
        return pd.DataFrame(out, columns=list(RUN_COLUMNS))

    plain = docs.drop(*[c for c in docs.columns if c.lower() in RUN_COLUMNS and c != text_col])
    name = free_name("_runs", plain.columns)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return plain.withColumn(name, found(text)).select(*[f"`{c}`" for c in plain.columns], f"{name}.*")
