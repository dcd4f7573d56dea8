"""Suffix trees, runs and collapsed texts against plain searches."""
import random

import numpy as np
import pytest

from drawmark.llm.periodic_runs import periodic_runs, text_runs
from drawmark.llm.suffix_tree import SuffixTree

SCHEMA = "doc_id bigint, text string, RUNS int, _runs string, n_words string"


def common(w, a, b):
    k = 0
    while max(a, b) + k < len(w) and w[a + k] == w[b + k]:
        k += 1
    return k


def plain_runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        equal = [a == b for a, b in zip(w, w[q:])] + [False]
        begin = None
        for i, same in enumerate(equal):
            if same and begin is None:
                begin = i
            if not same and begin is not None:
                if i - begin + q >= max(least, 2 * q):
                    found.setdefault((begin, i - begin + q), q)
                begin = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_extensions_and_order_of_suffixes():
    random.seed(3)
    for size in [1, 2, 15, 16, 17, 40, 90]:
        for letters in (1, 2, 4):
            w = [random.randint(1, letters) for _ in range(size)]
            tree = SuffixTree(w)
            pairs = [(a, b) for a in range(size + 1) for b in range(size + 1) if a != b]
            got = tree.extensions(*map(np.array, zip(*pairs)))
            assert got.tolist() == [common(w, a, b) for a, b in pairs]
            assert np.argsort(tree.rank).tolist() == sorted(range(size + 1), key=lambda a: w[a:])


@pytest.mark.parametrize("least", [4, 6, 12])
def test_random_sequences(least):
    random.seed(4)
    texts = []
    for _ in range(400):
        n, k = random.randint(0, 70), random.choice([1, 2, 3, 6])
        w = [str(random.randint(1, k)) for _ in range(n)]
        if n > 5 and random.random() < 0.6:
            a, p = random.randrange(n), random.randint(1, n // 2)
            w = [x if i < a else w[min(n - 1, a + (i - a) % p)] for i, x in enumerate(w)]
        texts.append(w)
    for w, (n, runs, collapsed) in zip(texts, text_runs([" ".join(w) for w in texts], least)):
        assert (n, runs) == (len(w), plain_runs(w, least)) and collapsed == plain_collapsed(w, runs)


def test_rows_and_columns(spark):
    line = "the same line again\n"
    texts = [None, "", " \t\n", "one", "a " * 11, "a " * 12, line * 2, line * 3, "Ünï x \x0by " * 9, "b c " * 6 + "x" + " b c" * 6,
             " ".join(str(i % 997) for i in range(30_000)), "z " * 20_000]
    rows = [(i, t, 1, "r", "n") for i, t in enumerate(texts)] + [(3, "one", 1, "r", "n"), (None, "a " * 12, 1, "r", "n")]
    out = periodic_runs(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "_runs", "n_words", "runs", "collapsed"]
    found = out.collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["_runs"]) for r in found))) == sorted(map(repr, ((r[0], r[1], r[3]) for r in rows)))
    for r in found:
        w = [b.decode() for b in (r["text"] or "").encode().split()]
        runs = [tuple(x) for x in r["runs"]]
        if len(w) < 1000:
            assert runs == plain_runs(w, 12)
        assert r["n_words"] == len(w) and r["collapsed"] == plain_collapsed(w, runs)
    by_id = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in found}
    assert by_id[10] == [(0, 30_000, 997)] and by_id[11] == [(0, 20_000, 1)] and by_id[7] == [(0, 12, 4)] and by_id[4] == []


def test_empty_table(spark):
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
