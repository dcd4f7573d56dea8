"""Layout arithmetic, trees and proofs against plain recursion."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawmark.llm.merkle import folded, manifest_proofs, proof_digest, row_digest
from drawmark.llm.veb_blocks import addresses, built, n_nodes, siblings

SCHEMA = "source string, id bigint, digest string, note string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def laid_out(levels, arity):
    """(depth, index) of each slot, by the definition of the layout."""
    if levels == 1:
        return [(0, 0)]
    upper = levels // 2
    out = laid_out(upper, arity)
    for k in range(arity ** upper):
        out += [(d + upper, k * arity ** d + i) for d, i in laid_out(levels - upper, arity)]
    return out


@pytest.mark.parametrize("arity", [2, 3, 4])
@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 6])
def test_layout(levels, arity):
    slots = laid_out(levels, arity)
    assert len(slots) == n_nodes(levels, arity)
    for depth in range(levels):
        got = addresses(levels, depth, np.arange(arity ** depth), arity)
        assert [slots[s] for s in got] == [(depth, i) for i in range(arity ** depth)]


def grown(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([H(*low[k:k + arity]) for k in range(0, len(low), arity)])
    return levels


def proof(levels, i, arity):
    out = []
    for low in levels[:-1]:
        a = i // arity * arity
        out.append(("".join(low[a:i]), "".join(low[i + 1:a + arity])))
        i //= arity
    return out


def test_blocks():
    for arity, height, n in [(3, 0, 1), (3, 3, 1), (3, 3, 27), (3, 3, 14), (2, 5, 19), (3, 2, 4)]:
        leaves = [H(str(k)) for k in range(n)]
        nodes = built([bytes.fromhex(x) for x in leaves], height, arity)
        levels = grown(leaves, arity)
        while len(levels) <= height:
            levels.append([H(*levels[-1])])
        assert nodes[:32].hex() == levels[height][0]
        steps = siblings(nodes, n, height, arity)
        for i in range(n):
            assert [steps[k][i // arity ** k] for k in range(height)] == proof(levels, i, arity)


@pytest.mark.parametrize("arity, height", [(3, 2), (2, 3), (3, 6)])
def test_manifest(spark, arity, height):
    random.seed(height)
    sizes = {"hot": 130, None: 7, "": 1, "a": 2, "é": 3, "b": 10, "+": 1, "-": 4, **{f"s{k}": 1 for k in range(12)}}
    rows = [(s, k, H(str(s), str(k)), f"note {k}") for s, n in sizes.items() for k in range(n)]
    rows += [("hot", None, H("none"), None), ("hot", 5, H("again"), None), ("a", 1, H("a", "1"), "note 1"), ("a", 1, H("a", "1"), "note 1")]
    random.shuffle(rows)
    leaves = spark.createDataFrame(rows, SCHEMA).select("source", "id", "digest", F.struct("note").alias("row"))
    trees = {}
    for s, i, d, note in rows:
        trees.setdefault(s, []).append((i is not None, i, d, note))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown_trees = {s: grown([x[2] for x in sorted(trees[s], key=lambda x: (x[0], x[1] or 0, x[2]))], arity) for s in order}
    top = grown([grown_trees[s][-1][0] for s in order], arity)
    want = Counter()
    for at, s in enumerate(order):
        for i, (_, k, d, note) in enumerate(sorted(trees[s], key=lambda x: (x[0], x[1] or 0, x[2]))):
            steps = proof(grown_trees[s], i, arity) + proof(top, at, arity)
            want[s, k, d, note, grown_trees[s][-1][0], top[-1][0], tuple(steps)] += 1
    out = manifest_proofs(leaves, arity, height)
    assert out.columns == ["source", "id", "digest", "row", "subroot", "root", "proof"]
    found = out.withColumn("fold", folded(F.col("digest"), F.col("proof"))).withColumn("sum", proof_digest(F.col("proof"))).collect()
    assert Counter((r["source"], r["id"], r["digest"], r["row"]["note"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in found) == want
    assert all(r["fold"] == r["root"] and r["sum"] == H(*[a + b for a, b in r["proof"]]) for r in found)


def test_single_row_and_empty_table(spark):
    one = spark.createDataFrame([("s", 1, H("x"), "n")], SCHEMA).select("source", "id", "digest", F.struct("note").alias("row"))
    row = manifest_proofs(one).first()
    assert (row["subroot"], row["root"], row["proof"]) == (H("x"), H("x"), [])
    assert manifest_proofs(one.limit(0)).collect() == []


def test_row_digest(spark):
    rows = [(1, "é\n", None), (None, "", -5), (2, "x" * 300_000, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a bigint, b string, c int").select(row_digest(*map(F.col, "abc"))).collect()]
    assert got == [H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r]) for r in rows]
