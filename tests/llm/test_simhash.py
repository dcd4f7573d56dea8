"""Fingerprints, links and components against plain Python over all pairs."""
import random

import numpy as np
import pytest
import xxhash

from drawmark.llm import simhash as op
from drawmark.llm.bitslice import near_pairs
from drawmark.llm.components import component_labels

SCHEMA = "doc_id bigint, text string"


def plain_fingerprint(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not tokens:
        return 0
    width = min(words, len(tokens))
    hashes = [xxhash.xxh64(" ".join(tokens[i:i + width]).encode(), seed=42).intdigest() for i in range(len(tokens) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    """fps: {id: fingerprint}"""
    label = {i: i for i in fps}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def clusters(n, seed):
    """Fingerprints in chains and clumps, so that links reach far."""
    random.seed(seed)
    out = []
    while len(out) < n:
        x = random.getrandbits(64)
        for _ in range(random.choice([1, 1, 2, 5, 30])):
            out.append(x)
            for _ in range(random.randint(0, 5)):
                x ^= 1 << random.randrange(64)
    return out[:n]


def test_near_pairs_is_every_pair():
    for radius in (1, 2, 3, 4, 7):
        fps = np.array(clusters(300, radius), dtype=np.uint64)
        n = len(fps)
        lo, hi = np.arange(n) + 1, np.full(n, n)
        hi[n // 3: n // 2] = n // 2
        got = sorted((int(a), int(b)) for i, j in near_pairs(fps, lo, hi, radius) for a, b in zip(i, j))
        want = [(i, j) for i in range(n) for j in range(i + 1, int(hi[i])) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius]
        assert got == want


@pytest.mark.parametrize("block", [4096, 8])
def test_links_connect_like_all_pairs(spark, block):
    fps = dict(enumerate(dict.fromkeys(clusters(500, 11))))
    signed = {i: f - (1 << 64) if f >= 1 << 63 else f for i, f in fps.items()}
    df = spark.createDataFrame([(f,) for f in signed.values()], "fp bigint")
    labels = component_labels(op.fingerprint_links(df, len(fps), block=block))
    got = {r["node"]: r["label"] for r in labels.collect()}
    by_fp = {f: i for i, f in signed.items()}
    want = plain_components(fps)
    groups = {}
    for i, f in signed.items():
        groups.setdefault(got.get(f, f), set()).add(i)
    plain = {}
    for i, c in want.items():
        plain.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values())) and by_fp


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in component_labels(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}


def test_texts(spark):
    long = " ".join(f"Wort{i % 977}" for i in range(70_000))
    rows = [(5, "one two three four five six"), (3, "One  two\tthree four five six"), (9, None), (8, ""), (2, "  \n"), (1, "Ünder ÄB"), (4, "x"), (4, "x"),
            (None, "x"), (None, "quite another text of its own"), (7, long), (6, long + " end")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA + ", fp int, component_id int")
    got = op.near_duplicates(df).collect()
    fps = {}
    for i, t in rows:
        fps.setdefault(i, []).append(plain_fingerprint(t))
    for r in got:
        assert r["fp"] % (1 << 64) in fps[r["doc_id"]]
    component = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    assert len(got) == len(rows)
    by_id = {i: c for (i, _), c in component.items() if i is not None}
    assert by_id == {5: 3, 3: 3, 9: 2, 8: 2, 2: 2, 1: 1, 4: 4, 7: 6, 6: 6}
    assert sorted(str(c) for (i, _), c in component.items() if i is None) == ["4", "None"]
    kept = op.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "4", "6", "None", "None"]


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert op.near_duplicates(empty).collect() == [] and op.without_near_duplicates(empty).collect() == []


def test_random_documents(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        words = random.choices(vocabulary, k=random.randint(3, 400))
        for _ in range(random.randint(1, 4)):
            texts.append(" ".join(words))
            words = list(words)
            words[random.randrange(len(words))] = "changed"
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in op.near_duplicates(df).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(fps)
    assert got == {i: (fps[i], want[i]) for i in fps}
