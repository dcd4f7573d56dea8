"""Near copies against the Jaccard similarity of all pairs."""
import random

import pytest

import corpus_pipeline
from drawmark.llm import near_copies as op

SCHEMA = "doc_id bigint, text string"


def plain_set(text, words=5):
    tokens = (text or "").lower().split()
    width = min(words, len(tokens))
    return {tuple(tokens[i:i + width]) for i in range(len(tokens) - width + 1)} if tokens else set()


def plain_similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def plain_components(texts):
    label = {i: i for i in texts}
    sets = {i: plain_set(t) for i, t in texts.items()}
    for a in sorted(texts):
        for b in sorted(texts):
            if b < a and plain_similar(sets[a], sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label


def edited():
    """Documents with changed words: some copies stay above 0.8, some fall below; chains and a hub of many copies."""
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(40):
        words = random.choices(vocabulary, k=random.choice([7, 60, 150, 400]))
        for _ in range(60 if k == 5 else random.randint(1, 4)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(random.randint(0, 1 + len(words) // 45)):
                words[random.randrange(len(words))] = random.choice(vocabulary)
    random.shuffle(texts)
    return dict(enumerate(texts + ["", None, " \n", "One two", "one  TWO", "three"]))


@pytest.mark.parametrize("block", [op.BLOCK, 2000])
def test_against_all_pairs(spark, block):
    texts = edited()
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    want = plain_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in op.near_copies(docs, block=block).collect()}
    assert got == want and 40 < len(set(want.values())) < len(texts) - 60


def test_stage_drops_edited_copies_and_keeps_others(spark):
    """Copies with changed words lie beyond 4 bits of SimHash; half-alike documents are clean."""
    random.seed(2)
    word = lambda: f"w{random.randrange(5000)}"
    rows = []
    for k in range(30):
        words = [word() for _ in range(200)]
        copy, half = list(words), words[:120] + [word() for _ in range(80)]
        for at in (30, 110, 170):
            copy[at] = "changed"
        rows += [(k, " ".join(words)), (100 + k, " ".join(copy)), (200 + k, " ".join(half))]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert left == {*range(30), *range(200, 230)}


def test_fingerprints_decide_which_sets_of_a_key_are_compared(spark):
    """Sets of one key are linked loosely if their fingerprints are near each other, and so are sets of one fingerprint."""
    near, far = (1 << op.RADIUS) - 1, (1 << op.RADIUS + 1) - 1
    rows = [(1, 0, [7]), (2, near, [7]), (3, -1, [7, 8]), (4, ~far, [8]), (5, 1 << 62, [9]), (6, 1 << 62, [10])]
    distinct = spark.createDataFrame([(*r, r[0]) for r in rows], "fp bigint, sim bigint, bands array<bigint>, first_id bigint")
    links = {frozenset(r) for r in op.loose_links(distinct.filter("fp < 5")).collect()}
    assert links == {frozenset((0, near))}
    found = {}
    for r in op.loose_members(distinct).collect():
        found.setdefault(r["label"], set()).add(r["fp"])
    assert sorted(map(sorted, found.values())) == [[1, 2], [5, 6]]


def test_similar_sets_are_within_the_radius():
    texts = list(edited().values())
    sets = [op.shingles(t) for t in texts]
    sims = [op.hashes_fingerprint(s) & (1 << 64) - 1 for s in sets]
    plain = [plain_set(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if plain[a] and plain[a] != plain[b] and plain_similar(plain[a], plain[b])]
    apart = [(sims[a] ^ sims[b]).bit_count() for a, b in pairs]
    assert len(pairs) > 100 and 0 < max(apart) <= op.RADIUS - 6


def test_ids_that_are_null_or_repeated(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(3, long), (3, long), (None, long + " x"), (2, long + " y"), (None, "else"), (4, long + " z"), (4, "other words")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in op.near_copies(docs).collect()), key=str)
    assert got == sorted([(3, 2), (3, 2), (None, 2), (2, 2), (None, None), (4, 2), (4, 4)], key=str)
    assert sorted(str(r["doc_id"]) for r in op.without_near_copies(docs).collect()) == ["2", "4", "4", "None", "None"]
    assert op.near_copies(docs.limit(0)).collect() == []
