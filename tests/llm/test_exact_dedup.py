"""Groups, marks and survivors against plain grouping."""
import hashlib
import random
from collections import Counter

import pytest

from drawmark.llm.exact_dedup import deduplicated, marked_duplicates

SCHEMA = "doc_id bigint, text string, n_bytes int, _sha string, keep_id string"


def texts():
    random.seed(1)
    long = "x" * 200
    pool = ["", " ", "a", "b", "ab", "é", "e\u0301", long, long + "1", long + "2", "y" + long, "A", "a ", "line\n", "z" * 100_000]
    return [(i, random.choice(pool + [None]), 1, "s", "k") for i in range(120)] + [(i, f"unique {i}", 1, "s", "k") for i in range(500, 540)]


def rows():
    return texts() + [(None, "a", 0, "", ""), (None, "nowhere else", 0, "", ""), (None, "nowhere else", 0, "", ""), (900, "b", 1, "", ""), (900, "b", 1, "", ""),
                      (901, "twice", 1, "", ""), (901, "twice", 1, "", "")]


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_against_grouping(spark, bits):
    df = spark.createDataFrame(rows(), SCHEMA)
    groups = {}
    for r in rows():
        groups.setdefault(r[1] or "", []).append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, seen = hashlib.sha256(text.encode()).hexdigest(), False
        for i in ids:
            kept = i == keep and not seen
            seen |= i == keep
            want[i, keep, len(ids), kept, sha] += 1
    marked = marked_duplicates(df, filter_bits=bits)
    assert marked.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in marked.collect()) == want
    left = deduplicated(df, filter_bits=bits)
    assert left.columns == df.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in left.collect()) == Counter(
        (max((i for i in ids if i is not None), default=None), t) for t, ids in groups.items())


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert marked_duplicates(empty).collect() == [] and deduplicated(empty).collect() == []
