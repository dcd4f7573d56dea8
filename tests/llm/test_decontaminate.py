"""Hits against a plain search for windows."""
import random

import pytest

from drawmark.llm.decontaminate import benchmark_hits, decontaminated

SCHEMA = "doc_id bigint, text string, spans string, N_HIT int, _hits int"


def words(text):
    out, at = [], None
    for i, c in enumerate((text or "") + " "):
        inside = "a" <= c <= "z" or "A" <= c <= "Z" or "0" <= c <= "9" or ord(c) >= 128
        if inside and at is None:
            at = i
        if not inside and at is not None:
            out.append((at, i, "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text[at:i])))
            at = None
    return out


def plain(text, items, size=10):
    own = words(text)
    low, hit, found = [w for *_, w in own], [False] * len(own), set()
    for i, t in items:
        item = [w for *_, w in words(t)]
        n = min(size, len(item))
        for k in range(len(item) - n + 1) if n else ():
            for a in range(len(low) - n + 1):
                if low[a:a + n] == item[k:k + n]:
                    hit[a:a + n] = [True] * n
                    if i is not None:
                        found.add(i)
    spans, k = [], 0
    while k < len(hit):
        if hit[k]:
            begin = k
            while k < len(hit) and hit[k]:
                k += 1
            spans.append((own[begin][0], own[k - 1][1]))
        k += 1
    return len(own), sum(hit), sorted(found), spans


@pytest.mark.parametrize("part_bytes", [4 << 20, 3000])
def test_against_plain_search(spark, part_bytes):
    random.seed(6)
    vocabulary = ["a", "b", "Cc", "d1", "été", "日本", "x"]
    passage = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(k, passage(random.choice([12, 15, 30]))) for k in range(12)]
    items += [(20, "lone-word? yes"), (21, ""), (22, None), (None, passage(11)), (23, items[0][1]), (24, "..."), (25, items[1][1]), (25, items[1][1]), (26, "Unfound")]
    texts = [passage(200) for _ in range(10)] + [items[k][1].upper().replace(" ", random.choice([" ", "\n--", "\u00a0x "])) for k in range(12)]
    texts += [f"Before, {items[2][1]}! {items[2][1]} after", None, "", "!!", "LONE  word; Yes... lone word", items[-6][1] or "", "lone wordy yes", passage(60_000)]
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in enumerate(texts)] + [(0, texts[0], "s", 1, 2)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = benchmark_hits(docs, bench, part_bytes=part_bytes)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_hits", "n_words", "n_hit", "items", "spans"])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in out.collect()}
    cheap = {i: plain(t, items) for i, t in enumerate(texts[:-1])}
    assert {i: got[i] for i in cheap} == cheap
    left = decontaminated(docs, bench, part_bytes=part_bytes)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted([i for i, g in got.items() if not g[1]] + [0] * (not got[0][1]))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two", "", 0, 0)], SCHEMA)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in benchmark_hits(docs, none).collect()] == [(2, 0, [])]
    assert benchmark_hits(docs.limit(0), none).collect() == [] and decontaminated(docs, none).count() == 1
