"""Token counts and token files against the library and against plain decoding."""
import heapq
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from drawmark.llm import huffman, token_cache
from drawmark.llm.common import scratch_path
from drawmark.llm.encode import PieceEncoder

P = pytest.importorskip("public_tokenizers")
BPE = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, n_tokens int, START string"
TEXTS = ["Hello world", "  two  spaces\n\n\tand tabs ", "it's I'll we'd 'S", "Ünïcödé é à", "日本語テキスト 123", "<|endoftext|> inside <|endoftext|>", "a b c\x1cd\x85e",
         "​ zero", "x" * 5000, "½ ² ª º · £ ¿que? ¡si!", "emoji 🙂🙂 ok", "", None, " ", "\n", "tail \r\n  \n", "a" + " " * 300 + "b", "Ωmega Жук", "1234567 8 90"]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_library_ids(name):
    ours, theirs = PieceEncoder(P.path(name)), library(P.path(name))
    random.seed(1)
    mixed = ["".join(random.choices("ab '\n\tséß1.,~-<|>endoftext ²ªĀ", k=60)) for _ in range(300)]
    for _ in range(2):
        for t in TEXTS + mixed:
            assert np.frombuffer(ours.encode(t), dtype="<u4").tolist() == theirs(t)


def test_pieces_ask_the_model_alone():
    """A new piece takes neither the library's way to its model nor the model's own memo."""
    ours, theirs = PieceEncoder(BPE), library(BPE)
    text = "the quick brown fox jumps 12 times, isn't it"
    ours.library = None
    assert np.frombuffer(ours.encode(text), dtype="<u4").tolist() == theirs(text)


def rows():
    texts = TEXTS + TEXTS[:3] + ["Wort " * 1100]
    return [(i * 7 % 97, t, i, "s") for i, t in enumerate(texts)] + [(None, "no id", None, None), (3000, "twice", 1, ""), (3000, "twice", 1, "")]


def test_counts_and_cache(spark, monkeypatch):
    cache, theirs = scratch_path(spark, "cache-test"), library(BPE)
    docs = spark.createDataFrame(rows(), SCHEMA)
    want = Counter((i, len((t or "").encode()), len(theirs(t)), len(theirs(t)) > 1024) for i, t, *_ in rows())
    out = token_cache.token_counts(docs, BPE, cache)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect()) == want
    assert sorted(out.columns) == sorted(["doc_id", "text", "START", "n_bytes", "n_tokens", "over_limit"])
    # nothing left to encode; one new text is one miss, however often it occurs
    assert token_cache.fill_cache(docs, BPE, cache) == 0
    more = docs.unionByName(spark.createDataFrame([(1, "brand new", 0, ""), (2, "brand new", 0, "")], SCHEMA))
    assert token_cache.fill_cache(more, BPE, cache) == 1
    assert token_cache.fill_cache(docs.limit(0), BPE, cache) == 0
    assert token_cache.token_counts(docs.limit(0), BPE, cache).collect() == []
    # counts of another version do not count
    monkeypatch.setattr(token_cache, "tokenizer_version", lambda path: "other")
    assert token_cache.fill_cache(docs, BPE, cache) == len({t or "" for _, t, *_ in rows()})


def plain_cost(counts, limit=None):
    """Bits of an unlimited Huffman code."""
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


def best_limited(counts, limit):
    """Cheapest lengths with Kraft sum one, by trying all non-increasing length vectors."""
    counts = sorted([c for c in counts if c], reverse=True)
    best = [None]

    def go(k, least, room, cost):
        if k == len(counts):
            if best[0] is None or cost < best[0]:
                best[0] = cost
            return
        for n in range(least, limit + 1):
            need = 2 ** (limit - n)
            if need * 1 + (len(counts) - k - 1) <= room:
                go(k + 1, n, room - need, cost + n * counts[k])
    go(0, 1, 2 ** limit, 0)
    return best[0]


def test_code_lengths():
    random.seed(5)
    for _ in range(60):
        counts = np.array([random.choice([0, 1, 2, 5, 40, 900]) for _ in range(random.randint(2, 8))])
        if (counts > 0).sum() < 2:
            continue
        lengths = huffman.code_lengths(counts, 4).astype(int)
        assert (lengths[counts > 0] > 0).all() and lengths.max() <= 4 and not lengths[counts == 0].any()
        assert sum(2.0 ** -n for n in lengths[lengths > 0]) <= 1
        assert (lengths * counts).sum() == best_limited(counts.tolist(), 4)
    counts = np.array([2 ** k for k in range(14)])
    assert (huffman.code_lengths(counts).astype(int) * counts).sum() == plain_cost(counts.tolist())
    skewed = np.array([int(1.6 ** k) + 1 for k in range(60)])
    assert huffman.code_lengths(skewed, 16).max() <= 16
    assert huffman.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0] and not huffman.code_lengths(np.zeros(5, dtype=int)).any()


def test_packing_round_trip():
    random.seed(7)
    ids = np.array([min(int(random.expovariate(0.02)), 999) for _ in range(20_000)])
    n = [1, 5000, 256, 257, 1, 255, 512]
    n = np.array([*n, len(ids) - sum(n)])
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1000), 12)
    bits, edges, offsets, n_segments = huffman.packed(ids, n, lengths, huffman.canonical_codes(lengths)[1])
    sizes = np.concatenate([[256] * (k - 1) + [m - 256 * (k - 1)] for k, m in zip(n_segments, n)])
    starts = offsets + np.repeat(edges[:-1] * 8, n_segments)
    assert huffman.unpacked(bits, starts, sizes, huffman.decoding_table(lengths, 12), 12).tolist() == ids.tolist()


def test_files_round_trip(spark):
    theirs, out = library(BPE), scratch_path(spark, "ids-test")
    docs = spark.createDataFrame(rows(), SCHEMA)
    huffman.write_ids(docs, BPE, out, block_ids=500, segment=16)
    got = huffman.read_ids(spark, out).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, (*theirs(t), 2)) for i, t, *_ in rows())
    before = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == before
        before += len(r["ids"])
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    sums = huffman.read_checksums(spark, out).collect()
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in sums} == {
        (r["doc_id"], r["start"], len(r["ids"]), zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())) for r in got}


def test_no_documents(spark):
    out = scratch_path(spark, "ids-test")
    huffman.write_ids(spark.createDataFrame([], SCHEMA), BPE, out)
    assert huffman.read_ids(spark, out).collect() == []
