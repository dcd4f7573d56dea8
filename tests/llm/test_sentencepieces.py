"""Ids and texts against the sentencepiece library, for the public BPE model and for a small unigram model."""
import struct

import numpy as np
import pytest
import sentencepiece

from drawmark.llm.sentencepieces import BYTE, CONTROL, NORMAL, UNKNOWN, PieceCoder, decoded_pieces, encoded_pieces, parse_model

P = pytest.importorskip("public_tokenizers")
BPE = P.path("piece_bpe_32k.model")
TEXTS = ["Hello world", "", " ", "   two  spaces ", "line\nbreak\t tab", "日本語🙂 é e\u0301", "▁marker ▁▁x", "a" * 3000, "word " * 2000, "<s> </s> <unk> <0x0A>", "\u0000\u001f",
         "Ⅳ ﬁ ² \u00a0nbsp\u3000wide", "x\n\n\n y", "...!!! ,,a", "İı ß ẞ", "\n", " \n ", "a\u200bb"]


def message(*fields):
    """A protobuf message of (number, value)."""
    def varint(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model(byte_fallback, add_prefix=1, trim=0):
    words = {"▁": -2.0, "▁a": -3.0, "a": -3.5, "b": -3.6, "ab": -4.0, "▁ab": -4.2, "ba": -4.1, "c": -5.0, "abc": -5.5, "é": -6.0, "▁▁": -3.3, "x": -9.0, ".": -4.0}
    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL)] + [(w, s, NORMAL) for w, s in words.items()]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", -20.0, BYTE) for b in range(256)]
    fields = [(1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces]
    return message(*fields, (2, message((3, 1), (4, len(pieces)), (35, int(byte_fallback)))), (3, message((1, b"identity"), (3, add_prefix), (4, trim), (5, 1))))


def test_public_model_is_the_library(spark):
    reference = sentencepiece.SentencePieceProcessor(model_file=BPE)
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in enumerate([*TEXTS, None])] + [(0, TEXTS[0], "p", 1)], "doc_id bigint, text string, PARITY string, _coded int")
    out = encoded_pieces(docs, BPE)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_coded", "piece_ids", "parity"])
    rows = decoded_pieces(out, BPE).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = reference.encode(r["text"] or "")
        assert r["piece_ids"] == want and r["parity"], r["text"]
        assert r["decoded"] == reference.decode(want)
    nothing = spark.createDataFrame([(None,)], "piece_ids array<int>")
    assert [r["decoded"] for r in decoded_pieces(nothing, BPE).collect()] == [""]
    assert encoded_pieces(docs.limit(0), BPE).collect() == []


def test_rebuilt_tokenizer_alone_gives_the_ids():
    own, reference = PieceCoder(BPE), sentencepiece.SentencePieceProcessor(model_file=BPE)
    assert own.local
    for t in TEXTS:
        if "▁" not in t:
            assert own.library.encode(t, add_special_tokens=False).ids == reference.encode(t), t


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("trim", [0, 1])
def test_unigram_model(tmp_path, byte_fallback, trim):
    raw = unigram_model(byte_fallback, trim=trim)
    path = tmp_path / "small.model"
    path.write_bytes(raw)
    model, reference = parse_model(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert not model.is_bpe and model.byte_fallback == byte_fallback and model.trim_spaces == bool(trim)
    own = PieceCoder(str(path))
    assert own.local == (not trim)
    texts = ["ab abc", "aab ba cab", "é a.b", "abcabc  ab", "xx a", "", "b", "a zz b"]
    for t, (ids, _) in zip(texts, own.encode(texts)):
        assert ids.tolist() == reference.encode(t)
    assert [own.encode([t])[0][1] for t in texts[:4]] == [True] * 4


def test_decoding_any_ids():
    own, reference = PieceCoder(BPE), sentencepiece.SentencePieceProcessor(model_file=BPE)
    rng = np.random.default_rng(1)
    for _ in range(50):
        ids = rng.integers(300, 32_000, 30)
        assert own.decode(ids) == reference.decode(ids.tolist())
    assert own.decode(np.array([3 + 0xE2])) == "\ufffd"


def test_not_a_model():
    with pytest.raises(ValueError):
        parse_model(b"\x0f\xff\xff")


def test_words_kept_are_bounded():
    coder = PieceCoder(BPE)
    texts = [" ".join(f"w{i}x{k}" for k in range(500)) for i in range(200)]
    found = [ids.tolist() for ids, _ in coder.encode(texts)]
    assert len(coder.memo) < 100_000  # before: all 100,000 words
    assert found == coder.reference.encode(texts)
