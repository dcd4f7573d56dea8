"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (``parse_model``) and rebuilt as a library tokenizer: the normaliser (character map, extra
white space, leading marker), the white space marker, the unigram scores or the BPE merges in the order of their
pieces' scores, byte fallback, and the matching decoder.

Texts are cut before white space where no piece can reach across (checked on the vocabulary), so each distinct word is
encoded once per worker: new words go to the library in groups, a batch of groups at a time, multithreaded. Models
without such cuts go text by text. Parity is verified on everything that is encoded: the sentencepiece library encodes
the same groups; where the two differ its ids count, word by word, and the document is marked.

Decoding joins the bytes of the pieces (a table built from the vocabulary); ids whose bytes are not UTF-8 and ids of
control pieces go through the library's decoder."""
from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from drawmark.llm.common import free_name, give_back, held

MARK = "▁"
THREADS = 2  # of a worker
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
# words kept and characters looked at at once bound a worker's memory: more of either did not make it faster
MEMO_WORDS, MEMO_CHARS, GROUP, CHARS_AT_ONCE = 60_000, 64, 256, 1 << 18
_WORD = re.compile(" +[^ ]*")


@dataclass(frozen=True)
class Model:
    """What of the model file the encoder needs."""
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    is_bpe: bool
    byte_fallback: bool
    character_map: bytes
    add_prefix: bool
    trim_spaces: bool
    escape_spaces: bool

    def unknown_id(self) -> int:
        return self.kinds.index(UNKNOWN)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers of varints, bytes of everything else."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if kind == 2:
            size = varint()
        if size is None or at + size > end:
            raise ValueError("not a model file")
        yield tag >> 3, raw[at:at + size]
        at += size


def parse_model(raw: bytes) -> Model:
    """Parse a serialized model."""
    pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode("utf-8"))
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    model_type = trainer.get(3, 1)
    if model_type not in (1, 2):
        raise ValueError("only unigram and BPE models")
    if USER in kinds or trainer.get(24, 0):
        raise ValueError("user-defined pieces and white space as suffix are not supported")
    return Model(tuple(pieces), tuple(scores), tuple(kinds), model_type == 2, bool(trainer.get(35, 0)), normalizer.get(2, b""),
                 bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)))


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make up a piece, best score first."""
    score = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k in (NORMAL, UNUSED)}
    pairs = [(-s, n, p[:n], p[n:]) for p, s in score.items() for n in range(1, len(p)) if p[:n] in score and p[n:] in score]
    pairs.sort(key=lambda x: x[:2])
    return [(a, b) for _, _, a, b in pairs]


def rebuilt(model: Model) -> Tokenizer:
    """The model as a tokenizer of the tokenizers library."""
    unknown = model.pieces[model.unknown_id()]
    if model.is_bpe:
        vocabulary = {p: i for i, p in enumerate(model.pieces)}
        core = models.BPE(vocab=vocabulary, merges=merges_of(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        # pieces that never come from a text keep their ids but cannot win
        rows = [(p, s if k in (NORMAL, UNKNOWN, BYTE) else -1e9) for p, s, k in zip(model.pieces, model.scores, model.kinds)]
        core = models.Unigram(rows, model.unknown_id(), model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.character_map)] if model.character_map else []
    if model.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    if model.add_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    after = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(after + [decoders.Strip(" ", 1, 0)] if model.add_prefix else after)
    return out


def cuts_before_spaces(model: Model) -> bool:
    """Whether a text falls apart before each run of white space: no change by the normaliser, and no piece with a
    marker after another character."""
    reaching = any(re.search(f"[^{MARK}]{MARK}", p) for p, k in zip(model.pieces, model.kinds) if k in (NORMAL, UNUSED))
    return model.add_prefix and model.escape_spaces and not model.trim_spaces and not model.character_map and not reaching


class PieceCoder:
    """Encoder and decoder of one worker for one model file."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        with open(path, "rb") as f:
            raw = f.read()
        self.raw, self.model, self.threads = raw, parse_model(raw), threads
        self.local = cuts_before_spaces(self.model)
        self.memo: dict[str, bytes] = {}
        self.differ: set[str] = set()
        shown = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(self.model.pieces, self.model.kinds)]
        self.piece_bytes = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.piece_sizes = np.array([len(x) for x in shown])
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.plain_ids = np.array([k in (NORMAL, UNUSED, BYTE) for k in self.model.kinds])

    # a worker that only decodes needs none of these
    @cached_property
    def library(self) -> Tokenizer:
        return rebuilt(self.model)

    @cached_property
    def reference(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.raw)

    @cached_property
    def words(self) -> Tokenizer:
        """The same core without the normaliser, for words that have their marker."""
        out = Tokenizer(self.library.model)
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        return out

    def verified(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """Ids of each text and whether both libraries gave them."""
        ours = self.library.encode_batch_fast(texts, add_special_tokens=False)
        theirs = self.reference.encode(texts, num_threads=self.threads)
        return [(np.array(b, dtype="<i4"), a.ids == b) for a, b in zip(ours, theirs)]

    def _new_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words (white space, then other characters); notes those on which the libraries differ."""
        blank = [w for w in words if not w.strip(" ")]  # the end of a text; in a group the next word's white space would join it
        words = [w for w in words if w.strip(" ")]
        groups = [words[k:k + GROUP] for k in range(0, len(words), GROUP)]
        texts = ["".join(g) for g in groups]
        ours = self.words.encode_batch_fast([t.replace(" ", MARK) for t in texts], add_special_tokens=False)
        theirs = self.reference.encode([t[1:] for t in texts], num_threads=self.threads)
        out = {}
        for group, mine, other in zip(groups, ours, theirs):
            if mine.ids == other:
                ids = np.array(other, dtype="<i4")
                reached = np.cumsum(self.piece_sizes[ids])
                wanted = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in group])
                cuts = np.searchsorted(reached, wanted)
                # words end where pieces end, unless an unknown piece hides the length
                if len(ids) and cuts[-1] < len(ids) and np.array_equal(reached[cuts], wanted):
                    raw, ends = ids.tobytes(), (4 * (cuts + 1)).tolist()
                    out.update((w, raw[x:y]) for w, x, y in zip(group, [0, *ends], ends))
                    continue
            for w, (ids, same) in zip(group, self.verified([w[1:] for w in group])):
                out[w] = ids.tobytes()
                if not same:
                    self.differ.add(w)
        before = len(self.reference.encode("a"))
        for w, (ids, same) in zip(blank, self.verified(["a" + w for w in blank])):
            out[w] = ids[before:].tobytes()
            if not same:
                self.differ.add(w)
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """(ids, parity) of each text; looks at so many characters at a time that their words stay few."""
        out: list[tuple[np.ndarray, bool]] = []
        begin, size = 0, 0
        for end, t in enumerate(texts, 1):
            size += len(t)
            if size >= CHARS_AT_ONCE or end == len(texts):
                part = texts[begin:end]
                out += self._encoded(part) if self.local else self.verified(part)
                begin, size = end, 0
        return out

    def _encoded(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
            self.differ.clear()
        # a marker in the text is white space to the model
        words = [_WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        memo = self.memo
        memo.update(self._new_words(list(dict.fromkeys(w for ws in words for w in ws if w not in memo))))
        out = [(np.frombuffer(b"".join(map(memo.__getitem__, ws)), dtype="<i4"), not self.differ or self.differ.isdisjoint(ws)) for ws in words]
        for w in [w for ws in words for w in ws if len(w) > MEMO_CHARS]:
            memo.pop(w, None)
            self.differ.discard(w)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of a list of ids."""
        if not len(ids):
            return ""
        if self.plain_ids[ids].all():
            sizes = self.piece_sizes[ids]
            ends = np.cumsum(sizes)
            at = np.arange(int(ends[-1])) + np.repeat(self.piece_starts[ids] - (ends - sizes), sizes)
            try:
                text = self.piece_bytes[at].tobytes().decode("utf-8")
                return text[1:] if self.model.add_prefix and text.startswith(" ") else text
            except UnicodeDecodeError:
                pass
        return self.library.decode(ids.tolist(), skip_special_tokens=False)


def coder(path: str, threads: int = THREADS) -> PieceCoder:
    """This worker's coder for the file."""
    return held(("pieces", path, threads), lambda: PieceCoder(path, threads))


def encoded_pieces(docs: DataFrame, path: str, text_col: str = "text", threads: int = THREADS) -> DataFrame:
    """``docs`` with piece_ids (array<int>) and parity (existing columns of these names are replaced, except the text).

    Ids are those of the sentencepiece library without begin or end; parity tells whether the rebuilt tokenizer gave the
    same. Null and empty texts have no ids and parity."""
    @F.pandas_udf("ids array<int>, parity boolean")
    def encode(texts: pd.Series) -> pd.DataFrame:
        rows = coder(path, threads).encode(texts.tolist())
        give_back()
        return pd.DataFrame({"ids": [r[0] for r in rows], "parity": [r[1] for r in rows]})

    kept = [c for c in docs.columns if c == text_col or c.lower() not in ("piece_ids", "parity")]
    name = free_name("_coded", kept)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.withColumn(name, encode(text)).select(*[f"`{c}`" for c in kept], F.col(f"{name}.ids").alias("piece_ids"), F.col(f"{name}.parity").alias("parity"))


def decoded_pieces(rows: DataFrame, path: str, ids_col: str = "piece_ids", threads: int = THREADS) -> DataFrame:
    """``rows`` with decoded, the text of the ids (an existing column of this name is replaced, except the ids). Null
    ids decode to an empty text."""
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        text_of = coder(path, threads).decode
        return pd.Series(["" if x is None else text_of(np.asarray(x, dtype=np.int64)) for x in ids], dtype=object)

    kept = [c for c in rows.columns if c == ids_col or c.lower() != "decoded"]
    return rows.select(*[f"`{c}`" for c in kept], decode(F.col(f"`{ids_col}`")).alias("decoded"))
