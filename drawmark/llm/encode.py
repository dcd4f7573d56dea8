"""Token ids of whole texts as the tokenizers library gives them, with a memo of pieces.

For byte-level BPE the library first splits a text into pieces by a fixed pattern and then encodes each piece alone.
The second step is the costly one and pieces recur, so each distinct piece goes through the library's model once per
worker (the memo is emptied when full). The pattern is applied here only to texts of characters on which Unicode
versions agree; any other text, one with a special token's string, and every other kind of tokenizer go through the
library whole. Either way the ids are the library's."""
from __future__ import annotations

import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from drawmark.llm.common import held

_SETTLED = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f]*")
# The letters and numbers among these characters, and the pieces of byte-level BPE in terms of them.
_LETTERS, _NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PIECES = re.compile(rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
MEMO_PIECES, MEMO_CHARS = 500_000, 64


class _Memo(dict):
    """Ids of pieces; a new piece goes through the model. Emptied when full, so its size is bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class PieceEncoder:
    """Encoder of one worker for one tokenizer file."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.special = [t["content"] for t in parts.get("added_tokens") or []]
        before = parts.get("pre_tokenizer") or {}
        plain = (parts["model"].get("type") == "BPE" and not parts.get("normalizer") and before.get("type") == "ByteLevel"
                 and before.get("use_regex", True) and not before.get("add_prefix_space") and not parts["model"].get("dropout"))
        # the library's table of bytes as characters
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown = {b: shown(chr(b))[0][0] for b in range(0x80)}
        for b in range(0x80, 0x800):
            self.shown.update(zip(chr(b).encode(), shown(chr(b))[0][0]))
        self.memo = _Memo(self._piece) if plain else None
        self.model = self.library.model
        # the library's own memo is of no use behind this one
        if plain and hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)

    def _piece(self, piece: str) -> bytes:
        # printable ASCII but the space stands for itself in the table
        plain = piece.isascii() and piece.isprintable()
        as_bytes = piece.replace(" ", self.shown[0x20]) if plain else "".join(map(self.shown.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(as_bytes)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers, nothing added; none for null."""
        if not text:
            return b""
        if self.memo is None or not _SETTLED.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.memo.__getitem__, _PIECES.findall(text)))


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for the file."""
    return held(("encoder", path), lambda: PieceEncoder(path))
