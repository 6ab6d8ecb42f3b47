"""Token ids by the tokenizers library, with the ids of every word remembered.

Where a tokenizer drops white space and never joins across it, a text's ids are its words' ids one after
the other; ``WordIds`` asks the library once per word and worker and joins what it remembers. Texts that
hold a special token's string or a control character go to the library whole, and so do all texts of a
tokenizer that isn't of this kind.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np

from .bpe_stream import byte_chars

REMEMBERED = 600_000
LONGEST = 64
#: Characters below U+0180 that lower-case and compose alone; combining marks start at U+0300.
_PLAIN = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x180)]) if c != "\u0130" and len(c.lower()) == 1 and c.lower() < "\u0180"]
_PLAIN_WORD = re.compile("[" + re.escape("".join(_PLAIN)) + "]+")
_LETTERS, _NUMBERS = ("".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind) for kind in "LN")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
#: The split pattern for which _PIECES says the same on lower-case plain words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds(dict):
    """word -> ids as little-endian 32-bit integers; bounded by remembered words, emptied when full."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__()
        self.remembered = remembered
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.specials = [t["content"] for t in spec.get("added_tokens", ())]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.by_word = pre.get("pattern", {}).get("Regex") == _SPLIT and pre.get("behavior") == "Removed" and bool(pre.get("invert"))
        self.pieces: dict[str, bytes] = {}
        self.byte_char = [c for _, c in sorted(byte_chars().items())]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if (out := self.pieces.get(piece)) is None:
            known = piece if piece.isascii() else "".join(map(self.byte_char.__getitem__, piece.encode()))
            out = array("I", [t.id for t in self.tokenizer.model.tokenize(known)]).tobytes()
            if len(self.pieces) >= self.remembered:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    def __missing__(self, word: str) -> bytes:
        if len(word) <= LONGEST and _PLAIN_WORD.fullmatch(word):
            out = b"".join(map(self._piece, _PIECES.findall(word.lower())))
        else:
            out = self._whole(word)
        if len(word) <= LONGEST:
            if len(self) >= self.remembered:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        odd = not self.by_word or any(c in text for c in "\x1c\x1d\x1e\x1f") or any(s in text for s in self.specials)
        return self._whole(text) if odd else b"".join(map(self.__getitem__, text.split()))


_MADE: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    """One per worker process."""
    if (path, remembered) not in _MADE:
        _MADE[path, remembered] = WordIds(path, remembered)
    return _MADE[path, remembered]
