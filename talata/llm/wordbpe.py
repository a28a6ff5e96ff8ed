"""Whole-text encoding with a ``tokenizers`` vocabulary file, made fast by remembering words.

The library splits a text into words before it applies BPE, and each word's ids depend on the word
alone. For texts of the plain alphabet below, the same split is done here and BPE runs once a word;
every other text (combining marks, other scripts, control characters, special-token strings) and
every vocabulary file with another pre-tokenizer goes through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

# Letters and digits of the plain alphabet after lower-casing (Latin-1 and Latin Extended-A).
_LETTER = "a-zªµºß-öø-ſ"
_DIGIT = "0-9²³¹¼-¾"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+")
_NOT_PLAIN = re.compile("[^\t-\r -~ -įı-ſ]|<\\|")
_SPLIT_REGEX = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Pieces and words remembered in each of two generations, some 30 MB a worker in all.
MOST_KEPT = 120_000
MAX_KEPT_LENGTH = 48


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE, as a table for str.translate on Latin-1 text."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


class _Remembered(dict):
    """What ``make`` gave for a key. When it is full it becomes the older generation, from which what is asked for again returns."""

    def __init__(self, make, most: int = MOST_KEPT):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MAX_KEPT_LENGTH:
            if len(self) >= self.most:
                self.older = self.copy()
                self.clear()
            self[key] = value
        return value


class WordBpe:
    """Encodes texts to the bytes of little-endian unsigned 32-bit ids, special tokens not added."""

    def __init__(self, path: str, kept: int = MOST_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = self._is_plain(spec)
        self._alphabet = _byte_alphabet()
        self._tokenize = self.tokenizer.model.tokenize
        self._pieces = _Remembered(self._piece, kept)
        self.vocab_size = self.tokenizer.get_vocab_size()

    @staticmethod
    def _is_plain(spec: dict) -> bool:
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        norm = (spec.get("normalizer") or {}).get("normalizers") or []
        return (
            [p.get("type") for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"].get("Regex") == _SPLIT_REGEX
            and pre[0]["invert"] is True
            and pre[1]["add_prefix_space"] is False
            and pre[1].get("use_regex") is False
            and [n.get("type") for n in norm] == ["NFC", "Replace", "Lowercase"]
            and all(t["special"] and t["content"].startswith("<|") for t in spec.get("added_tokens", []))
            and not spec.get("truncation")
        )

    def _word(self, word: str) -> bytes:
        plain = word if word.isascii() else word.encode().decode("latin-1").translate(self._alphabet)  # printable ASCII stands for itself
        return array("I", [t.id for t in self._tokenize(plain)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of text without white space; a word of it is a piece of its own."""
        if piece.isalpha() or len(words := _WORD.findall(piece)) == 1:
            return self._word(piece)
        return b"".join(map(self._pieces.__getitem__, words))

    def encode(self, text: str) -> bytes:
        if self.plain and not _NOT_PLAIN.search(text):
            return b"".join(map(self._pieces.__getitem__, text.lower().split()))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_loaded: dict[tuple[str, int], WordBpe] = {}


def word_bpe(path: str, kept: int = MOST_KEPT) -> WordBpe:
    """One encoder for each vocabulary file and Python worker; it remembers up to twice ``kept`` words, some 200 bytes each."""
    if (path, kept) not in _loaded:
        _loaded[path, kept] = WordBpe(path, kept)
    return _loaded[path, kept]
