"""Memoised whole-text encoding with public tokenizer files.

The vocabularies known here (KNOWN) cut a text before any merge, and no merge crosses a
cut. With any other file every text goes to the library whole. A text is otherwise split at white space where a cut is certain, each piece is encoded once by
the tokenizers library and kept, and a text's ids are its pieces' ids in order. Texts
in which the library might see more than the pieces (special strings, rare control
characters) go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from itertools import islice

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters that str.split() takes for white space and the vocabularies do not.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")

#: The vocabularies' word patterns (fixed values of their files): white space dropped, or kept with the word after it.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPACED_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The settings of a vocabulary file (all but its tokens and merges) under which pieces may be encoded apart, by whether words are spaced.
KNOWN = {
    False: {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": _WORD.pattern}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    },
    True: {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
}
#: Letters up to here (Latin, Greek, Cyrillic) are the same in every Unicode version; the library cuts other pieces.
#: Left out are two letters that Python lowers by their place in a word, or to several characters.
_PLAIN = re.compile("[\0-\u012f\u0131-\u03a2\u03a4-\u052f]+")
#: Byte-level vocabularies write a byte as its own character where that prints, else as the next one from U+0100.
_PRINTS = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
_BYTE_CHARS = [chr(b) if b in _PRINTS else chr(256 + sum(x not in _PRINTS for x in range(b))) for b in range(256)]

#: Pieces kept in a worker (about 200 bytes each), half as many where they carry the space before them; the longest one kept.
KEEP, KEEP_CHARS = 1_000_000, 48


class PieceCodec(dict):
    """Encodes texts to bytes of little-endian unsigned 32-bit ids; holds the ids of pieces met so far.

    With a vocabulary whose words carry the space before them (spaced), a piece stands
    for itself and the space before it; one that begins with a line feed has no space.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced, self.pattern = spaced, _SPACED_WORD if spaced else _WORD
        self.keep = KEEP // 2 if spaced else KEEP
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        plain = not settings["model"].get("dropout") and not settings.get("truncation") and not settings.get("padding")
        self.known = plain and settings["model"]["type"] == "BPE" and all(settings.get(k) == v for k, v in KNOWN[spaced].items())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bool:
        """Whether the library must see a text whole."""
        return not self.known or any(s in text for s in self.special) or any(s in text for s in _SEPARATORS)

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def words_of(self, piece: str) -> list[str] | None:
        """The words that no merge crosses, or None where the library should see the piece as it is."""
        if not piece.isascii() and not (_PLAIN.fullmatch(piece) and (self.spaced or unicodedata.is_normalized("NFC", piece))):
            return None
        if self.spaced:
            return [" " + piece] if piece.isalpha() else self.pattern.findall(piece if piece[0] == "\n" else " " + piece)
        piece = piece.lower()
        return [piece] if piece.isalpha() else self.pattern.findall(piece)

    def merge(self, word: str) -> bytes:
        """The ids of one word, merged by the library's model."""
        if word.isascii() and word.isprintable() and " " not in word[1:]:
            word = "\u0120" + word[1:] if word[0] == " " else word
        else:
            word = "".join([_BYTE_CHARS[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def word(self, word: str) -> bytes:
        if (key := word[1:] if self.spaced and word[0] == " " else word) == word and self.spaced or not key.isalpha():
            return self.merge(word)
        if (ids := self.get(key)) is None:
            ids = self.merge(word)
            if len(key) <= KEEP_CHARS:
                self[key] = ids
        return ids

    def __missing__(self, piece: str) -> bytes:
        if (words := self.words_of(piece)) is None:
            ids = self.library(piece if not self.spaced or piece[0] == "\n" else " " + piece)
        elif len(words) == 1:
            ids = self.merge(words[0])
        else:
            ids = b"".join(map(self.word, words))
        if len(piece) <= KEEP_CHARS:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; null counts as empty."""
        if not text:
            return b""
        if len(self) > self.keep:  # common pieces come early: the first fifth stays
            first = list(islice(self.items(), self.keep // 5))
            self.clear()
            self.update(first)
        if self.whole(text):
            return self.library(text)
        pieces = text.split()
        if not self.spaced:
            return b"".join(map(self.__getitem__, pieces))
        if " ".join(pieces) != text.replace("\n", " "):  # white space that isn't single
            first, *pieces = _INNER_SPACE.split(text)
            if any(p[0] == "\n" for p in pieces):
                return self.library(text)
            return self.library(first) + b"".join([self[p] for p in pieces])
        pieces = ("\n" + text.replace("\n", " \n")).split(" ")
        return b"".join(map(self.__getitem__, pieces))[4:]  # without the line feed put before the first


_codecs: dict[tuple[str, bool], PieceCodec] = {}


def codec(path: str, spaced: bool) -> PieceCodec:
    """One codec for each vocabulary and Python worker."""
    if (path, spaced) not in _codecs:
        _codecs[path, spaced] = PieceCodec(path, spaced)
    return _codecs[path, spaced]
