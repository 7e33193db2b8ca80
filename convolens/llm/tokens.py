"""Exact token counts and ids of public vocabularies, with memory of pieces met before.

Both encoders cut a text where the library's own rules always cut it, look each piece up and ask
the library only about pieces not met yet. Texts for which the cut is not certain go through the
library whole. Memories are bounded in bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache
from struct import pack
from sys import getsizeof

import numpy as np
import regex
from tokenizers import Tokenizer

# Bytes of one memory, and of a dictionary's own entry.
MEMORY, ENTRY = 96 << 20, 100
# Bytes of the memory of pieces that stand beside signs or in capitals: few of the words' pieces.
PIECE_MEMORY = 32 << 20
# How a byte-level vocabulary writes bytes: printable Latin-1 characters stand for themselves, the
# others follow from U+0100 on. Public rule of this kind of vocabulary.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHER = [b for b in range(256) if b not in set(_PLAIN)]
BYTE_TEXT = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(_OTHER)}

# White space beyond ASCII, and the letters from U+00C0 to U+024F (two signs are left out).
WIDE_SPACE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTERS = "".join(chr(c) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7))


def byte_text(text: str) -> str:
    return text.encode().decode("latin-1").translate(BYTE_TEXT)


class Memo(dict):
    """A dictionary that fills itself by ``find``, and is emptied when it takes more than ``most`` bytes."""

    def __init__(self, find, most: int = MEMORY):
        super().__init__()
        self.find, self.most, self.used = find, most, 0

    def __missing__(self, key):
        value = self.find(key)
        self.used += getsizeof(key) + getsizeof(value) + ENTRY
        if self.used > self.most:
            self.clear()
            self.used = getsizeof(key)
        self[key] = value
        return value


class ByteCounter:
    """Token counts of the byte-level vocabulary.

    Its pattern never matches across the change from a character to white space, so the text is
    cut there. A special string in the text is one token and ends the text before it.
    """

    UNITS = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
    # White space of the pattern beyond ASCII: such texts are encoded whole.
    RARE = re.compile("[" + "".join(map(chr, WIDE_SPACE)) + "]")
    WORD = re.compile(f"^ ?[A-Za-z{LETTERS}]+$")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.counts = Memo(self._unit)

    def _unit(self, unit: str) -> int:
        if self.WORD.match(unit):
            return len(self.model.tokenize(byte_text(unit)))
        return len(self.tokenizer.encode(unit, add_special_tokens=False))

    def count(self, text: str) -> int:
        if self.RARE.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        for special in self.special:
            if special in text:
                parts = text.split(special)
                return len(parts) - 1 + sum(map(self.count, parts))
        return sum(map(self.counts.__getitem__, self.UNITS.findall(text)))

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Places where the pattern cuts ``text``, tokens before each, and tokens in all."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in found.word_ids], dtype=np.int64)
        starts = np.array([o[0] for o in found.offsets], dtype=np.int64)
        if not len(words):
            return starts, starts, 0
        first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (words[1:] < 0)])
        return starts[first], first, len(words)


class WordIds:
    """Ids of the lower-case word vocabulary as little-endian unsigned 32-bit numbers.

    White space is dropped and separates pieces, so words are looked up one by one. Characters
    below U+0250 need no normal form; other texts, and those that could hold a special string, are
    encoded whole.
    """

    RARE = re.compile(f"[\x1c-\x1f{chr(0x130)}{chr(0x250)}-{chr(0x10FFFF)}]")
    RARE_ASCII = re.compile("[\x1c-\x1f]")
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.pieces = Memo(self._word), Memo(self._piece, PIECE_MEMORY)

    def _piece(self, piece: str) -> bytes:
        plain = piece if piece.isascii() and piece.isalnum() else byte_text(piece)
        ids = [t.id for t in self.model.tokenize(plain)]
        return pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        low = word.lower()
        if word.isalpha():  # one piece; a word that is its own piece is remembered as a word only
            return self._piece(low) if low == word else self.pieces[low]
        return b"".join(map(self.pieces.__getitem__, self.PIECES.findall(low)))

    def ids(self, text: str) -> bytes:
        rare = self.RARE_ASCII if text.isascii() else self.RARE
        if "<|" in text or rare.search(text):
            found = self.tokenizer.encode(text, add_special_tokens=False)
            return np.array(found.ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=4)
def byte_counter(path: str) -> ByteCounter:
    return ByteCounter(path)


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@lru_cache(maxsize=1)
def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
