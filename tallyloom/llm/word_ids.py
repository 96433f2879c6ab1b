"""Subword ids of whole texts, by a table of words that each worker fills as it meets them.

The tokenizer ``word_bpe_49k.json`` drops white space and never merges across
it, so the ids of a text are those of its words in turn. A word is looked up
first; an unseen one is cut as the tokenizer's own rules cut it and each part
goes to the tokenizer's model. Words outside Latin-1 and texts that may hold a
special token's name go through the whole tokenizer, so ids are always its own.

The cutting rules and the byte alphabet are those of this vocabulary file; another
file needs rules of its own, and the tests compare ids with the tokenizer's. Long
unbroken stretches are spelt but not remembered, so the tables stay bounded in bytes.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Ids below this number.
VOCABULARY_SIZE = 49_408
#: Words that a worker remembers at most (about 200 bytes each).
REMEMBERED = 700_000
#: Longer words (bytes) are not remembered.
LONGEST = 64

_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
_PLAIN = re.compile("[\x21-\x7e\xa1-\xff]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """Maps a lower-case word (UTF-8 bytes) to its ids (little-endian unsigned 32 bits)."""

    def __init__(self, path: str | None = None, remembered: int = REMEMBERED):
        super().__init__()
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.spell(word)
        if len(word) <= LONGEST:
            if len(self) >= self.remembered:
                self.clear()
            self[word] = ids
        return ids

    def spell(self, word: bytes) -> bytes:
        """Ids of a lower-case word, not remembered."""
        text = word.decode()
        if text.isascii():  # most words are letters, or letters and one mark
            if text.isalpha():
                return self._part(text.lower())
            if text[:-1].isalpha() and text[-1] in ".,;:!?":
                return self._part(text[:-1].lower()) + self._part(text[-1])
        return b"".join(map(self._part, _PARTS.findall(text.lower()))) if _PLAIN.fullmatch(text) else self._whole(text)

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= self.remembered:
                self.parts.clear()
            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            if len(part) <= LONGEST:
                self.parts[part] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of_text(self, text: str) -> bytes:
        words = text.encode().lower()
        if b"<|" in words:
            return self._whole(text)
        return b"".join(map(self.__getitem__, words.split()))


@cache
def word_ids(path: str | None = None, remembered: int = REMEMBERED) -> WordIds:
    """The worker's own table."""
    return WordIds(path, remembered)
