"""Token ids of whole texts by the tokenizers library, word by word with a cache.

A text is cut where the tokenizer's own splitting always cuts and where nothing
on one side changes what happens on the other, so the ids of the pieces in a row
are the ids of the text. Words recur, and their ids are then looked up.

* ``word``: white space is dropped and no match of the splitter crosses it.
* ``byte``: a piece is a run of white space with the run of other characters that
  follows; the end of a run of other characters is always a boundary.

A word of plain letters, with or without closing marks, goes straight to the
library's model; anything else goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array

# words kept in the younger of two generations
CACHED_WORDS = 500_000
CACHED_CHARS = 48

# all characters with the Unicode property White_Space
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUNS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_WORDS = re.compile(r"[^\t-\r ]+")
# str.split() also cuts at these four, the tokenizers don't
_SEPARATORS = re.compile("[\x1c-\x1f]")
_UNEVEN_ASCII = ("  ", "\n\n", " \n", "\n ", "\t", "\v", "\f", "\r")
_UNEVEN_OTHER = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
# a run of these is one piece to both splitters, and no control token holds one
_MARKS = ".,;:!?*&%$#"


def _even(text: str) -> bool:
    """Only single spaces between words and single line ends between lines."""
    if text[0] in " \n" or text[-1] in " \n" or any(run in text for run in _UNEVEN_ASCII):
        return False
    return text.isascii() or not _UNEVEN_OTHER.search(text)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the 256 bytes: printable ones as
    themselves, the others, in order, from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. One per worker process and vocabulary file."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_byte = kind == "byte"
        self.letters = _byte_letters()
        self.words = _Cache(self._word)
        self.plain = _Cache(self._letters)
        self.bare = _Cache(self._ids)

    def encode(self, text: str) -> bytes:
        if self.by_byte:
            if not text:
                return b""
            if not _even(text):
                return b"".join(map(self._whole, _RUNS.findall(text)))
            first, *rest = text.replace("\n", " \n").split(" ")
            return self._whole(first) + b"".join(map(self.words.__getitem__, rest))
        words = _WORDS.findall(text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))

    def _whole(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word that follows a space (``byte``: or starts with its line end)."""
        if self.by_byte and word[:1] == "\n" and word[1:].rstrip(_MARKS).isalpha():
            letters = word[1:].rstrip(_MARKS)
            if letters.isascii() or _LATIN.fullmatch(letters):
                marks = word[1 + len(letters) :]
                return self.bare["\n"] + self.bare[letters] + (self.bare[marks] if marks else b"")
        letters = word if word.isalpha() else word.rstrip(_MARKS)
        if not letters.isalpha() or not (letters.isascii() or _LATIN.fullmatch(letters)):
            return self._whole(word if not self.by_byte or word[:1] == "\n" else " " + word)
        ids = self.plain[letters if self.by_byte else letters.lower()]
        return ids if letters is word else ids + self.bare[word[len(letters) :]]

    def _letters(self, letters: str) -> bytes:
        return self._ids((" " if self.by_byte else "") + letters)

    def _ids(self, text: str) -> bytes:
        # printable ASCII is written as it is
        plain = text[1:] if self.by_byte and text[:1] == " " else text
        if plain.isascii() and plain.isalpha():
            written = plain if plain is text else self.letters[32] + plain
        else:
            written = "".join(map(self.letters.__getitem__, text.encode()))
        return array("I", [token.id for token in self.model.tokenize(written)]).tobytes()


class _Cache(dict):
    """Looks a missing word up and keeps it. A full cache becomes the older generation;
    words found there are taken over, so frequent words are never looked up again."""

    def __init__(self, look_up):
        super().__init__()
        self.look_up, self.older = look_up, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.look_up(word)
            if len(word) > CACHED_CHARS:
                return ids
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
