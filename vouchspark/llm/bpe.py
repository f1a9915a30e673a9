"""Whole texts to token ids with the tokenizers library, fast on repeated words.

The pre-tokenizers of the public vocabularies never let a token cross from a non-blank to the
blank after it.  So a text may be cut into units there, and the ids of the text are the ids of
its units in a row; a worker keeps the ids of units it has met.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

from vouchspark.llm.worker import kept

# Blanks as the vocabularies see them: Python counts four control characters more.
_BLANK, _TEXT = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
#: Blanks before the last one, one blank with what follows it, blanks at the end.
SPACED_UNITS = re.compile(rf"{_BLANK}+(?={_BLANK}{_TEXT})|{_BLANK}?{_TEXT}+|{_BLANK}+")
#: For vocabularies that drop blanks.
BARE_UNITS = re.compile(rf"{_TEXT}+")
UNIT_LIMIT = 500_000
LONG_UNIT = 48
#: A run of ASCII marks behind a Latin letter is a piece of its own, and so is a line feed before a
#: word; ``>`` may end the name of a special token, which some pre-tokenizers keep whole.
_MARKS = "!\"#$%&'()*+,-./:;<=?@[\\]^_`{|}~"
_LAST_LATIN = "\u024f"
_CUTS = (("word", "."), ("word", ",&&&"), ("word", "'"), ("Stra\u00dfe", "###"), ("\u00e9t\u00e9", "?!"), ("x", "*"), ("\n", "word"), ("\n", "\u00e9t\u00e9"))
#: Byte-level vocabularies write printable bytes as themselves and the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_PROBES = ("word", "Straße", "naïve", "été", "слово", "語")


class UnitEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    ``drops_blanks`` says that the vocabulary ignores white space and lower-cases.  Strings of
    special tokens inside a text are ordinary text.  A unit of letters alone is one piece to the
    pre-tokenizer, so it goes straight to the merges of the model, in the model's byte writing;
    that this gives the same ids is tried on a few words when the vocabulary is loaded, and so is
    cutting marks off a word.
    """

    def __init__(self, path: str, drops_blanks: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.units, self.bare = (BARE_UNITS if drops_blanks else SPACED_UNITS), drops_blanks
        self.merge, self.straight = self.tokenizer.model.tokenize, True
        tried = _PROBES if drops_blanks else (*_PROBES, *(" " + w for w in _PROBES))
        self.straight = all(self._letters(u) == self._encode(u) for u in tried)
        self.cuts = all(self._encode(a + b) == self._encode(a) + self._encode(b) for a, b in _CUTS if not (self.bare and a == "\n"))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, unit: str) -> bytes:
        return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()

    def _letters(self, unit: str) -> bytes | None:
        """Ids of letters behind at most one space; None where rules beyond the merges may apply."""
        word = unit if self.bare or unit[0] != " " else unit[1:]
        if not word.isalpha():
            return None
        if not word.isascii():
            # Lower-casing a final sigma or a dotted capital depends on what surrounds it.
            if self.bare and ("\u03a3" in word or "\u0130" in word or not unicodedata.is_normalized("NFC", word)):
                return None
            unit = (word.lower() if self.bare else unit).encode().decode("latin-1").translate(_BYTES)
        elif self.bare:
            unit = word.lower()
        elif unit is not word:
            unit = chr(_BYTES[32]) + word
        return array("I", [t.id for t in self.merge(unit)]).tobytes()

    def _new(self, unit: str) -> bytes:
        """Ids of a unit met for the first time, or again after a while; long ones are not kept."""
        ids = self.older.get(unit)
        if ids is None:
            ids = (self._cut(unit) if self.cuts else None) or (self._letters(unit) if self.straight else None) or self._encode(unit)
        if len(unit) <= LONG_UNIT:
            self.known[unit] = ids
        return ids

    def _cut(self, unit: str) -> bytes | None:
        """Ids of a word and of what is sure to be a piece of its own beside it."""
        if unit[0] == "\n" and unit[1:].isalpha() and not self.bare:
            return self._get("\n") + self._get(unit[1:])
        word = unit.rstrip(_MARKS)
        # A dotted capital becomes a letter and a mark in lower case.
        if len(word) < len(unit) and word and word[-1] <= _LAST_LATIN and word[-1].lower().isalpha():
            return self._get(word) + self._get(unit[len(word) :])
        return None

    def _get(self, unit: str) -> bytes:
        return self.known.get(unit) or self._new(unit)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.known) >= UNIT_LIMIT:  # what is asked for again moves over, the rest goes next time
            self.known, self.older = {}, self.known
        units = self.units.findall(text)
        ids = list(map(self.known.get, units))
        if None in ids:
            ids = [self._get(u) if known is None else known for u, known in zip(units, ids, strict=True)]
        return b"".join(ids)


def encoder(path: str, drops_blanks: bool) -> UnitEncoder:
    return kept(f"bpe {path}", lambda: UnitEncoder(path, drops_blanks))
