"""Cuts texts into units that a byte-level BPE encodes independently, and remembers their codes.

The splitting pattern of such a vocabulary never joins a character to white space behind it. So a
text can be cut before every run of white space, and each unit (white space, then none) is encoded
by itself. Units repeat, so most of a text is dictionary lookups.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# White space of Unicode, as the splitting pattern knows it.
SPACE = "\t-\r \x85\xa0  -     　"
UNITS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
# Remembered codes: two generations of at most this many each, of units up to LONGEST characters.
REMEMBERED = 300_000
LONGEST = 64


def is_word(unit: str) -> bool:
    """Latin letters only; the pattern then takes it whole, together with a blank before it."""
    return unit.isalpha() and max(unit) < "\u0250"


class Codes:
    """Codes of units behind one prefix. A generation that is full becomes the old one; what is still used moves on."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], prefix: str = "", most: int = REMEMBERED):
        self.encode, self.prefix, self.most = encode, prefix, most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []
        self.marks = dict(zip(".,", encode([".", ","]), strict=True))

    def fetch(self, units: set[str]) -> dict[str, bytes]:
        """A table that has at least these units."""
        for unit in self.long:
            self.new.pop(unit, None)
        self.long = []
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        self._add(units)
        return self.new

    def _add(self, units: set[str]) -> None:
        new, old, marked, unknown = self.new, self.old, [], []
        for unit in units - new.keys():
            code = old.get(unit)
            if code is not None:
                new[unit] = code
            elif unit[-1:] in self.marks and is_word(unit[:-1]):
                marked.append(unit)  # the pattern cuts between a letter and a mark
            else:
                unknown.append(unit)
        for unit, code in zip(unknown, self.encode([self.prefix + u for u in unknown]), strict=True):
            new[unit] = code
            if len(unit) > LONGEST:
                self.long.append(unit)
        if marked:
            self._add({unit[:-1] for unit in marked})
            for unit in marked:
                new[unit] = new[unit[:-1]] + self.marks[unit[-1]]


class UnitCoder:
    """Codes of texts: little-endian 32-bit ids as bytes. encode gives the codes of a list of units."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = REMEMBERED):
        self.plain, self.spaced = Codes(encode, most=most), Codes(encode, " ", most)
        self.line = encode(["\n"])[0]

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(text) for text in texts]
        firsts: set[str] = set()
        others: set[str] = set()
        for units, lines in cut:
            firsts.update(units)
            for line in lines:
                firsts.add(line[0])
                others.update(line[1:])
        plain, spaced = self.plain.fetch(firsts).__getitem__, self.spaced.fetch(others).__getitem__
        out = []
        for units, lines in cut:
            coded = [b"".join([plain(line[0]), *map(spaced, line[1:])]) for line in lines]
            out.append(self.line.join(coded) if lines else b"".join(map(plain, units)))
        return out

    @staticmethod
    def _cut(text: str) -> tuple[list[str], list[list[str]]]:
        """Units of any text; or, if only one blank or line feed is between words, its lines of words."""
        words = text.split()
        gaps = len(words) - 1
        if gaps >= 0 and text.count(" ") + text.count("\n") == gaps and sum(map(len, words)) + gaps == len(text):
            return [], [line.split(" ") for line in text.split("\n")]
        return UNITS.findall(text), []
