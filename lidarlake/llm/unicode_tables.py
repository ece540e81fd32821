"""Character classes and normal forms as the tokenizer library has them.

The library brings its own Unicode tables, older or newer than those of Python and of its regex
package. What it does with single code points is asked once on the driver, and sent to the workers as
a few hundred ranges; texts without any of the differing code points never need them.
"""

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import regex
from tokenizers import Regex, normalizers, pre_tokenizers

LETTER, NUMBER, OTHER, SPACE = range(4)
#: A character of each class about which all tables agree, and which no pattern names.
STAND_IN = {LETTER: "一", NUMBER: "٠", OTHER: "§", SPACE: "　"}
_KINDS = {LETTER: r"\p{L}+", NUMBER: r"\p{N}+", SPACE: r"\s+"}
#: Marks of a low and a high combining class: another mark moves around one of them if its class is known.
_LOW, _HIGH = "̴", "ͅ"
#: Code points asked about at once.
BLOCK = 1 << 14


class Tables(NamedTuple):
    starts: np.ndarray  # first code point of each run of one class
    kinds: np.ndarray  # class of each run
    moved: list  # (first, last, class) where the regex package has another class
    unlike: str  # characters whose composed lower-case form may differ from Python's

    def classes(self) -> np.ndarray:
        """Class of each code point."""
        return np.repeat(self.kinds, np.diff(self.starts, append=0x110000))


def composed_lower(text: str) -> str:
    """Python's composed form in lower case, character by character."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def library_composed_lower():
    """The same step of the library."""
    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str


def _runs(values):
    """First places of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _unlike(characters) -> set:
    # One line per character; the line feed itself is left out.
    characters = [c for c in characters if c != "\n"]
    theirs, found = library_composed_lower(), set()

    def lines(change, given):
        return change("\n".join(given)).split("\n")

    for before, after in (("", ""), ("", _LOW), (_HIGH, "")):
        given = [before + c + after for c in characters]
        found.update(c for c, a, b in zip(characters, lines(theirs, given), lines(composed_lower, given)) if a != b)
    # A composition that only one side knows: any of its beginnings may stand in a text.
    apart = normalizers.NFD().normalize_str, lambda t: unicodedata.normalize("NFD", t)
    for c, a, b in zip(characters, lines(apart[0], characters), lines(apart[1], characters)):
        if a != b or (a != c and theirs(a) != composed_lower(a)):
            for parts in (a, b):
                found.update(parts[0], *(unicodedata.normalize("NFC", parts[:k]) for k in range(1, len(parts))))
            found.add(c)
    return set("".join(found))


@lru_cache(maxsize=1)
def library_tables() -> Tables:
    """The tables, asked for BLOCK code points at a time, so that the driver never holds the answers to all of them."""
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    theirs, ours = np.full(0x110000, OTHER, np.uint8), np.full(0x110000, OTHER, np.uint8)
    splits = {kind: pre_tokenizers.Split(Regex(pattern), "removed", invert=True) for kind, pattern in _KINDS.items()}
    unlike = set()
    for at in range(0, len(points), BLOCK):
        block = points[at : at + BLOCK]
        text = block.astype("<u4").tobytes().decode("utf-32-le")
        for kind, pattern in _KINDS.items():
            for _, (a, b) in splits[kind].pre_tokenize_str(text):
                theirs[block[a:b]] = kind
            for m in regex.finditer(pattern, text):
                ours[block[m.start() : m.end()]] = kind
        unlike |= _unlike(text)
    starts = _runs(theirs)
    key = np.where(theirs != ours, theirs.astype(int), -1)
    first = _runs(key)
    last = np.append(first[1:], len(key)) - 1
    moved = [(int(a), int(b), int(key[a])) for a, b in zip(first, last) if key[a] >= 0]
    return Tables(starts, theirs[starts], moved, "".join(sorted(unlike)))
