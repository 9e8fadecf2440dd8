"""Normalising and splitting texts as the word-end BPE vocabulary prescribes, before any merging."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import regex

#: The vocabulary file's pattern for words and its special strings.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
#: Code points that the fast path knows.
_FAST = 0x250


def _plain_class(kind: str) -> str:
    """Characters of the fast path of a general category, for a class of the standard engine."""
    return "".join(re.escape(chr(c)) for c in range(_FAST) if unicodedata.category(chr(c))[0] == kind)


def _is_plain(c: int) -> bool:
    """Whether a character is in NFC, has a lower case of one character that the fast path knows, and is white space to both
    engines or to neither (U+001C to U+001F and U+0085 are not)."""
    low = chr(c).lower()
    return len(low) == 1 and ord(low) < _FAST and unicodedata.normalize("NFC", chr(c)) == chr(c) and c not in (0x1C, 0x1D, 0x1E, 0x1F, 0x85)


_WORDS = re.compile(PATTERN.replace(r"\p{L}", _plain_class("L")).replace(r"\p{N}", _plain_class("N")))
_SPECIAL = regex.compile("(" + "|".join(map(regex.escape, SPECIALS)) + ")")
_PLAIN = re.compile("[" + "".join(re.escape(chr(c)) for c in range(_FAST) if _is_plain(c)) + "]*")


class Splitter:
    """Words of a text after NFC and lower case. Plain Latin text takes a fast path; the rest the library's own steps."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is a special string, piece) in order; special strings are found in the raw text, before normalising."""
        if "<|" not in text:
            yield False, text
            return
        for i, part in enumerate(_SPECIAL.split(text)):
            if part:
                yield i % 2 == 1, part

    def words(self, piece: str) -> list[str]:
        """The vocabulary's words of a piece without special strings."""
        if _PLAIN.fullmatch(piece):
            return _WORDS.findall(piece.lower())
        norm = self.tokenizer.normalizer.normalize_str(piece)
        return [norm[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(norm)]
