"""Splitting texts into the words of byte-level tokenizers."""

from __future__ import annotations

import re
from functools import cache

_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Characters for which the plain classes above do not stand for the properties of letters, numbers and white space.
_BEYOND = re.compile("[\x1c-\x1fɐ-\U0010ffff]").search
_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+").findall
#: Fixed value: the pattern that _PLAIN equals on texts of the first 592 characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word that stays a word when it stands among others like it.
spaced = re.compile(f" [{_LETTERS}]+").fullmatch


@cache
def splitter(pattern: str):
    """A function from texts to their words, in order, by a pattern of the regex library. Known patterns have a quicker one for texts of
    common characters."""
    import regex

    whole = regex.compile(pattern).findall
    if pattern != PATTERN:
        return whole
    return lambda text: whole(text) if _BEYOND(text) else _PLAIN(text)


class Places(dict):
    """Words to numbers; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n
