"""Character classes, written out so that Java, RE2 and Python agree on them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cache

# What ends a sentence, and what may stand around its end or start.
SENTENCE_TERMINALS = ".!?‼‽⁇⁈⁉。﹒﹗！．？｡"
QUOTES = "\"“”„‟'‘’‚‛«»‹›"
DELAYED_START = QUOTES + "([<{"
DELAYED_END = QUOTES + ")]>}"
#: Separators of words beside white space: zero-width space and byte-order mark.
ZERO_WIDTH = "\u200b\ufeff"


def ranges(points: Iterable[int]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for p in sorted(points):
        if found and found[-1][1] == p - 1:
            found[-1] = (found[-1][0], p)
        else:
            found.append((p, p))
    return found


def char_class(points: Iterable[int], negate: bool = False) -> str:
    """A regular-expression class of code points, for Java and RE2."""
    body = "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges(points))
    return f"[{'^' if negate else ''}{body}]"


def of(text: str) -> str:
    return char_class(map(ord, text))


@cache
def category(prefix: str) -> str:
    """The class of all code points whose Unicode category starts with the prefix, as Python has them."""
    return char_class(p for p in range(0x110000) if unicodedata.category(chr(p)).startswith(prefix))


@cache
def white_points() -> tuple[int, ...]:
    return tuple(p for p in range(0x110000) if chr(p).isspace())


def white() -> str:
    """White space as Python sees it."""
    return char_class(white_points())


def separators() -> str:
    """White space and zero-width separators."""
    return char_class([*white_points(), *map(ord, ZERO_WIDTH)])
