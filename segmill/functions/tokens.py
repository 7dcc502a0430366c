"""Tokenizers and detokenizers.

Simple ones are Column expressions.  Those for Latin script look at the
characters around a position and are Arrow-batched functions over small
regular-expression scanners.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, partial

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from segmill.functions import characters as ch

SPACE_MARK = "<space>"


def apart(udf):
    """A function that Catalyst evaluates in a projection of its own: folded into transform() and the like it could not run."""
    return udf.asNondeterministic()


# --- on arrays of tokens -----------------------------------------------------------


def lowercased(segment: Column) -> Column:
    return F.transform(segment, F.lower)


def spaces_escaped(segment: Column) -> Column:
    """Tokens of white space only become <space>."""
    return F.transform(segment, lambda t: F.when(t.rlike(f"^{ch.white()}+$"), F.lit(SPACE_MARK)).otherwise(t))


def spaces_unescaped(segment: Column) -> Column:
    return F.transform(segment, lambda t: F.when(t == SPACE_MARK, F.lit(" ")).otherwise(t))


def normalized(segment: Column, form: str) -> Column:
    """Unicode normalization of each token; SQL has no function for it."""

    @pandas_udf("array<string>")
    def normalize(batch: pd.Series) -> pd.Series:
        return batch.map(lambda tokens: None if tokens is None else [unicodedata.normalize(form, t) for t in tokens])

    return apart(normalize)(segment)


def retokenized(segment: Column, tokenize: Callable[[Column], Column]) -> Column:
    """Tokens of the segment's text; empty segments stay."""
    return F.when(F.size(segment) > 0, tokenize(F.array_join(segment, " "))).otherwise(segment)


def rejoined(segment: Column, detokenize: Callable[[Column], Column]) -> Column:
    """A segment of more than one token becomes one of one token."""
    return F.when(F.size(segment) > 1, F.array(detokenize(segment))).otherwise(segment)


# --- native ------------------------------------------------------------------------


def whitespace(text: Column) -> Column:
    return F.filter(F.split(text, f"{ch.separators()}+"), lambda t: t != "")


def lines(text: Column) -> Column:
    """Lines without their ends; none after the last end."""
    parts = F.split(text, "\r\n|\r|\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def null_tokens(text: Column) -> Column:
    return F.when(text == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.array(text))


def token_ranges(text: Column, tokens: Column) -> Column:
    """array<struct<start, end>>: where each token stands, found one after the other; null if one is missing."""

    @arrow_udf("array<struct<start:int,end:int>>")
    def found(texts: pa.Array, held: pa.Array) -> pa.Array:
        starts, ends, offsets, missing = [], [], [0], []
        for whole, own in zip(texts.to_pylist(), held.to_pylist(), strict=True):
            at, begun = 0, len(starts)
            lacks = whole is None or own is None
            for token in () if lacks else own:
                at = -1 if token is None else whole.find(token, at)
                if at < 0:
                    lacks = True
                    del starts[begun:], ends[begun:]
                    break
                starts.append(at)
                at += len(token)
                ends.append(at)
            offsets.append(len(starts))
            missing.append(lacks)
        places = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), places, mask=pa.array(missing, pa.bool_()))

    return apart(found)(text, tokens)


def split_by_ranges(text: Column, ranges: Column) -> Column:
    """array<string>: the text of each range, null where there are none."""

    @arrow_udf("array<string>")
    def split(texts: pa.Array, held: pa.Array) -> pa.Array:
        places = held.flatten()
        starts, ends = (places.field(k).to_pylist() for k in (0, 1))
        parts, offsets, missing, at = [], [0], [], 0
        for whole, n in zip(texts.to_pylist(), pc.list_value_length(held).to_pylist(), strict=True):
            stop = at + (n or 0)
            parts += [None if whole is None else whole[a:b] for a, b in zip(starts[at:stop], ends[at:stop], strict=True)]
            at = stop
            offsets.append(at)
            missing.append(n is None)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(parts, pa.string()), mask=pa.array(missing, pa.bool_()))

    return apart(split)(text, ranges)


def packed(segment: Column) -> Column:
    """Tokens as one string, which is shorter in an exchange than their array; there must be one at least."""
    return F.array_join(F.transform(segment, lambda t: F.replace(F.replace(t, F.lit("\x02"), F.lit("\x02b")), F.lit("\x01"), F.lit("\x02a"))), "\x01")


def unpacked(text: Column) -> Column:
    """The tokens that packed() made one string of."""
    return F.transform(F.split(text, "\x01", -1), lambda t: F.replace(F.replace(t, F.lit("\x02a"), F.lit("\x01")), F.lit("\x02b"), F.lit("\x02")))


def whitespace_joined(segment: Column) -> Column:
    return F.array_join(segment, " ")


# --- Latin script --------------------------------------------------------------------


@cache
def _patterns():
    """Compiled when a task first needs them."""
    import regex

    # Punctuation that may stand inside a word, and what starts a URL.
    inner = r"(?:[&\-.:=,?@\xAD\xB7‐‑’‧]|['_]+)"
    mark = r"[\p{P}\p{S}\p{Cc}]"
    letter = r"[^\p{P}\p{S}\p{Cc}]"
    return {
        "chunk": regex.compile(rf"[^\s{ch.ZERO_WIDTH}\x1c-\x1f]+"),
        "zwsp_chunk": regex.compile(rf"[^{ch.ZERO_WIDTH}]+"),
        "url": regex.compile(r"(?:[\w-]+://?|www[.])[^\s()<>]+(?:[\w\d]+|(?:[^\p{P}\s]|/))", regex.IGNORECASE),
        "body": regex.compile(rf"(?:{letter}|{inner}(?={letter}))*"),
        "inner": regex.compile(inner),
        "mark": regex.compile(rf"({mark})\1*"),
        "letter": regex.compile(letter),
        "punctuation": regex.compile(r"\p{P}"),
        "currency": regex.compile(r"\p{Sc}"),
    }


def _word_ranges(text: str, start: int, end: int, abbreviations: frozenset[str], quote: bool) -> Iterator[tuple[int, int]]:
    """Tokens of a chunk without separators.

    A word runs over letters, and over inner punctuation that a letter follows.
    What then comes is a mark of its own, a run of one character, or inner
    punctuation with another mark behind it, which starts the next word.
    """
    p = _patterns()
    at, begun = start, None
    while at < end:
        if begun is None:
            mark = p["mark"].match(text, at, end)
            if mark and not (mark[1] == "'" and not quote):
                yield mark.span()
                at = mark.end()
                continue
            begun, at = at, mark.end() if mark else at
        at = p["body"].match(text, at, end).end()
        if at == end:
            break
        inner = p["inner"].match(text, at, end)
        run = p["mark"].match(text, at, end)
        if inner is None:
            yield begun, at
            yield run.span()
            begun, at = None, run.end()
            continue
        own = inner[0] == "'" and not quote
        if inner.end() == end:
            if own or (inner[0] == "." and text[begun:at].lower() in abbreviations):
                yield begun, end
            else:
                yield begun, at
                yield at, end
            return
        if own:
            yield begun, inner.end()
        else:
            yield begun, at
            yield at, inner.end()
        begun = inner.end()
        at = p["mark"].match(text, begun, end).end()
    if begun is not None:
        yield begun, end


def latin_ranges(text: str, start: int = 0, end: int | None = None, abbreviations: frozenset[str] = frozenset(), apostrophe_is_quote: bool = False) -> list[tuple[int, int]]:
    """(start, end) of words and marks; a URL at the start of a chunk is one token."""
    p, found = _patterns(), []
    for chunk in p["chunk"].finditer(text, start, len(text) if end is None else end):
        a, b = chunk.span()
        url = p["url"].match(chunk[0])
        if url:
            found.append((a, a + url.end()))
            a += url.end()
        found += _word_ranges(text, a, b, abbreviations, apostrophe_is_quote)
    return found


def sentence_ranges(text: str) -> list[tuple[int, int]]:
    """Sentences of each line: up to terminals and the quotes or brackets behind them, unless a small letter goes on."""
    found = []
    at = 0
    for line in _lines(text):
        stop = at + len(line.rstrip("\r\n"))
        begun, last, ended, closed = None, at, False, False
        for a, b in latin_ranges(text, at, stop):
            word = text[a:b]
            if begun is None:
                begun = a
            if not ended:
                ended = all(c in ch.SENTENCE_TERMINALS for c in word)
            elif all(c in ch.DELAYED_END for c in word):
                closed = True
            elif closed and word[0].islower():
                ended = closed = False
            else:
                found.append((begun, last))
                begun, ended, closed = a, False, False
            last = b
        if begun is not None:
            found.append((begun, last if ended else stop))
        at += len(line)
    return found


def _lines(text: str) -> list[str]:
    """Lines with their ends."""
    return [m[0] for m in re.finditer(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$", text)]


def zwsp_ranges(text: str) -> list[tuple[int, int]]:
    """Words apart by zero-width spaces; white space is a token, unless punctuation or the text's end is beside it."""
    p, found = _patterns(), []
    for chunk in p["zwsp_chunk"].finditer(text):
        at = chunk.start()
        while at < chunk.end():
            if text[at].isspace():
                stop = at
                while stop < chunk.end() and text[stop].isspace():
                    stop += 1
                before = at > 0 and p["punctuation"].match(text[at - 1])
                after = stop < len(text) and p["punctuation"].match(text[stop])
                if not before and not after:
                    found.append((at, stop))
            else:
                stop = at
                while stop < chunk.end() and not text[stop].isspace():
                    stop += 1
                found += _word_ranges(text, at, stop, frozenset(), False)
            at = stop
    return found


# Quotation marks by kind; opening and closing marks of a kind toggle.
QUOTE_KINDS = {c: k for k, group in enumerate(('"“”„‟', "'‘’‚‛", "«»", "‹›")) for c in group}


def _joins(tokens: list[str], spaces: bool) -> list[tuple[bool, bool]]:
    """(joins left, joins right) of each token."""
    p, open_quotes, found = _patterns(), [], []
    for token in tokens:
        c = token[:1]
        if spaces and c.isspace():
            found.append((True, True))
        elif p["currency"].match(c) or (c and c in "([{¿¡<"):
            found.append((False, True))
        elif c in QUOTE_KINDS:
            closes = bool(open_quotes) and QUOTE_KINDS[c] == open_quotes[-1]
            open_quotes.pop() if closes else open_quotes.append(QUOTE_KINDS[c])
            found.append((closes, not closes))
        elif c and c in "/\\":
            found.append((True, True))
        else:
            found.append((bool(p["punctuation"].match(c)) or c == ">", False))
    return found


def latin_join(tokens: list[str]) -> str:
    joins, out = _joins(tokens, False), []
    for i, token in enumerate(tokens):
        if i and not joins[i][0] and not joins[i - 1][1]:
            out.append(" ")
        out.append(token)
    return "".join(out)


def zwsp_join(tokens: list[str]) -> str:
    """Words joined by zero-width spaces, with a space before opening and after closing punctuation."""
    p, joins, out = _patterns(), _joins(tokens, True), []
    for i, token in enumerate(tokens):
        if i and not joins[i][0] and not joins[i - 1][1]:
            opens = joins[i] == (False, True) and p["punctuation"].match(token)
            closes = joins[i - 1] == (True, False) and p["punctuation"].match(tokens[i - 1])
            out.append(" " if opens or closes else "\u200b")
        out.append(token)
    return "".join(out)


def _tokenizer_udf(ranges: Callable[[str], list[tuple[int, int]]]) -> Callable[[Column], Column]:
    @pandas_udf("array<string>")
    def tokenize(batch: pd.Series) -> pd.Series:
        return batch.map(lambda text: None if text is None else [text[a:b] for a, b in ranges(text)])

    return apart(tokenize)


def _join_udf(join: Callable[[list[str]], str]) -> Callable[[Column], Column]:
    @pandas_udf("string")
    def detokenize(batch: pd.Series) -> pd.Series:
        return batch.map(lambda tokens: None if tokens is None else join(list(tokens)))

    return apart(detokenize)


#: Letters and digits of plain words, and the one mark that may end each.
PLAIN_LETTER, PLAIN_MARK = "[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", "[.,:;!?]"


def latin(abbreviations: frozenset[str] = frozenset(), apostrophe_is_quote: bool = False) -> Callable[[Column], Column]:
    """Texts of plain words, each with one mark behind it at most, are cut by the JVM; only others go to Python."""
    scan = _tokenizer_udf(partial(latin_ranges, abbreviations=abbreviations, apostrophe_is_quote=apostrophe_is_quote))
    if abbreviations:
        return scan

    def tokenize(text: Column) -> Column:
        gap = ch.separators()
        plain = text.rlike(f"^{gap}*+(?:{PLAIN_LETTER}++{PLAIN_MARK}?+(?:{gap}++|$))*+$")
        return F.when(plain, F.regexp_extract_all(text, F.lit(f"{PLAIN_LETTER}+|{PLAIN_MARK}"), F.lit(0))).otherwise(scan(F.when(~plain, text)))

    return tokenize


def sentencepiece_joined(segment: Column) -> Column:
    """Pieces put together: their word mark U+2581 is a space."""
    return F.ltrim(F.regexp_replace(F.array_join(F.transform(segment, lambda t: F.replace(t, F.lit(" "), F.lit(""))), ""), "▁", " "))


TOKENIZERS: dict[str, Callable[[], Callable[[Column], Column]]] = {
    "null": lambda: null_tokens,
    "line_segment": lambda: lines,
    "whitespace": lambda: whitespace,
    "latin": latin,
    "latin_sentence": lambda: _tokenizer_udf(sentence_ranges),
    "zwsp": lambda: _tokenizer_udf(zwsp_ranges),
}
DETOKENIZERS: dict[str, Callable[[], Callable[[Column], Column]]] = {
    "whitespace": lambda: whitespace_joined,
    "latin": lambda: _join_udf(latin_join),
    "zwsp": lambda: _join_udf(zwsp_join),
    "sentencepiece": lambda: sentencepiece_joined,
}


def tokenizer(kind: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A tokenizer by name, or the function itself: text column to array of tokens."""
    return TOKENIZERS[kind]() if isinstance(kind, str) else kind


def detokenizer(kind: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    return DETOKENIZERS[kind]() if isinstance(kind, str) else kind
