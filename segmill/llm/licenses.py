"""Licence scans: notice phrases, identifier tags and licence expressions.

An Aho-Corasick automaton over the words of a text, joined by single spaces,
finds all phrases in one pass.  Where it meets an identifier tag, the
expression behind the tag is read from the text itself by a shunting-yard
parser, which evaluates `or`, `and` and `with` in that order of binding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm.common import documents, text_of

#: Phrases whose places are reported.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases that only add labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons": "cc",
    "isc license": "isc",
    "permission to use copy modify and distribute this software": "isc",
    "permission to use copy modify and or distribute this software": "isc",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "zlib license": "zlib",
    "python software foundation license": "psf",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "server side public license": "sspl",
    "open software license": "osl",
    "academic free license": "afl",
    "this is free and unencumbered software": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: Families of identifiers, by their first part.
FAMILIES = ("mit", "apache", "gpl", "lgpl", "agpl", "bsd", "mpl", "epl", "cc", "cc0", "isc", "unlicense", "zlib", "bsl", "artistic", "psf", "cddl", "eupl", "sspl", "osl", "afl", "wtfpl")
PERMISSIVE = {"mit", "apache", "bsd", "isc", "zlib", "unlicense", "cc0", "bsl", "artistic", "psf", "afl", "wtfpl"}
#: Bytes of words as they are, A-Z lower-cased, all others as a space.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
BINDING = {"or": 1, "and": 2, "with": 3}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def family(identifier: str) -> str:
    """The label of an identifier: its family, else itself."""
    name = identifier.lower().rstrip("+")
    first = re.split(r"[-.]", name, maxsplit=1)[0]
    return first if first in FAMILIES else name


def parse(expression: str) -> tuple[list[str], bool]:
    """(postfix, whole): an expression up to where it stops being one.

    Operands and operators take turns; reading ends at what does not fit.
    whole tells that it ended after an operand with all brackets closed.
    """
    out, stack, operand = [], [], True
    for token in re.findall(r"[()]|[A-Za-z0-9.+-]+|[^\s]", expression):
        word = token.lower()
        if operand and token == "(":
            stack.append(token)
        elif operand and re.fullmatch(r"[A-Za-z0-9.+-]+", token) and word not in BINDING:
            out.append(token)
            operand = False
        elif not operand and token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif not operand and word in BINDING:
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            break
    whole = bool(out) and not operand and "(" not in stack
    if operand and stack and stack[-1] in BINDING:  # an operator without its right side
        stack.pop()
    out += [t for t in reversed(stack) if t != "("]
    return out, whole


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """(labels, permissive): all families named, and whether permissive licences can meet it.

    `or` is met by either side, `and` by both, and `with` adds an exception to
    the licence on its left.
    """
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in BINDING and len(stack) > 1:
            (right, ok_right), (left, ok_left) = stack.pop(), stack.pop()
            stack.append((left, ok_left) if token == "with" else (left | right, ok_left or ok_right if token == "or" else ok_left and ok_right))
        else:
            label = family(token)
            stack.append(({label}, label in PERMISSIVE))
    return (set().union(*(x for x, _ in stack)), all(ok for _, ok in stack)) if stack else (set(), False)


TAGGED = re.compile(r"spdx[^A-Za-z0-9\x80-\U0010ffff]+license[^A-Za-z0-9\x80-\U0010ffff]+identifier[^A-Za-z0-9\x80-\U0010ffff(\n]*([^\n]*)", re.ASCII | re.IGNORECASE)


def scan_text(text: str, machine) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive."""
    words = text.encode("utf-8").translate(WORD_BYTES).split()
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8")
    hits = list(machine.iter(joined))
    if not hits:
        return len(words), 0, None, None, "", "", 0.0, [], None
    starts, base, labels, weight, expressions, allowed = [], set(), set(), 0, [], []
    for end, phrase in hits:
        if phrase in BASE:
            starts.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
        if phrase == TAG:
            continue
        labels.add(BASE.get(phrase) or NOTICES[phrase])
        weight += 1
    if any(phrase == TAG for _, phrase in hits):
        for m in TAGGED.finditer(text):
            postfix, whole = parse(m[1])
            named, ok = evaluate(postfix)
            if named:
                labels |= named
                expressions.append(" ".join(postfix))
                allowed.append(ok)
                weight += 4 if whole else 2
    at = None
    if starts:
        spaces = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32)  # word i follows space i
        at = [int(np.searchsorted(spaces, s)) for s in (min(starts), max(starts))]
    return len(words), len(starts), at[0] if at else None, at[1] if at else None, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - 0.5**weight, expressions, all(allowed) if allowed else None


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, what scan_text() finds in its whole text.

    A null text is an empty one and has no labels (empty strings, score 0).
    score is 1 - 0.5 ** evidence: a phrase counts 1, an expression 2, or 4 if
    well formed.  Repeated rows are scanned each.  An empty table gives an empty
    one.  Other columns of docs are not looked at.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive"]
        for batch in batches:
            found = [scan_text(t, machine) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(rows, SCHEMA)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("expressions", "permissive")
