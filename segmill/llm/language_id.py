"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises all its
substrings.  A text is parsed by each automaton into phrases, each the longest
match from where the one before it ended; text like the training text has long
matches and few phrases.  A phrase is named by its place in the training text,
so phrases times the bits of such a place is what the text costs in a language,
with a byte's eight more where the training text lacks it, and models of different
sizes compare.  The cheapest language wins.

Texts are lower-cased and parsed as UTF-8, with one space for each run of what
separates words, so every script counts in full.  Parsing is one walk through a
table: a byte that the automaton cannot follow ends the phrase and starts the
next.  All texts of a batch walk together, each from its start to its end; the
few longest are finished one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.llm.common import documents, shared_table, text_of

#: The sample of labelled rows that is learned from: so many rows of a language at most, and as many of
#: these, whole, as fit so many bytes, a language and together.
TRAIN_ROWS, TRAIN_BYTES_LANGUAGE, TRAIN_BYTES = 200, 40_000, 240_000
#: The sample is found in so many parts of a language first.
PARTS = 64
#: Up to so many rows the sample's keys go to every task; with more, of some hundred languages, texts are joined by sorting.
SAMPLE_ROWS = 100_000
#: Texts that walk together, and the number below which the rest is finished one by one.
LANES, FEW = 4096, 64
#: What separates words: white space, digits, marks of ASCII and Latin-1, general, CJK and full-width punctuation.
APART = re.compile("[\\s\\d!-/:-@\\[-`{-~\xa1-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20]+")


def plain(text: str) -> bytes:
    """What is parsed of a text."""
    return APART.sub(" ", text.lower()).encode("utf-8")


class SuffixAutomaton:
    """All substrings of a sequence of small codes, built online."""

    def __init__(self, codes: np.ndarray):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes.tolist():
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p != -1:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def table(self, codes: int) -> np.ndarray:
        """int32[(states + 1) * codes]: where the next state's row starts; its complement if a phrase starts there.

        The last row is for what lies between phrases: before the text, and
        after a code that the sequence lacks, which is a phrase of its own.
        """
        out = np.zeros((len(self.next) + 1, codes), np.int32)
        for state, edges in enumerate(self.next):
            out[state, list(edges)] = list(edges.values())
        anew = np.where(out[0] > 0, out[0], len(self.next)) * codes
        return np.where(out > 0, out * codes, ~anew[None, :]).astype(np.int32).ravel()  # the last row is empty: all starts anew


class Parser:
    """Counts the phrases of texts in one language, and of these the bytes that its training text lacks, which share a code."""

    def __init__(self, text: bytes):
        own = np.unique(np.frombuffer(text, np.uint8))
        self.code = np.zeros(256, np.uint8)
        self.code[own] = np.arange(len(own)) + 1
        self.codes = len(own) + 1
        self.table = SuffixAutomaton(self.code[np.frombuffer(text, np.uint8)]).table(self.codes)
        self.start = len(self.table) - self.codes
        self.bits = np.log2(len(text) + 1)

    def strange(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        so_far = np.zeros(len(flat) + 1, np.int32)
        np.cumsum(self.code[flat] == 0, dtype=np.int32, out=so_far[1:])
        return so_far[starts + sizes] - so_far[starts]

    def phrases(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts that lie in flat, longest first."""
        codes, table = self.code[flat], self.table
        state, begun = np.full(len(starts), self.start, np.int32), np.zeros(len(starts), np.int64)
        together = int(sizes[FEW - 1]) if len(sizes) >= FEW else 0
        live = np.searchsorted(-sizes, -np.arange(together), side="left")  # texts longer than each step
        for step in range(together):
            n = live[step]
            to = table[state[:n] + codes[starts[:n] + step]]
            again = to < 0
            begun[:n] += again
            state[:n] = to ^ -again.astype(np.int32)
        walk = memoryview(table)
        for i in range(int(np.searchsorted(-sizes, -together, side="left"))):
            at, more = int(state[i]), 0
            for code in codes[starts[i] + together : starts[i] + sizes[i]].tobytes():
                at = walk[at + code]
                if at < 0:
                    at, more = ~at, more + 1
            begun[i] += more
        return begun


class Model:
    """languages, and a parser for each.

    It travels as its training text, which is some thousandths of its tables;
    a Python worker makes those once.
    """

    def __init__(self, texts: dict[str, bytes]):
        self.texts = texts
        self.languages = sorted(texts)
        self.parsers = [Parser(texts[name]) for name in self.languages]

    def __reduce__(self):
        return _made, (tuple(sorted(self.texts.items())),)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """int64[texts, languages]: phrases of each text in each language, and of these the bytes that are strange to it."""
        found, strange = np.zeros((2, len(texts), len(self.parsers)), np.int64)
        for at in range(0, len(texts), LANES):
            raw = [plain(t) for t in texts[at : at + LANES]]
            sizes = np.array([len(r) for r in raw])
            order = np.argsort(-sizes, kind="stable")
            flat, starts = np.frombuffer(b"".join(raw), np.uint8), (np.cumsum(sizes) - sizes)[order]
            for k, parser in enumerate(self.parsers):
                found[at + order, k] = parser.phrases(flat, starts, sizes[order])
                strange[at + order, k] = parser.strange(flat, starts, sizes[order])
        return found, strange

    def costs(self, texts: list[str]) -> np.ndarray:
        """float[texts, languages]: bits of each text in each language."""
        phrases, strange = self.phrases(texts)
        return phrases * np.array([p.bits for p in self.parsers]) + 8 * strange


@lru_cache(maxsize=2)
def _made(texts: tuple[tuple[str, bytes], ...]) -> Model:
    return Model(dict(texts))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, each: int = TRAIN_BYTES_LANGUAGE, total: int = TRAIN_BYTES) -> Model | None:
    """A model of the labelled rows of docs (text, lang); None if there are none.

    The sample is bounded: of each language the `rows` different texts first in
    a hash order, and of these, in that order, each one that still fits into
    `each` bytes, or into its language's part of `total` where there are many
    languages; the shortest if none does.  Texts are taken whole.
    """
    text = F.xxhash64("text", F.lit(7))
    labelled = docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    keys = labelled.select("lang", text.alias("key")).distinct()  # texts are not moved to find the sample
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("key"))
    some = keys.withColumn("part", F.pmod("key", F.lit(PARTS))).withColumn("nth", first("lang", "part")).filter(F.col("nth") <= rows)
    some = some.withColumn("nth", first("lang")).filter(F.col("nth") <= rows).select("lang", "nth", "key")
    some = shared_table(some, "language-keys")
    some = some.hint("broadcast" if some.count() <= SAMPLE_ROWS else "merge")
    sample = labelled.withColumn("key", text).join(some, ["lang", "key"]).groupBy("lang", "nth").agg(F.min("text").alias("text"))
    sample = shared_table(sample, "language-sample")
    sizes = sample.select("lang", "nth", F.octet_length("text").alias("size")).collect()  # bounded, see above
    by_language: dict[str, list] = {}
    for row in sorted(sizes, key=lambda r: (r.lang, r.nth)):
        by_language.setdefault(row.lang, []).append(row)
    if not by_language:
        return None
    each, chosen = min(each, total // len(by_language)), []
    for rows_ in by_language.values():
        left, fit = each, []
        for row in rows_:
            if row["size"] <= left:
                fit, left = [*fit, row], left - row["size"]
        chosen += [(r.lang, r.nth) for r in fit or [min(rows_, key=lambda r: r["size"])]]
    wanted = docs.sparkSession.createDataFrame(chosen, "lang string, nth int")
    texts: dict[str, list[str]] = {}
    for row in sorted(sample.join(wanted, ["lang", "nth"]).collect(), key=lambda r: (r.lang, r.nth)):
        texts.setdefault(row.lang, []).append(row.text)
    return Model({name: plain("\n".join(parts)) for name, parts in texts.items()})


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs, by its whole text.

    `und` with score 0 where the text is null or has no letter, and everywhere
    without a model.  Ties go to the language first in order.  The score is how
    far the best language's cost falls below the second's, times three, at most
    1; with one language it is 1.  Repeated rows are judged alike.  An empty
    table gives an empty one.  Other columns of docs are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if known is not None:
                costs = known.costs(texts)
                ranked, best = np.sort(costs, 1), costs.argmin(1)
                for i, text in enumerate(texts):
                    if any(map(str.isalpha, text)):
                        names[i] = known.languages[best[i]]
                        scores[i] = min(1.0, 3 * float(1 - ranked[i, 0] / max(1e-9, ranked[i, 1]))) if costs.shape[1] > 1 else 1.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(rows, "doc_id long, lang_pred string, score double")


#: Documents with this remainder are never learned from.
FOLDS, HELD_OUT = 4, 2


def fold_of(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.filter(fold_of(F.col("doc_id")) != HELD_OUT))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
