"""Word alignments: matrices as arrays of pairs, symmetrization, scores, and training from bitexts.

Pairs are array<struct<source_index, target_index, ...>>; an index of -1 stands
for no word, and such pairs take no part in matrix operations.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from segmill.checkpoints import cut
from segmill.functions.tokens import apart, packed
from segmill.operators.sequences import best_alignments

HEURISTICS = ("none", "union", "intersection", "och", "priority", "grow", "grow_diag", "grow_diag_final", "grow_diag_final_and")
CELL = "array<struct<source_index:int,target_index:int>>"


def cells(pairs: Column) -> Column:
    """The matrix of pairs: distinct (source_index, target_index) without nulls, by row and column."""
    real = F.filter(pairs, lambda p: (p["source_index"] >= 0) & (p["target_index"] >= 0))
    return F.sort_array(F.array_distinct(F.transform(real, lambda p: F.struct(p["source_index"].cast("int").alias("source_index"), p["target_index"].cast("int").alias("target_index")))))


def union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(cells(a), cells(b)))


def intersection(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(cells(a), cells(b)))


def transpose(pairs: Column) -> Column:
    return F.sort_array(F.transform(cells(pairs), lambda p: F.struct(p["target_index"].alias("source_index"), p["source_index"].alias("target_index"))))


def with_nulls(pairs: Column, n_source: Column, n_target: Column) -> Column:
    """Pairs with one of index -1 for every word that has none; those of target words come first."""
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))
    found = cells(pairs)
    missing = lambda n, side: F.array_except(numbers(n), F.transform(found, lambda p: p[side]))
    targets = F.transform(missing(n_target, "target_index"), lambda j: F.struct(F.lit(-1).alias("source_index"), j.alias("target_index")))
    sources = F.transform(missing(n_source, "source_index"), lambda i: F.struct(i.alias("source_index"), F.lit(-1).alias("target_index")))
    return F.concat(targets, F.sort_array(F.concat(found, sources)))


def _near(pair: tuple[int, int], have: set, steps: list[tuple[int, int]]) -> bool:
    return any((pair[0] + a, pair[1] + b) in have for a, b in steps)


ROW_STEPS, COLUMN_STEPS = [(0, -1), (0, 1)], [(-1, 0), (1, 0)]
CORNER_STEPS = [(a, b) for a in (-1, 1) for b in (-1, 1)]


def symmetrized(forward: set, backward: set, heuristic: str) -> set:
    """One matrix of two, by a heuristic of growing from what both have.

    och and priority add, over and over in order, pairs of two free words and
    pairs beside an alignment in the same row or column (priority: in just one
    of them, starting from forward itself).  The grow family asks that one word
    is free; final adds at the end pairs with a free word, final_and of two.
    """
    if heuristic == "none":
        return set(forward)
    if heuristic == "union":
        return forward | backward
    if heuristic == "intersection":
        return forward & backward
    have = set(forward) if heuristic == "priority" else forward & backward
    rows, columns = {i for i, _ in have}, {j for _, j in have}

    def add(pair: tuple[int, int]) -> None:
        have.add(pair)
        rows.add(pair[0])
        columns.add(pair[1])

    block = lambda p: _near(p, have, ROW_STEPS + COLUMN_STEPS)
    if heuristic in ("och", "priority"):
        fits: Callable = block if heuristic == "och" else lambda p: _near(p, have, ROW_STEPS) != _near(p, have, COLUMN_STEPS)
        allowed = lambda p: (p[0] not in rows and p[1] not in columns) or fits(p)
    else:
        fits = block if heuristic == "grow" else lambda p: _near(p, have, ROW_STEPS + COLUMN_STEPS + CORNER_STEPS)
        allowed = lambda p: (p[0] not in rows or p[1] not in columns) and fits(p)
    waiting = sorted((forward | backward) - have)
    while True:
        before = len(have)
        for pair in waiting:
            if allowed(pair):
                add(pair)
        if len(have) == before:
            break
        waiting = [p for p in waiting if p not in have]
    if "final" in heuristic:
        for side in (forward, backward):
            for i, j in sorted(side - have):
                free = (i not in rows, j not in columns)
                if all(free) if heuristic.endswith("and") else any(free):
                    add((i, j))
    return have


def symmetrize(forward: Column, backward: Column, heuristic: str = "och") -> Column:
    """Both columns as source-target pairs (transpose() an inverse alignment first)."""
    if heuristic not in HEURISTICS:
        raise ValueError(f"unknown heuristic {heuristic!r}")
    if heuristic == "none":
        return cells(forward)
    if heuristic == "union":
        return union(forward, backward)
    if heuristic == "intersection":
        return intersection(forward, backward)

    @pandas_udf(CELL)
    def grow(a: pd.Series, b: pd.Series) -> pd.Series:
        read = lambda x: {(p["source_index"], p["target_index"]) for p in x}
        rows = [sorted(symmetrized(read(x), read(y), heuristic)) for x, y in zip(a, b, strict=True)]
        return pd.Series([[{"source_index": i, "target_index": j} for i, j in r] for r in rows])

    return apart(grow)(cells(F.coalesce(forward, F.expr(f"CAST(array() AS {CELL})"))), cells(F.coalesce(backward, F.expr(f"CAST(array() AS {CELL})"))))


def align_both_ways(corpus: DataFrame, forward: DataFrame, backward: DataFrame, heuristic: str = "grow_diag_final_and", keys: tuple[str, ...] = ("text_id", "ref")) -> DataFrame:
    """corpus with pairs from a source-target and a target-source alignment (keys, pairs).

    Pairs that a row has already are kept and extended by the priority heuristic.
    """
    joined = corpus.join(forward.select(*keys, F.col("pairs").alias("__f")), list(keys), "left").join(backward.select(*keys, transpose(F.col("pairs")).alias("__b")), list(keys), "left")
    found = joined.withColumn("__pairs", symmetrize(F.col("__f"), F.col("__b"), heuristic))
    known = F.size(F.coalesce("pairs", F.expr(f"CAST(array() AS {CELL})"))) > 0
    return found.withColumn("pairs", F.when(known, symmetrize(F.col("pairs"), F.col("__pairs"), "priority")).otherwise(F.col("__pairs"))).drop("__f", "__b", "__pairs")


def to_giza(source: Column, target: Column, pairs: Column) -> Column:
    """Two lines: the target, and each source word (NULL first) with the target words, from 1, that it is aligned to."""
    found = cells(pairs)
    written = lambda js: F.when(F.size(js) > 0, F.concat(F.array_join(F.transform(js, lambda j: (j + 1).cast("string")), " "), F.lit(" "))).otherwise(F.lit(""))
    item = lambda word, js: F.concat(word, F.lit(" ({ "), written(js), F.lit("})"))
    numbers = F.when(F.size(target) > 0, F.sequence(F.lit(0), F.size(target) - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))
    free = F.array_except(numbers, F.transform(found, lambda p: p["target_index"]))
    words = F.transform(source, lambda w, i: item(w, F.transform(F.filter(found, lambda p: p["source_index"] == i), lambda p: p["target_index"])))
    return F.concat(F.array_join(target, " "), F.lit("\n"), F.array_join(F.concat(F.array(item(F.lit("NULL"), free)), words), " "), F.lit("\n"))


# --- lexicons ----------------------------------------------------------------------

NULL_WORD = "NULL"


def cooccurrences(bitext: DataFrame, key: str = "row_ord") -> DataFrame:
    """row, j, target, i, source: every target word beside every source word of its row, and NULL (i = -1)."""
    source = F.concat(F.array(F.lit(NULL_WORD)), "source_segment")
    full = bitext.where((F.size("source_segment") > 0) & (F.size("target_segment") > 0))
    targets = full.select(F.col(key).alias("row"), source.alias("__source"), F.size("source_segment").alias("m"), F.size("target_segment").alias("n"), F.posexplode("target_segment").alias("j", "target"))
    return targets.select("row", "m", "n", "j", "target", F.posexplode("__source").alias("__i", "source")).withColumn("i", F.col("__i") - 1).drop("__i")


#: Pairs of words that a task weighs at once, more only where one source word has more.
AT_ONCE = 1_000_000


def _blocks(bitext: DataFrame, key: str, totals: list[DataFrame]) -> DataFrame:
    """The rows of a bitext for each block of source words: row, m, target, words, places (-1 is NULL), and the totals of earlier rounds.

    A source word's block follows from the word, so all that is known of a word is in
    one task, and words travel by the segment, not by the pair.
    """
    spark = bitext.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2, spark.sparkContext.defaultParallelism))  # segments travel once a block
    full = bitext.where((F.size("source_segment") > 0) & (F.size("target_segment") > 0))
    source = F.concat(F.array(F.lit(NULL_WORD)), "source_segment")
    rows = full.select(F.col(key).alias("row"), F.size("source_segment").alias("m"), packed(F.col("target_segment")).alias("target"), F.transform(source, lambda w, i: F.struct(F.pmod(F.xxhash64(w), F.lit(n)).cast("int").alias("block"), (i - 1).alias("i"), w.alias("word"))).alias("held"))
    for k, found in enumerate(totals):
        rows = rows.join(found.select("row", F.col("total").alias(f"total{k}")), "row")
    each = rows.withColumn("block", F.explode(F.array_distinct("held.block"))).withColumn("held", F.filter("held", lambda x: x["block"] == F.col("block")))
    return each.select("block", "row", "m", "target", packed(F.col("held.word")).alias("words"), F.col("held.i").alias("places"), *[f"total{k}" for k in range(len(totals))]).repartitionById(n, "block")


def _unpacked(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All tokens of packed segments as a dictionary array, and how many each segment has."""
    lists = pc.split_pattern(column.combine_chunks(), "\x01")
    words = lists.flatten()
    for old, new in (("\x02a", "\x01"), ("\x02b", "\x02")):
        words = pc.replace_substring(words, old, new)
    return words.dictionary_encode(), np.diff(lists.offsets.to_numpy()).astype(np.int64)


class _Rounds:
    """Rounds of expectation maximization over a block, some source words after the other.

    What a word's pairs have after a round follows from the totals of the round before, one for each target word of a row;
    so rounds are worked out again from the first one, and no lexicon is kept between them.
    """

    def __init__(self, table: pa.Table, diagonal: float | None, null_share: float):
        self.row = table["row"].combine_chunks()
        words, self.n = _unpacked(table["target"])
        self.targets, self.target = words.dictionary, words.indices.to_numpy()
        self.first = np.cumsum(self.n) - self.n
        words, k = _unpacked(table["words"])
        self.sources, source = words.dictionary, words.indices.to_numpy().astype(np.int64)
        order = np.argsort(source, kind="stable")
        self.source, self.of, self.i = source[order], np.repeat(np.arange(len(k)), k)[order], table["places"].combine_chunks().flatten().to_numpy()[order]
        self.m = table["m"].to_numpy()
        of = np.repeat(np.arange(len(self.n)), self.n)
        self.j = (np.arange(len(of)) - self.first[of]).astype(np.int32)
        self.diagonal, self.null_share = diagonal, null_share
        self.totals = [table[c].combine_chunks().flatten().to_numpy() for c in table.column_names if c.startswith("total")]
        if diagonal:
            self.whole = self._whole(self.m[of], (self.j + 1) / self.n[of])
        elif diagonal is not None:
            self.whole = self.m[of].astype(float)

    def _whole(self, m: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The sum of exp(-diagonal * |x / m - y|) over x from 1 to m, as two geometric series."""
        q, k = np.exp(-self.diagonal / m), np.clip(np.floor(m * y), 0, m)
        return (np.exp(-self.diagonal * (y - k / m)) * (1 - q**k) + np.exp(-self.diagonal * ((k + 1) / m - y)) * (1 - q ** (m - k))) / (1 - q)

    def pairs(self) -> Iterator[tuple]:
        """at (of target words), i, pair, prior of pairs, source and target of those that differ, and their probabilities after the last round."""
        sizes = self.n[self.of]
        known, done = len(self.targets), np.cumsum(sizes)
        ends = np.flatnonzero(np.append(np.diff(self.source), 1)) + 1  # where a source word ends
        begin = 0
        while begin < len(self.source):
            limit = done[begin - 1] if begin else 0
            fits = ends[(ends > begin) & (done[ends - 1] - limit <= AT_ONCE)]
            stop = fits[-1] if len(fits) else ends[ends > begin][0]
            of, size = self.of[begin:stop], sizes[begin:stop]
            at = np.arange(size.sum()) + np.repeat(self.first[of] - (np.cumsum(size) - size), size)
            i, m = np.repeat(self.i[begin:stop], size), np.repeat(self.m[of], size)
            kinds, pair = np.unique(np.repeat(self.source[begin:stop], size) * known + self.target[at], return_inverse=True)
            prior = np.ones(len(at))
            if self.diagonal is not None:
                off = np.exp(-self.diagonal * np.abs((i + 1) / m - (self.j[at] + 1) / np.repeat(self.n[of], size)))
                prior = np.where(i < 0, self.null_share, (1 - self.null_share) * off / self.whole[at])
            source, target = kinds // known, kinds % known
            probability = np.ones(len(kinds))
            shares = 1.0 if self.diagonal is not None else m + 1.0  # of the first round, all priors of a row
            for total in (None, *self.totals):
                count = np.bincount(pair, prior * probability[pair] / (shares if total is None else total[at]), len(kinds))
                probability = count / np.bincount(source, count)[source]
            yield at, i, pair, prior, source, target, probability
            begin = stop


def _per_block(blocks: DataFrame, schema: str, diagonal: float | None, null_share: float, work: Callable[[_Rounds], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            yield from work(_Rounds(pa.Table.from_batches(held), diagonal, null_share))

    return blocks.mapInArrow(run, schema)


def _by_target(rounds: _Rounds, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """row and lists of what each of its target words has, some rows at a time."""
    offsets = np.append(rounds.first, len(rounds.target))
    for a in range(0, len(rounds.n), 4096):
        b = min(a + 4096, len(rounds.n))
        own = pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32))
        lists = {c: pa.ListArray.from_arrays(own, pa.array(v[offsets[a] : offsets[b]])) for c, v in columns.items()}
        yield pa.RecordBatch.from_pydict({"row": rounds.row[a:b]} | lists)


def _row_type(bitext: DataFrame, key: str) -> str:
    return dict(bitext.dtypes)[key]


def _totals(bitext: DataFrame, iterations: int, key: str, diagonal: float | None, null_share: float) -> list[DataFrame]:
    """row, total array<double> for each round from the second on: the sums of target words' shares over all source words of a row."""

    def weigh(rounds: _Rounds) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(rounds.target))
        for at, _, pair, prior, _, _, probability in rounds.pairs():
            total += np.bincount(at, prior * probability[pair], len(total))
        yield from _by_target(rounds, {"total": total})

    found: list[DataFrame] = []
    for _ in range(iterations - 1):
        parts = _per_block(_blocks(bitext, key, found), f"row {_row_type(bitext, key)}, total array<double>", diagonal, null_share, weigh)
        sums = F.aggregate(F.slice("__parts", F.lit(2), F.size("__parts")), F.get("__parts", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        found.append(cut(parts.groupBy("row").agg(F.array_sort(F.collect_list("total")).alias("__parts")).select("row", sums.alias("total"))))
    return found


def ibm1(bitext: DataFrame, iterations: int = 5, key: str = "row_ord", diagonal: float | None = None, null_share: float = 0.08) -> DataFrame:
    """source, target, probability: a lexicon by expectation maximization.

    Each round shares every target word among the source words of its row by
    their probabilities and adds the shares up.  With `diagonal`, a tension, a
    source word's share also falls with its distance from the diagonal, and NULL
    gets null_share (a fast reparameterization of the second model).
    """

    def lexicon(rounds: _Rounds) -> Iterator[pa.RecordBatch]:
        for *_, source, target, probability in rounds.pairs():
            for a in range(0, len(source), 100_000):
                b = slice(a, a + 100_000)
                yield pa.RecordBatch.from_pydict({"source": rounds.sources.take(pa.array(source[b])), "target": rounds.targets.take(pa.array(target[b])), "probability": pa.array(probability[b])})

    blocks = _blocks(bitext, key, _totals(bitext, iterations, key, diagonal, null_share))
    return _per_block(blocks, "source string, target string, probability double", diagonal, null_share, lexicon)


def best_words(bitext: DataFrame, iterations: int = 5, key: str = "row_ord", diagonal: float | None = None, null_share: float = 0.08) -> DataFrame:
    """key, best array<struct<probability, i>>: for every target word the likeliest source word of its row by the lexicon of ibm1(), NULL (-1) or else the first of equals."""

    def choose(rounds: _Rounds) -> Iterator[pa.RecordBatch]:
        best, rank = np.full(len(rounds.target), -1.0), np.full(len(rounds.target), np.iinfo(np.int32).min, np.int32)
        for at, i, pair, _, _, _, probability in rounds.pairs():
            p = probability[pair]
            before = best[at]
            np.maximum.at(best, at, p)
            rank[at[best[at] > before]] = np.iinfo(np.int32).min
            top = p == best[at]
            np.maximum.at(rank, at[top], (-i[top]).astype(np.int32))
        yield from _by_target(rounds, {"p": best, "r": rank})

    blocks = _blocks(bitext, key, _totals(bitext, iterations, key, diagonal, null_share))
    parts = _per_block(blocks, f"row {_row_type(bitext, key)}, p array<double>, r array<int>", diagonal, null_share, choose)
    held = parts.groupBy("row").agg(F.collect_list(F.zip_with("p", "r", lambda p, r: F.struct(p.alias("p"), r.alias("r")))).alias("__parts"))
    most = F.aggregate(F.slice("__parts", F.lit(2), F.size("__parts")), F.get("__parts", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: F.greatest(p, q)))
    return held.select(F.col("row").alias(key), F.transform(most, lambda x: F.struct(x["p"].alias("probability"), (-x["r"]).alias("i"))).alias("best"))


def best_pairs(best: Column) -> Column:
    """The pairs of target words and their best source words, without those of NULL."""
    return F.sort_array(F.filter(F.transform(best, lambda x, j: F.struct(x["i"].cast("int").alias("source_index"), j.cast("int").alias("target_index"))), lambda p: p["source_index"] >= 0))


def best_alignment(bitext: DataFrame, lexicon: DataFrame, key: str = "row_ord") -> DataFrame:
    """key, pairs: every target word with its likeliest source word (the first of equals), none if that is NULL."""
    scored = cooccurrences(bitext, key).join(lexicon, ["source", "target"], "left").withColumn("probability", F.coalesce("probability", F.lit(1e-12)))
    best = scored.groupBy("row", "j").agg(F.max(F.struct("probability", (-F.col("i")).alias("__i")))["__i"].alias("__i")).withColumn("i", -F.col("__i"))
    cell = F.struct(F.col("i").cast("int").alias("source_index"), F.col("j").cast("int").alias("target_index"))
    return best.groupBy(F.col("row").alias(key)).agg(F.sort_array(F.collect_list(F.when(F.col("i") >= 0, cell))).alias("pairs"))


def pair_scores(rows: DataFrame, lexicon: DataFrame, key: str = "row_ord") -> DataFrame:
    """key, source_index, target_index, translation_score, alignment_score of every pair, those with no word on one side too."""
    one = rows.select(key, "source_segment", "target_segment", F.explode("pairs").alias("p"))
    word = lambda segment, i: F.when(i < 0, F.lit(NULL_WORD)).otherwise(F.get(segment, i))
    flat = one.select(
        key, F.col("p.source_index").alias("source_index"), F.col("p.target_index").alias("target_index"), word(F.col("source_segment"), F.col("p.source_index")).alias("source"),
        word(F.col("target_segment"), F.col("p.target_index")).alias("target"), (1 / (F.size("source_segment") + 1)).alias("alignment_score"),
    )
    return flat.join(lexicon.withColumnRenamed("probability", "translation_score"), ["source", "target"], "left").select(
        key, "source_index", "target_index", F.coalesce("translation_score", F.lit(0.0)).alias("translation_score"), "alignment_score"
    )


def average_score(scores: DataFrame, key: str = "row_ord") -> DataFrame:
    return scores.groupBy(key).agg(F.avg("translation_score").alias("score"))


def word_confidences(rows: DataFrame, lexicon: DataFrame, key: str = "row_ord") -> DataFrame:
    """key, j, target, confidence: the highest probability of each target word under any source word of its row, or NULL."""
    return cooccurrences(rows, key).join(lexicon, ["source", "target"], "left").groupBy(F.col("row").alias(key), "j", "target").agg(F.coalesce(F.max("probability"), F.lit(0.0)).alias("confidence"))


def translation_table(lexicon: DataFrame, threshold: float = 0.0) -> DataFrame:
    return lexicon.where((F.col("source") != NULL_WORD) & (F.col("probability") > threshold))


def extract_phrases(rows: DataFrame, longest: int = 10) -> DataFrame:
    """source, target, n, probability of the phrase pairs that rows' alignments are consistent with; probability is n's share of its source."""

    @pandas_udf("array<struct<source:string,target:string>>")
    def consistent(source: pd.Series, target: pd.Series, pairs: pd.Series) -> pd.Series:
        def of(s, t, p):
            links = {(x["source_index"], x["target_index"]) for x in p}
            by_source, by_target = defaultdict(list), defaultdict(list)
            for i, j in links:
                by_source[i].append(j)
                by_target[j].append(i)
            spans, found = {j: (min(i), max(i)) for j, i in by_target.items()}, []
            for a in range(len(s)):
                low, high = len(t), -1  # of what the words from a on are aligned to
                for b in range(a, min(len(s), a + longest)):
                    if b in by_source:
                        low, high = min(low, *by_source[b]), max(high, *by_source[b])
                    if high < 0 or any(j in spans and (spans[j][0] < a or spans[j][1] > b) for j in range(low, high + 1)):
                        continue
                    first = low
                    while True:  # over free target words on either side
                        last = high
                        while last - first < longest and last < len(t):
                            found.append({"source": " ".join(s[a : b + 1]), "target": " ".join(t[first : last + 1])})
                            last += 1
                            if last in spans:
                                break
                        first -= 1
                        if first < 0 or first in spans:
                            break
            return found

        return pd.Series([of(list(s), list(t), p) for s, t, p in zip(source, target, pairs, strict=True)])

    phrases = rows.select(F.explode(apart(consistent)("source_segment", "target_segment", cells(F.col("pairs")))).alias("x")).groupBy("x.source", "x.target").agg(F.count(F.lit(1)).alias("n"))
    sums = phrases.groupBy("source").agg(F.sum("n").alias("__all"))
    return phrases.join(sums, "source").withColumn("probability", F.col("n") / F.col("__all")).drop("__all")


# --- alignment by edit distance ----------------------------------------------------------

# The scale of scores, the share that probability has in a choice, and how far it looks.
SCALE, ALPHA, REACH = 100_000, 0.2, 3


class _StepTables:
    """Scores of every step (source words, target words) of an alignment by its end, as one table a step."""

    def __init__(self, same: np.ndarray, p: np.ndarray):
        pair = np.pad(np.trunc(np.where(same, 1.0, p[1:, 1:]) * SCALE), ((1, 0), (1, 0)))
        alone = np.trunc(p * SCALE) - SCALE // 10
        beside = lambda rows, columns: (np.roll(pair, (rows[0], columns[0]), (0, 1)) + np.roll(pair, (rows[1], columns[1]), (0, 1))) // 2
        shape = pair.shape
        self.tables = {
            (1, 1): pair,
            (0, 1): np.broadcast_to(alone[:1, :], shape),
            (1, 2): beside((0, 0), (1, 0)),
            (1, 0): np.broadcast_to(alone[:, :1], shape),
            (2, 1): beside((1, 0), (0, 0)),
            (2, 2): beside((1, 0), (0, 1)),
        }

    def moves(self, x: list, y: list, i: int, j: int):
        for (rows, columns), table in self.tables.items():
            if i >= rows and j >= columns:
                yield rows, columns, int(table[i, j])


def fuzzy_pairs(source: list[str], target: list[str], p: np.ndarray) -> set[tuple[int, int]]:
    """(i, j) of words that belong together: where the best alignment has them, unless a near word is likelier.

    p has the probability of each pair, with a row and a column 0 for no word.  An
    alignment gives each target word a gap or a span of source words; all scores of words
    around them, of probability and nearness, are one matrix, of which each column's greatest counts if it beats
    the span's own.  Among equals the nearest before the span wins, then the nearest behind it.
    """
    n, m = len(source), len(target)
    same = np.array(source, object)[:, None] == np.array(target, object)[None, :]
    _, (columns, *_) = best_alignments(list(range(n)), list(range(m)), "global", _StepTables(same, p), 1)
    spans = [tuple([int(v) for v in side.split()] for side in (left, right)) for left, right in columns]
    first, last, own = np.zeros(m, int), np.zeros(m, int), np.zeros(m)
    gap = np.zeros(m, bool)
    at = 0
    for words, targets in spans:
        for j in targets:  # a gap lies between the last word and the next
            first[j], last[j], gap[j] = (words[0], words[-1], False) if words else (at + 1, at, True)
            own[j] = p[[i + 1 for i in words], j + 1].mean() if words else p[0, j + 1]
        at = words[-1] if words else at
    log = lambda v: np.where(v > 0, np.log(np.maximum(v, 1e-300)), -999999999.0)
    i = np.arange(n)[:, None]
    before, behind = first - i, i - last  # steps from the span
    band = ((before >= 1) & (before <= REACH + 1)) | ((behind >= 1) & (behind <= REACH))
    far = np.full((n, m), 0.1) if n == 1 else np.minimum(1.0, np.where(before >= 1, before, behind) / (n - 1))
    score = np.where(band, ALPHA * log(p[1:, 1:]) + (1 - ALPHA) * log(1 - far), -np.inf)
    rank = np.where(before >= 1, before, REACH + 1 + behind)
    best = score.max(0)
    chosen = np.where(score == best, rank, n + 3 * REACH).argmin(0)
    better = best > ALPHA * log(own)
    found = {(int(chosen[j]), int(j)) for j in np.flatnonzero(better)}
    rest = np.flatnonzero(~better & ~gap)
    return found | {(int(k), int(j)) for j in rest for k in (first[j], last[j])}


def fuzzy_alignment(bitext: DataFrame, lexicon: DataFrame, key: str = "row_ord") -> DataFrame:
    """key, pairs of each row whose segments both have words, by edit distance over a lexicon (source, target, probability)."""
    full = bitext.where((F.size("source_segment") > 0) & (F.size("target_segment") > 0)).select(F.col(key).alias("row"), "source_segment", "target_segment")
    known = cooccurrences(bitext, key).join(lexicon, ["source", "target"])
    cells_ = known.groupBy("row").agg(F.collect_list(F.struct("i", "j", "probability")).alias("known"))

    @pandas_udf(CELL)
    def align(sources: pd.Series, targets: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for s, t, cells in zip(sources, targets, known, strict=True):
            p = np.zeros((len(s) + 1, len(t) + 1))
            for c in cells if cells is not None else ():
                p[c["i"] + 1, c["j"] + 1] = c["probability"]
            out.append([{"source_index": i, "target_index": j} for i, j in sorted(fuzzy_pairs(list(s), list(t), p))])
        return pd.Series(out)

    joined = full.join(cells_, "row", "left")
    return joined.select(F.col("row").alias(key), apart(align)("source_segment", "target_segment", "known").alias("pairs"))
