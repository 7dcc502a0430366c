"""Every best alignment, against brute force over all alignments."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from segmill.operators import sequences as sq


def every_alignment(x, y, scores):
    """(score, columns) of all global alignments of two sequences."""
    if not x and not y:
        yield 0, ()
    for a, b in itertools.product((0, 1, 2), repeat=2):
        if a <= len(x) and b <= len(y) and (a or b):
            for da, db, score in scores.moves(x, y, len(x), len(y)):
                if (da, db) == (a, b):
                    for rest, columns in every_alignment(x[: len(x) - a], y[: len(y) - b], scores):
                        yield rest + score, (*columns, (" ".join(x[len(x) - a :]), " ".join(y[len(y) - b :])))


@pytest.mark.parametrize("scores", [sq.Scores(), sq.Scores(mismatch=-50)])
def test_all_best_alignments(spark, scores):
    rng = random.Random(5)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 4))], [rng.choice("abc") for _ in range(rng.randint(0, 4))]) for _ in range(40)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i int, x array<string>, y array<string>")
    found = df.select("i", sq.all_aligned(F.col("x"), F.col("y"), "global", scores, 10_000).alias("r"), sq.aligned(F.col("x"), F.col("y"), "global", scores)["score"].alias("one")).collect()
    for r in found:
        every = list(every_alignment(*pairs[r.i], scores))
        top = max(s for s, _ in every)
        got = [tuple((c.a, c.b) for c in one) for one in r.r.alignments]
        assert r.r.score == r.one == top and len(got) == len(set(got)) and set(got) == {c for s, c in every if s == top}


@pytest.mark.parametrize("mode", sq.MODES)
def test_best_alignments_score_alike_in_every_mode(mode):
    rng = random.Random(6)
    for _ in range(60):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 6))] for _ in range(2))
        total, found = sq.best_alignments(x, y, mode, sq.Scores(), 50)
        assert total == sq.align_pair(x, y, mode, sq.Scores())[0] and found


def test_fuzzy_alignment(spark):
    from segmill.operators import word_alignment as wa

    rows = [(1, "the house is small".split(), "das haus ist klein".split()), (2, "small is the house".split(), "das haus ist klein".split()), (3, "the big house".split(), "das haus".split()), (4, [], ["x"]), (5, ["x"], ["x"])]
    lexicon = [("the", "das", 0.8), ("house", "haus", 0.9), ("is", "ist", 0.9), ("small", "klein", 0.7), ("NULL", "ist", 0.05), ("big", "haus", 0.05)]
    bitext = spark.createDataFrame(rows, "row_ord long, source_segment array<string>, target_segment array<string>")
    table = spark.createDataFrame(lexicon, "source string, target string, probability double")
    found = {r.row_ord: {(p.source_index, p.target_index) for p in r.pairs} for r in wa.fuzzy_alignment(bitext, table).collect()}
    assert found[1] == {(i, i) for i in range(4)} and found[5] == {(0, 0)} and 4 not in found
    assert {(0, 0), (2, 1)} <= found[3] and {(2, 0), (3, 1)} <= found[2]


def test_fuzzy_pairs_take_likelier_neighbours():
    import numpy as np

    from segmill.operators import word_alignment as wa

    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = rng.integers(1, 7, 2)
        p = rng.random((n + 1, m + 1)) * (rng.random((n + 1, m + 1)) < 0.5)
        found = wa.fuzzy_pairs([f"s{i}" for i in range(n)], [f"t{j}" for j in range(m)], p)
        assert all(0 <= i < n and 0 <= j < m for i, j in found)
        certain = np.zeros((n + 1, m + 1))
        certain[1:, 1:] = np.eye(n, m)
        assert wa.fuzzy_pairs([f"s{i}" for i in range(n)], [f"t{j}" for j in range(m)], certain) >= {(i, i) for i in range(min(n, m))}
