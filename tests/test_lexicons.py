"""Lexicons by expectation maximization against the same done by pairs."""

import random
from collections import defaultdict
from math import exp

import pytest
from pyspark.sql import functions as F

from segmill.operators import word_alignment as wa


def trained(rows, iterations, diagonal):
    lexicon = None
    for _ in range(iterations):
        counts = defaultdict(float)
        for _, source, target in rows:
            for j, t in enumerate(target):
                off = [exp(-(diagonal or 0) * abs((i + 1) / len(source) - (j + 1) / len(target))) for i in range(len(source))]
                prior = [1.0] * (len(source) + 1) if diagonal is None else [0.08, *(0.92 * x / sum(off) for x in off)]
                share = [p * (lexicon[s, t] if lexicon else 1) for p, s in zip(prior, ["NULL", *source], strict=True)]
                for s, x in zip(["NULL", *source], share, strict=True):
                    counts[s, t] += x / sum(share)
        sums = defaultdict(float)
        for (s, _), c in counts.items():
            sums[s] += c
        lexicon = {(s, t): c / sums[s] for (s, t), c in counts.items()}
    return lexicon


@pytest.mark.parametrize(("iterations", "diagonal"), [(1, None), (3, 4.0), (3, None), (2, 0.0)])
def test_rounds_by_blocks(spark, iterations, diagonal):
    draw = random.Random(iterations)
    rows = [(k, *([draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))] for _ in range(2))) for k in range(60)]
    df = spark.createDataFrame([*rows, (99, [], ["a"])], "row_ord long, source_segment array<string>, target_segment array<string>")
    wanted = trained(rows, iterations, diagonal)
    lexicon = wa.ibm1(df, iterations, diagonal=diagonal)
    found = {(r.source, r.target): r.probability for r in lexicon.collect()}
    assert found.keys() == wanted.keys() and all(abs(found[x] - p) < 1e-12 for x, p in wanted.items())
    assert "source" not in lexicon._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]  # pairs don't travel behind the rounds
    best = {r.row_ord: r.best for r in wa.best_words(df, iterations, diagonal=diagonal).select("row_ord", F.col("best")).collect()}
    for k, source, target in rows:
        held = [max(wanted[s, t] for s in ["NULL", *source]) for t in target]
        assert [round(x.probability, 12) for x in best[k]] == [round(p, 12) for p in held]
        assert all(abs(wanted[["NULL", *source][x.i + 1], t] - p) < 1e-12 for x, t, p in zip(best[k], target, held, strict=True))
