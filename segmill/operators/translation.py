"""Engines over corpora, word graphs and suggestions.

Decoders are not part of this library; anything that maps a list of segments to
a list of segments can be an engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from segmill.corpus import ParallelCorpus
from segmill.functions import characters as ch
from segmill.functions.text import LOG_ZERO
from segmill.functions.tokens import apart

BATCH = 1024


def translate(corpus: ParallelCorpus, engine: Callable[[], Callable[[list[list[str]]], list[list[str]]]], batch: int = BATCH) -> ParallelCorpus:
    """The corpus with target segments made by an engine from its source segments.

    engine() is called once a task and gives the function that translates a batch.
    """

    @pandas_udf("array<string>")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = engine()
        for segments in frames:
            rows = [list(s) for s in segments]
            yield pd.Series([t for i in range(0, len(rows), batch) for t in made(rows[i : i + batch])])

    return replace(corpus, df=corpus.df.withColumn("target_segment", apart(run)("source_segment")))


ARCS = "array<struct<prev:int,next:int,score:double>>"


def rest_scores(arcs: Column, finals: Column) -> Column:
    """array<double>: for each state of a word graph the score of the best way to a final state; arcs come in topological order."""

    @pandas_udf("array<double>")
    def run(graphs: pd.Series, ends: pd.Series) -> pd.Series:
        def of(graph, final):
            scores = np.full(1 + max([a["next"] for a in graph] + [a["prev"] for a in graph] + list(final), default=0), LOG_ZERO)
            scores[list(final)] = 0.0
            for a in reversed(list(graph)):
                scores[a["prev"]] = max(scores[a["prev"]], a["score"] + scores[a["next"]])
            return scores.tolist()

        return pd.Series([of(g, f) for g, f in zip(graphs, ends, strict=True)])

    return apart(run)(arcs, finals)


def best_path(arcs: Column, finals: Column) -> Column:
    """array<int>: the numbers of the arcs of the best way from state 0 to a final state; empty if there is none."""

    @pandas_udf("array<int>")
    def run(graphs: pd.Series, ends: pd.Series) -> pd.Series:
        def of(graph, final):
            best, came = {0: 0.0}, {}
            for i, a in enumerate(graph):
                if a["prev"] in best and best[a["prev"]] + a["score"] > best.get(a["next"], -np.inf):
                    best[a["next"]], came[a["next"]] = best[a["prev"]] + a["score"], i
            at = max((s for s in final if s in best), key=best.get, default=0)
            path = []
            while at in came:
                path.append(came[at])
                at = graph[came[at]]["prev"]
            return path[::-1]

        return pd.Series([of(list(g), f) for g, f in zip(graphs, ends, strict=True)])

    return apart(run)(arcs, finals)


def suggestion(tokens: Column, confidences: Column, prefix: Column, threshold: float = 0.2, stop_at_punctuation: bool = True) -> Column:
    """array<string>: the tokens behind a prefix of that many, up to the first of too little confidence, or the first mark."""
    sure = lambda i: F.get(confidences, i) >= threshold
    mark = lambda t: t.rlike(f"^{ch.category('P')}+$") if stop_at_punctuation else F.lit(False)
    state = F.struct(F.lit(True).alias("on"), F.expr("CAST(array() AS array<string>)").alias("out"))
    numbered = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def step(s: Column, x: Column) -> Column:
        on = s["on"] & sure(x["i"]) & ~mark(x["t"])
        return F.struct(on.alias("on"), F.when(on, F.concat(s["out"], F.array(x["t"]))).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.filter(numbered, lambda x: x["i"] >= prefix), state, step, lambda s: s["out"])


def translated_records(corpus: ParallelCorpus, corpus_id: str) -> DataFrame:
    """Parallel rows as records of pretranslations."""
    refs = lambda c: F.transform(c, lambda r: r.cast("string"))
    return corpus.df.select(
        F.lit(corpus_id).alias("corpusId"), F.col("text_id").cast("string").alias("textId"), refs("source_refs").alias("sourceRefs"), refs("target_refs").alias("targetRefs"), F.array_join("target_segment", " ").alias("translation"),
        F.col("source_segment").alias("sourceTokens"), F.col("target_segment").alias("translationTokens"),
    )
