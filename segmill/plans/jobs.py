"""Batch jobs from files to files."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from segmill.operators import rows as ro
from segmill.operators import word_alignment as wa
from segmill.sources import files


@dataclass(frozen=True)
class AlignmentOptions:
    """What an alignment job may be told; anything else is an error."""

    iterations: int = 5
    diagonal: float | None = 4.0
    heuristic: str = "grow_diag_final_and"
    tokenizer: str = "latin"

    @classmethod
    def of(cls, given: dict) -> AlignmentOptions:
        known = {f.name for f in fields(cls)}
        if extra := set(given) - known:
            raise ValueError(f"unknown options: {sorted(extra)}")
        made = cls(**given)
        if made.heuristic not in wa.HEURISTICS or made.iterations < 1:
            raise ValueError("invalid heuristic or number of iterations")
        return made


def align_files(spark: SparkSession, source: str, target: str, out: str, options: dict | None = None) -> None:
    """Align the words of two sets of line files, both ways and symmetrized, and write records (refs, tokens, alignment) to out."""
    asked = AlignmentOptions.of(options or {})
    rows = files.read_text(spark, source).align_rows(files.read_text(spark, target)).tokenize(asked.tokenizer).lowercase().filter_nonempty().df
    rows = rows.withColumn("row_ord", F.xxhash64("text_id", F.to_json("ref"))).drop("pairs")
    turned = rows.select("row_ord", F.col("target_segment").alias("source_segment"), F.col("source_segment").alias("target_segment"))
    ways = {}
    for name, bitext in (("forward", rows), ("backward", turned)):
        ways[name] = wa.best_alignment(bitext, wa.ibm1(bitext, asked.iterations, diagonal=asked.diagonal))
    base = rows.withColumn("pairs", F.expr(f"CAST(NULL AS array<{'struct<source_index:int,target_index:int>'}>)"))
    found = wa.align_both_ways(base, ways["forward"], ways["backward"], asked.heuristic, ("row_ord",))
    text = lambda refs: F.transform(refs, lambda r: F.array_join(F.transform(r, lambda p: F.coalesce(p["str"], p["num"].cast("string"))), "_"))
    files.write_records(
        found.select(F.col("text_id").alias("textId"), text("source_refs").alias("sourceRefs"), text("target_refs").alias("targetRefs"), F.col("source_segment").alias("sourceTokens"), F.col("target_segment").alias("targetTokens"), ro.pairs_to_string(F.col("pairs")).alias("alignment")),
        out,
    )
