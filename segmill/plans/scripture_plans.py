"""Plans over scripture corpora, whose refs are bbbcccvvv numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.corpus import ParallelCorpus, TextCorpus
from segmill.operators import scripture as sc


def verse_list(spark: SparkSession, vrs: sc.Versification) -> TextCorpus:
    """An empty row for every verse of a versification; the text is the book."""
    rows = sc.verse_rows(spark, vrs)
    none = F.expr("CAST(array() AS array<string>)")
    return TextCorpus(
        rows.select(
            sc.book_id(F.col("book_num")).alias("text_id"), F.col("number").alias("row_ord"), F.col("number").alias("ref"), none.alias("segment"), F.lit(True).alias("sentence_start"), F.lit(False).alias("in_range"), F.lit(False).alias("range_start"),
            F.lit("segment").alias("content_type"),
        ),
        versification=vrs.name,
    )


def in_versification(corpus: TextCorpus, own: sc.Versification, other: sc.Versification) -> TextCorpus:
    """The corpus with refs, texts and order of another versification."""
    moved = sc.change_versification(corpus.df.withColumn("number", F.col("ref")), own, other)
    columns = {"ref": F.col("new_number"), "text_id": sc.book_id(F.floor(F.col("new_number") / 1_000_000).cast("int"))}
    return TextCorpus(moved.withColumns(columns).drop("number", "new_number"), corpus.is_tokenized, other.name)


def align_versified(source: TextCorpus, target: TextCorpus, source_vrs: sc.Versification, target_vrs: sc.Versification, **options) -> ParallelCorpus:
    """align_rows() by what verses are in the source's versification; target_refs are in the target's own again."""
    found = source.align_rows(in_versification(target, target_vrs, source_vrs), **options)
    refs = found.df.select("text_id", "row_ord", F.posexplode("target_refs").alias("at", "number"))
    back = sc.change_versification(refs, source_vrs, target_vrs).groupBy("text_id", "row_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new_number"))), lambda x: x["new_number"]).alias("__refs"))
    df = found.df.join(back, ["text_id", "row_ord"], "left").withColumn("target_refs", F.coalesce("__refs", "target_refs")).drop("__refs")
    return ParallelCorpus(df, found.is_source_tokenized, found.is_target_tokenized)


def extract(corpus: TextCorpus, vrs: sc.Versification) -> DataFrame:
    """number, line for every verse of a versification: its text, <range> inside a range, or nothing."""
    rows = corpus.df.select(F.col("ref").alias("number"), "row_ord", F.array_join("segment", " ").alias("text"), "in_range", "range_start")
    return sc.verse_lines(sc.verse_rows(corpus.df.sparkSession, vrs).select("number"), rows)
