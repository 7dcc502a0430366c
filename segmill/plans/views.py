"""The given tables as corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.corpus import TextCorpus

#: row_ord of a line is its document's id times this, plus its number: more lines than a text can have bytes here, and ids up to 2 to the 35th.
LINES = 1 << 28
#: The same for the turns of a conversation.
TURNS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagged(df: DataFrame, in_range=None, range_start=None) -> DataFrame:
    """df with the columns of a corpus that it lacks."""
    extra = {"sentence_start": F.lit(True), "in_range": F.lit(False) if in_range is None else in_range, "range_start": F.lit(False) if range_start is None else range_start, "content_type": F.lit("segment")}
    return df.withColumns({k: v for k, v in extra.items() if k not in df.columns})


def segment_of(text):
    """One string, or none for blank text."""
    trimmed = F.trim(text)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.array(trimmed))


def lines(spark: SparkSession, sf_dir: str) -> TextCorpus:
    """A row for each line of documents; the text is the source."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("text_id"), "doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    order = F.col("doc_id") * LINES + F.col("line")
    return TextCorpus(flagged(rows.select("text_id", order.alias("row_ord"), order.alias("ref"), "doc_id", "line", "lang", segment_of(F.col("text")).alias("segment"))))


LINES_SQL = """
lines AS (
  SELECT source AS text_id, doc_id * 268435456 + i - 1 AS row_ord, doc_id, i - 1 AS line, lang, trim(p[i], ' ') AS line_text
  FROM (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS p FROM documents), unnest(range(1, len(p) + 1)) AS t(i))
"""


def turns(spark: SparkSession, sf_dir: str, role: str) -> TextCorpus:
    """The turns of a role in conversations, numbered within each."""
    talk = table(spark, sf_dir, "conversations").where(F.col("role") == role)
    ref = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return TextCorpus(flagged(talk.select(F.col("conv_id").alias("text_id"), ref.alias("ref"), segment_of(F.col("text")).alias("segment")).withColumn("row_ord", F.col("ref"))))


TURNS_SQL = """
turns AS (
  SELECT conv_id AS text_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ref, trim(coalesce(text, ''), ' ') AS text FROM conversations),
src AS (SELECT * FROM turns WHERE role = 'user'),
trg AS (SELECT * FROM turns WHERE role = 'assistant')
"""
