"""The corpus pipeline: quality rules, exact and near deduplication, mixing, packing.

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows and further columns, whatever their names, and gives no rows for an empty
table.  All but the last return the columns they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segmill.llm.common import documents, shared_table
from segmill.llm.exact_dedup import drop_copies
from segmill.llm.mixing import mixed_rows
from segmill.llm.packing import pack
from segmill.llm.quality import passing
from segmill.llm.simhash import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts with them; kept texts lose their boilerplate lines.  Equal rows go or stay together."""
    return passing(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, one row where several share it; null is the smallest doc_id and an empty text."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts with a five-word shingle similarity of 0.8 or more, linked by others or not, the smallest doc_id stays, null last; equal texts are one text and stay with all their rows."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a null source is a source of its own."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in its sequence; every repeat is packed, null and empty texts as their end id."""
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL has neither the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
