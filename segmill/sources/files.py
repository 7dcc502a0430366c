"""Line files, alignment files and JSON records as corpora, and back."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.corpus import AlignmentCorpus, ParallelCorpus, TextCorpus, flatten
from segmill.operators import rows as ro

KEY = "array<struct<is_str:boolean,num:bigint,str:string>>"


def _text_id(pattern: str, ordinal: int, single: bool) -> Column:
    """A file's id: what the wildcards of its pattern stand for, joined by `-`; the pattern's number without any; `*all*` for one lone file."""
    if not re.search(r"[*?]", pattern):
        return F.lit("*all*") if single else F.lit(str(ordinal))
    name = pattern.rsplit("/", 1)[-1]
    groups = name.count("*") + name.count("?")
    regex = re.escape(name).replace(r"\*", "(.*)").replace(r"\?", "(.)") + "$"
    found = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return F.concat_ws("-", *[F.regexp_extract(found, regex, i + 1) for i in range(groups)])


def _lines(spark: SparkSession, patterns: Sequence[str]) -> list[DataFrame]:
    """text_id, row_ord, line of the files of each pattern.  Numbers are those of lines, so a file is read whole."""
    found = []
    for i, pattern in enumerate(patterns):
        files = spark.read.text(pattern, wholetext=True).select(_text_id(pattern, i, len(patterns) == 1).alias("text_id"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
        parts = F.split("value", "\r\n|\r|\n")
        kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
        found.append(files.select("text_id", F.posexplode(kept).alias("row_ord", "line")).withColumn("row_ord", F.col("row_ord").cast("long")))
    return found


def line_key(text: Column) -> Column:
    """`a-3_b` as an array of parts, numbers where they are."""
    part = lambda p: F.struct(p.try_cast("bigint").isNull().alias("is_str"), p.try_cast("bigint").alias("num"), F.when(p.try_cast("bigint").isNull(), p).alias("str"))
    return F.transform(F.split(text, "[-_]"), part)


def _numbered(row_ord: Column) -> Column:
    return F.array(F.struct(F.lit(False).alias("is_str"), (row_ord + 1).alias("num"), F.lit(None).cast("string").alias("str")))


def read_text(spark: SparkSession, *patterns: str, content_types: Sequence[str] = ()) -> TextCorpus:
    """A corpus of line files: `text`, `key<TAB>text` or `key<TAB>text<TAB>flags`.

    Without a key the ref is the line's number from 1.  Flags are a comma list
    of sentence_start (ss), in_range (ir) and range_start (rs), which replaces
    the default of sentence_start.  Blank text is an empty segment.
    """
    corpora = []
    for i, lines in enumerate(_lines(spark, patterns)):
        columns = F.split("line", "\t")
        n = F.size(columns)
        text = F.trim(F.when(n >= 2, F.get(columns, F.lit(1))).otherwise(F.get(columns, F.lit(0))))
        flags = F.transform(F.split(F.get(columns, F.lit(2)), ","), lambda x: F.trim(x))
        has = lambda long, short: F.arrays_overlap(flags, F.array(F.lit(long), F.lit(short)))
        flagged = n == 3
        corpora.append(
            TextCorpus(
                lines.select(
                    "text_id",
                    "row_ord",
                    F.when(n >= 2, line_key(F.get(columns, F.lit(0)))).otherwise(_numbered(F.col("row_ord"))).alias("ref"),
                    F.when(text == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.array(text)).alias("segment"),
                    F.when(flagged, has("sentence_start", "ss")).otherwise(F.lit(True)).alias("sentence_start"),
                    F.when(flagged, has("in_range", "ir")).otherwise(F.lit(False)).alias("in_range"),
                    F.when(flagged, has("range_start", "rs")).otherwise(F.lit(False)).alias("range_start"),
                    F.lit(content_types[i] if i < len(content_types) else "segment").alias("content_type"),
                )
            )
        )
    return flatten(corpora)


def read_alignments(spark: SparkSession, *patterns: str) -> AlignmentCorpus:
    """A corpus of alignment files: pairs (see pairs_from_string), with `key<TAB>` before them or numbered."""
    corpora = []
    for lines in _lines(spark, patterns):
        columns = F.split("line", "\t")
        keyed = F.size(columns) > 1
        corpora.append(
            AlignmentCorpus(
                lines.select(
                    "text_id", "row_ord", F.when(keyed, line_key(F.get(columns, F.lit(0)))).otherwise(_numbered(F.col("row_ord"))).alias("ref"), ro.pairs_from_string(F.element_at(columns, -1)).alias("pairs")
                )
            )
        )
    return flatten(corpora)


def write_text(corpus: TextCorpus, path: str) -> None:
    """A folder of `key<TAB>text<TAB>flags` files for each text."""
    key = F.array_join(F.transform("ref", lambda p: F.coalesce(p["str"], p["num"].cast("string"))), "_") if dict(corpus.df.dtypes)["ref"].startswith("array") else F.col("ref").cast("string")
    flags = F.concat_ws(",", *[F.when(F.col(c), F.lit(c)) for c in ("sentence_start", "in_range", "range_start")])
    line = F.concat_ws("\t", key, F.array_join("segment", " "), flags)
    corpus.df.repartitionByRange("text_id", "row_ord").sortWithinPartitions("text_id", "row_ord").select("text_id", line.alias("value")).write.partitionBy("text_id").text(path)


PRETRANSLATION = (
    "corpusId string, textId string, sourceRefs array<string>, targetRefs array<string>, translation string, sourceTokens array<string>, translationTokens array<string>, alignment string, sequenceConfidence double"
)
ALIGNMENT_INPUT = "corpusId string, textId string, sourceRefs array<string>, targetRefs array<string>, source string, target string"


def read_records(spark: SparkSession, path: str, schema: str = PRETRANSLATION) -> DataFrame:
    """Records of JSON arrays or of a record a line."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_records(df: DataFrame, path: str) -> None:
    """A JSON record a line; numbers with eight digits that count."""
    rounded = {c: F.format_string("%.8g", F.col(c)).cast("double") for c, kind in df.dtypes if kind in ("double", "float")}
    df.withColumns(rounded).write.json(path)


def alignment_records(corpus: ParallelCorpus, corpus_id: str) -> DataFrame:
    """Parallel rows as the input records of an alignment job."""
    refs = lambda c: F.transform(c, lambda r: r.cast("string"))
    return corpus.df.select(
        F.lit(corpus_id).alias("corpusId"), F.col("text_id").cast("string").alias("textId"), refs("source_refs").alias("sourceRefs"), refs("target_refs").alias("targetRefs"), F.array_join("source_segment", " ").alias("source"),
        F.array_join("target_segment", " ").alias("target"),
    )


def write_truecase_model(counts: DataFrame, path: str) -> None:
    """A line `form count form count ...` for each lower-cased token of truecase_counts()."""
    grouped = counts.groupBy("token_lower").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "token", "n"))).alias("forms"))
    grouped.select(F.array_join(F.transform("forms", lambda f: F.concat_ws(" ", f["token"], f["n"].cast("string"))), " ").alias("value")).write.text(path)


def read_truecase_model(spark: SparkSession, path: str) -> DataFrame:
    """token_lower, token: the first form of each line has the highest count."""
    first = F.get(F.split("value", " "), F.lit(0))
    return spark.read.text(path).select(F.lower(first).alias("token_lower"), first.alias("token"))
