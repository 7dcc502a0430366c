"""Quality rules: per-document statistics and cross-document line frequency.

Base rules look at one document.  The method looks across them: lines are
normalised and hashed, each (host, line) gets the number of documents it stands
in, lines above the limit are boilerplate and are removed, and a document that
loses too much with them is rejected.  A document counts once for a line, however
often it holds it; copies are documents of their own.  One scan turns texts into a
narrow table of counts and line hashes; copies are counted together before lines
are exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm.common import SPACE, SPACE_CHARS, documents, shared_table, text_of, words_of

WINDOW = 8
#: A line is boilerplate when over LINE_DOCS documents of its host hold it, and over LINE_SHARE of them.
LINE_DOCS = 20
LINE_SHARE = 0.05
#: A document is depleted when less than this share of its words is left.
MIN_KEPT = 0.5


def line_hash(line: Column) -> Column:
    """Of the normalised line."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))), "[0-9]+", "0"), r"[^\x20\p{L}\p{N}]", ""))


def statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and __lines to docs.

    Words in repeated windows: windows are 64-bit hashes, made by doubling from
    hashed words.  Only where some window repeats are they sorted with their
    starts; equal neighbours are repeats, and their starts, sorted, give the
    covered words.  Each step is its own projection, so that arrays are made once.
    """
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    get = lambda a, i: F.get(F.col(a), i)

    def doubled(name: str, step: int) -> Column:
        head = F.slice(F.col(name), F.lit(1), F.greatest(F.size(name) - step, F.lit(0)))
        return F.transform(head, lambda x, i: F.xxhash64(x, get(name, i + step)))

    return (
        docs.withColumn("__words", words_of(text))
        .withColumn("__all_lines", lines)
        .withColumns(
            {
                "n_words": F.size("__words").cast("long"),
                "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
                "n_dup_lines": (F.size("__all_lines") - F.size(F.array_distinct("__all_lines"))).cast("long"),
                "__h1": F.transform("__words", lambda w: F.xxhash64(w)),
                "__lines": F.transform("__all_lines", lambda x: F.struct(line_hash(x).alias("line"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))),
            }
        )
        .drop("__words", "__all_lines")
        .withColumn("__h2", doubled("__h1", 1))
        .drop("__h1")
        .withColumn("__h4", doubled("__h2", 2))
        .drop("__h2")
        .withColumn("__h8", doubled("__h4", 4))
        .drop("__h4")
        .withColumn("__repeats", F.size(F.array_distinct("__h8")) < F.size("__h8"))
        .withColumn("__sorted", F.when(F.col("__repeats"), F.sort_array(F.transform("__h8", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))))
        .drop("__h8")
        .withColumn(
            "__starts",
            F.sort_array(F.transform(F.filter("__sorted", lambda x, i: (x["h"] == F.get(F.col("__sorted"), i + 1)["h"]).eqNullSafe(F.lit(True)) | ((i > 0) & (x["h"] == F.get(F.col("__sorted"), F.greatest(i - 1, F.lit(0)))["h"]))), lambda x: x["at"])),
        )
        .drop("__sorted", "__repeats")
        .withColumn(
            "n_repeat_words",
            F.coalesce(F.aggregate(F.transform("__starts", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__starts"), i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        )
        .drop("__starts")
    )


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, min_kept: float = MIN_KEPT) -> DataFrame:
    """One row per row of docs: doc_id, the statistics, n_boilerplate_words, base_failed, kept, __text, __host, __cut.

    __cut has the hashes of the boilerplate lines of the text, null for none.

    The host is the source; a null one is a host of its own.  A null text is an
    empty one and fails the base rules.  Blank lines count nowhere.  Each row is a
    document, and counts once for a line; equal rows get equal verdicts.  Every
    occurrence of a boilerplate line loses its words.  An empty table gives an empty
    one.  Other columns of docs are not looked at.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    source = docs.select("doc_id", "text", F.col("source").alias("__host"))
    facts = statistics(source).withColumn("__text", F.xxhash64(text_of())).select("doc_id", "__host", "__text", *names, "__lines")
    facts = shared_table(facts.withColumn("__host", F.coalesce(F.concat(F.lit("0"), F.col("__host")), F.lit("1"))), "quality-facts")
    # A text's lines and their words, once per host and text, with the documents that have it.
    per_text = facts.groupBy("__host", "__text").agg(F.first("__lines").alias("__lines"), F.count(F.lit(1)).alias("__copies"))
    lines = per_text.select("__host", "__text", "__copies", F.explode("__lines").alias("__l")).groupBy("__host", "__text", "__l.line").agg(F.sum("__l.words").alias("words"), F.first("__copies").alias("__copies"))
    limits = per_text.groupBy("__host").agg(F.greatest(F.lit(float(line_docs)), F.sum("__copies") * line_share).alias("__limit"))
    common = lines.groupBy("__host", "line").agg(F.sum("__copies").alias("__docs")).filter(F.col("__docs") > line_docs).join(limits, "__host").filter("__docs > __limit").select("__host", "line")
    lost = lines.join(common, ["__host", "line"], "left_semi").groupBy("__host", "__text").agg(F.sum("words").alias("__lost"), F.collect_list("line").alias("__cut"))
    n, repeated, gone = F.col("n_words"), F.col("n_repeat_words"), F.col("n_boilerplate_words")
    failed = (n < 20) | (100 * repeated > 30 * n)
    depleted = n - gone < min_kept * n
    return (
        facts.drop("__lines")
        .join(lost, ["__host", "__text"], "left")
        .withColumn("n_boilerplate_words", F.coalesce("__lost", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~depleted)
        .select("doc_id", *names, "n_boilerplate_words", "base_failed", "kept", "__text", "__host", "__cut")
    )


def passing(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs; text has no boilerplate lines, and n_chars, if there, follows."""
    out = judge(docs, **options).filter("NOT kept OR __cut IS NOT NULL").groupBy(F.col("__host").alias("__h"), F.col("__text").alias("__t")).agg(F.first("kept").alias("__kept"), F.first("__cut").alias("__cut"))
    host = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    met = docs.join(shared_table(out, "quality-changes").hint("merge"), (host == F.col("__h")) & (F.xxhash64(text_of()) == F.col("__t")), "left").filter(F.coalesce("__kept", F.lit(True)))
    blank = lambda x: F.length(F.translate(x, SPACE_CHARS, "")) == 0
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x: blank(x) | ~F.array_contains("__cut", line_hash(x))), "\n")
    met = met.withColumn("text", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return met.select(docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).drop("__text", "__host", "__cut")


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('0' || source, '1') AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS j FROM rep, (SELECT unnest(range(0, 8)) AS k)) GROUP BY rid),
ln AS (
  SELECT rid, host, x FROM (SELECT rid, host, unnest(string_split(text, chr(10))) AS x FROM d)
  WHERE length(translate(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM ln GROUP BY rid),
norm AS (
  SELECT rid, host, nx, sum(words) AS words FROM (
    SELECT rid, host, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS words,
           regexp_replace(regexp_replace(lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]+', '0', 'g'), '[^\x20\p{L}\p{N}]', '', 'g') AS nx FROM ln)
  GROUP BY rid, host, nx),
lim AS (SELECT host, greatest(20.0, count(*) * 0.05) AS lim FROM d GROUP BY host),
common AS (SELECT n.host, nx FROM (SELECT host, nx, count(*) AS c FROM norm GROUP BY host, nx) n JOIN lim USING (host) WHERE c > lim),
lost AS (SELECT rid, sum(words) AS n FROM norm JOIN common USING (host, nx) GROUP BY rid),
f AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(translate(d.text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(d.text) - length(translate(d.text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost.n, 0) AS BIGINT) AS n_boilerplate_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND NOT (n_words - n_boilerplate_words < 0.5 * n_words) AS kept
FROM f
"""
