"""Translation projects: settings, and key terms as a corpus of words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.corpus import TextCorpus

# Code pages that settings name, and versifications by their numbers.
CODECS = {"65001": "utf-8-sig", "1200": "utf-16-le", "1201": "utf-16-be", "1252": "cp1252", "1250": "cp1250", "1251": "cp1251", "1253": "cp1253", "1254": "cp1254", "1255": "cp1255", "1256": "cp1256", "1257": "cp1257", "1258": "cp1258", "932": "cp932", "936": "gbk", "949": "cp949", "950": "big5", "20127": "ascii", "28591": "latin-1"}
VERSIFICATIONS = {"1": "Original", "2": "Septuagint", "3": "Vulgate", "4": "English", "5": "Russian Protestant", "6": "Russian Orthodox"}


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """name, full_name, encoding, versification, stylesheet, language, pre_part, form, post_part, terms (type:project:file) of a settings file."""
    text = spark.read.text(path, wholetext=True).first().value
    field = lambda tag: (m[1] or "") if (m := re.search(rf"<{tag}>([^<]*)</{tag}>", text)) else ""
    naming = dict(re.findall(r'(\w+)="([^"]*)"', (re.search(r"<Naming ([^>]*)/>", text) or ["", ""])[1]))
    number = field("Versification")
    return {
        "name": field("Name"),
        "full_name": field("FullName"),
        "encoding": CODECS.get(field("Encoding") or "65001", "utf-8-sig"),
        "versification": VERSIFICATIONS.get(number, "English"),
        "stylesheet": field("StyleSheet") or "usfm.sty",
        "language": field("LanguageIsoCode").split(":")[0],
        "pre_part": naming.get("PrePart", field("FileNamePrePart")),
        "form": naming.get("BookNameForm", field("FileNameBookNameForm")),
        "post_part": naming.get("PostPart", field("FileNamePostPart")),
        "terms": field("BiblicalTermsListSetting"),
    }


def book_file_name(settings: dict[str, str], book: str, number: int) -> str:
    """The name of a book's file: its number before Matthew is its own, from there one more."""
    shown = f"{number + 1 if number >= 40 else number:02d}"
    return settings["pre_part"] + settings["form"].replace("41", shown).replace("MAT", book) + settings["post_part"]


def _bare(text: Column) -> Column:
    """Without what stands in brackets, white space squeezed."""
    inner = F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)", ""), r"\([^()]*\)", "")
    return F.trim(F.regexp_replace(inner, r"\s+", " "))


def renderings_of(text: Column) -> Column:
    """array<string>: a rendering field's parts between ||."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|\|"), _bare), lambda x: x != "")


def glosses_of(text: Column) -> Column:
    """array<string>: a gloss's parts between , ; and /; of a gloss in square brackets, what is inside."""
    inside = F.when(text.rlike(r"^\[.*\]$"), F.regexp_extract(text, r"^\[(.*)\]$", 1)).otherwise(text)
    clean = F.regexp_replace(F.regexp_replace(_bare(inside), r"\[[^\[\]]*\]", ""), r"\s+\d+(\.\d+)*$", "")
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(clean, "[,;/]"), lambda x: F.trim(x)), lambda x: x != "")))


def read_terms(spark: SparkSession, renderings: str, terms: str | None = None, glosses: str | None = None, categories: tuple[str, ...] = ()) -> DataFrame:
    """id, category, domain, renderings, patterns of key terms.

    renderings is a file of TermRendering elements, of which guesses don't
    count; terms one of Term elements with categories; glosses one of
    Localization elements, used where a term has no rendering.  * in a
    rendering is a wildcard, kept in patterns only.
    """
    xml = lambda path, tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    given = xml(renderings, "TermRendering", "_Id string, _Guess string, Renderings string").where(F.coalesce("_Guess", F.lit("false")) == "false")
    made = given.groupBy(F.col("_Id").alias("id")).agg(F.flatten(F.collect_list(renderings_of(F.col("Renderings")))).alias("patterns"))
    if glosses:
        found = xml(glosses, "Localization", "_Id string, _Gloss string").groupBy(F.col("_Id").alias("id")).agg(F.flatten(F.collect_list(glosses_of(F.col("_Gloss")))).alias("glosses"))
        made = made.join(found, "id", "full")
    else:
        made = made.withColumn("glosses", F.expr("CAST(NULL AS array<string>)"))
    if terms:
        data = xml(terms, "Term", "_Id string, Category string, Domain string").select(F.col("_Id").alias("id"), F.coalesce("Category", F.lit("")).alias("category"), F.coalesce("Domain", F.lit("")).alias("domain")).dropDuplicates(["id"])
        made = made.join(data, "id", "left")
        if categories:
            made = made.where(F.col("category").isin(list(categories)))
    else:
        made = made.withColumns({"category": F.lit(None).cast("string"), "domain": F.lit(None).cast("string")})
    none = F.expr("CAST(array() AS array<string>)")
    patterns = F.coalesce("patterns", none)
    shown = F.when(F.size(patterns) > 0, F.transform(patterns, lambda x: F.replace(x, F.lit("*"), F.lit("")))).otherwise(F.coalesce("glosses", none))
    return made.select("id", F.coalesce("category", F.lit("?")).alias("category"), F.coalesce("domain", F.lit("?")).alias("domain"), shown.alias("renderings"), patterns.alias("patterns")).where(F.size("renderings") > 0)


def term_corpus(terms: DataFrame, text_id: str = "terms") -> TextCorpus:
    """A row of type word for each rendering; its ref is the term's id."""
    rows = terms.select(F.col("id").alias("ref"), F.posexplode("renderings").alias("row_ord", "word"))
    return TextCorpus(
        rows.select(
            F.lit(text_id).alias("text_id"), F.col("row_ord").cast("long").alias("row_ord"), "ref", F.array("word").alias("segment"), F.lit(True).alias("sentence_start"), F.lit(False).alias("in_range"), F.lit(False).alias("range_start"), F.lit("word").alias("content_type"),
        )
    )
