"""What is wrong with the verses of marked-up books, by a versification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.operators import scripture as sc
from segmill.sources.usfm import located

MISSING, EXTRA, INVALID, SEGMENT, RANGE = "missing", "extra", "invalid", "incorrect_segment", "unsupported_range"
_VERSE = r"^\d+[a-z]?([,-]\d+[a-z]?)*$"
#: A chapter's verses are numbered by this times the chapter, plus the verse; books may have more verses in a chapter than a bbbcccvvv number can tell.
WIDE = 1 << 31


def _place(chapter: Column, verse: Column) -> Column:
    return chapter.cast("long") * WIDE + verse


def _name(book: Column, chapter: Column, verse: Column) -> Column:
    return F.concat(book, F.lit(" "), chapter.cast("string"), F.lit(":"), verse)


def _runs(verses: DataFrame, kind: str, lines: Column) -> DataFrame:
    """Verses (path, book, number, line, rank) as runs within chapters."""
    chapter = F.expr(f"number div {WIDE}")
    grouped = verses.withColumn("__chapter", chapter).withColumn("__run", F.col("number") - F.row_number().over(Window.partitionBy("path", "book", "__chapter").orderBy("number")))
    runs = grouped.groupBy("path", "book", "__chapter", "__run").agg(F.min("number").alias("first"), F.max("number").alias("last"), lines.alias("lines"), F.count("*").cast("int").alias("affected"))
    number = lambda c: F.pmod(F.col(c), F.lit(WIDE)).cast("string")
    text = F.when(F.col("first") == F.col("last"), number("first")).otherwise(F.concat(number("first"), F.lit("-"), number("last")))
    return runs.select("path", F.lit(kind).alias("kind"), _name(F.col("book"), F.col("__chapter"), text).alias("reference"), "lines", "affected")


def analyse(tokens: DataFrame, vrs: sc.Versification, original: sc.Versification | None = None, chapters: dict[int, list[int]] | None = None) -> DataFrame:
    """path, kind, reference, lines array<int>, affected: what is wrong with each book of tokens (path, TOKENS), a row a run of verses.

    missing: the versification has the verses and the book has not; the line is that of
    the last verse before them.  extra: the other way round.  invalid: no number, or verses repeated or out
    of order in a range, or a chapter without a number.  incorrect_segment: a segment where the versification
    has none, or none where it has some.  unsupported_range: a range whose verses are in
    several chapters of `original`.  Verses are compared as sets, so the order of a
    book's verses is of no account.  Non-canonical books have no rows; `chapters`, as
    of parse_selection(), picks some.
    """
    spark = tokens.sparkSession
    here = located(tokens).withColumn("book_num", sc.book_number(F.col("book"))).where("book_num > 0").where(~F.col("book").isin(*sc.NON_CANONICAL))
    if chapters is not None:
        picked = F.lit(False)
        for number, some in chapters.items():
            picked = picked | ((F.col("book_num") == number) & (F.col("chapter").isin(*some) if some else F.lit(True)))
        here = here.where(picked)
    verses = here.where("type = 'verse'").select("path", "book", "book_num", "chapter", "line", F.translate("data", "‎‏", "").alias("verse"))
    one = lambda df, kind, reference, affected: df.select("path", F.lit(kind).alias("kind"), reference.alias("reference"), F.array("line").alias("lines"), affected.cast("int").alias("affected"))
    named = _name(F.col("book"), F.col("chapter"), F.col("verse"))
    good = verses.where(F.col("verse").rlike(_VERSE))
    ends = lambda p: F.split(sc.without_segments(p), "-")
    falls = F.exists(F.split("verse", ","), lambda p: F.element_at(ends(p), -1).cast("int") < F.get(ends(p), 0).cast("int"))
    status = sc.valid_status(good, vrs)
    bad = one(verses.where(~F.col("verse").rlike(_VERSE)), INVALID, named, F.lit(1)).unionByName(one(status.where(F.col("status").isin(sc.OUT_OF_ORDER, sc.REPEATED) | falls), INVALID, named, F.size(sc.all_verses(F.col("verse")))))
    unnumbered = here.where(r"type = 'chapter' and not coalesce(data, '') rlike '^\\d+$'")
    bad = bad.unionByName(one(unnumbered, INVALID, F.concat_ws(" ", "book", F.coalesce("data", F.lit(""))), F.lit(1)))
    cut = spark.createDataFrame([(n // 1_000_000, n // 1000 % 1000, n % 1000) for n in sorted({n for n, _ in vrs.segments})], "book_num int, chapter int, first int").withColumn("has", F.lit(True))
    segments = good.withColumn("first", F.regexp_extract("verse", r"^\d+", 0).cast("int")).join(cut, ["book_num", "chapter", "first"], "left")
    wrong = one(segments.where((sc.segment_of(F.col("verse")) == "") == F.col("has").isNotNull()), SEGMENT, named, F.size(sc.all_verses(F.col("verse"))))
    each = good.select("path", "book", "book_num", "chapter", "line", "verse", F.explode(F.array_distinct(sc.all_verses(F.col("verse")))).alias("v"))
    each = each.withColumn("number", _place(F.col("chapter"), F.col("v")))
    found = bad.unionByName(wrong)
    if original is not None:
        packed = F.when((F.col("chapter") < 1000) & (F.col("v") < 1000), sc.pack(F.col("book_num"), F.col("chapter"), F.col("v")).cast("long"))  # others are as they are
        mapped = sc.change_versification(each.where(F.col("verse").rlike("[,-]")).withColumn("number", packed), vrs, original)
        to = F.coalesce(F.floor(F.col("new_number") / 1000), F.col("book_num") * 1000 + F.col("chapter"))
        split = mapped.groupBy("path", "book", "chapter", "verse", "line").agg(F.countDistinct(to).alias("n")).where("n > 1")
        found = found.unionByName(one(split, RANGE, named, F.size(sc.all_verses(F.col("verse")))))
    books = here.select("path", "book", "book_num").distinct()
    expected = sc.verse_rows(spark, vrs)
    if chapters is not None:
        expected = expected.where(picked)
    expected = expected.join(books, "book_num").select("path", "book", _place(F.col("chapter"), F.col("verse")).alias("number"))
    seen = each.where("v > 0").groupBy("path", "book", "number").agg(F.min("line").alias("line"))
    both = expected.withColumn("e", F.lit(True)).join(seen.withColumn("o", F.lit(True)), ["path", "book", "number"], "full")
    before = F.coalesce(F.last("line", ignorenulls=True).over(Window.partitionBy("path", "book").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    both = both.withColumn("before", before)
    missing = _runs(both.where("o is null"), MISSING, F.array(F.min(F.struct("number", "before"))["before"]))
    extra = _runs(both.where("e is null"), EXTRA, F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]))
    return found.unionByName(missing).unionByName(extra)
