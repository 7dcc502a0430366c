"""Verse references and versifications.

A reference is text (`GEN 1:3`, `GEN 1:3-5,7`, `GEN 1:3a`) or a number
bbbcccvvv.  A versification is a set of small tables read from a .vrs file:
chapters, mappings to the standard, excluded verses and verse segments.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The ids of all books, in the order of their numbers from 1, and those that are not canonical.
BOOKS = (
    "GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST JOB PSA PRO ECC SNG ISA JER LAM EZK DAN HOS JOL AMO OBA JON MIC NAM HAB ZEP HAG ZEC MAL "
    "MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD REV "
    "TOB JDT ESG WIS SIR BAR LJE S3Y SUS BEL 1MA 2MA 3MA 4MA 1ES 2ES MAN PS2 ODA PSS JSA JDB TBS SST DNT BLT XXA XXB XXC XXD XXE XXF XXG FRT BAK OTH 3ES EZA 5EZ 6EZ INT CNC GLO TDX NDX "
    "DAG PS3 2BA LBA JUB ENO 1MQ 2MQ 3MQ REP 4BA LAO"
).split()
NON_CANONICAL = "XXA XXB XXC XXD XXE XXF XXG FRT BAK OTH INT CNC GLO TDX NDX".split()
NUMBERS = {b: i + 1 for i, b in enumerate(BOOKS)}


def canon(spark: SparkSession) -> DataFrame:
    """book, book_num, testament (OT, NT or null), canonical."""
    rows = [(b, i, "OT" if i < 40 else "NT" if i < 67 else None, b not in NON_CANONICAL) for b, i in NUMBERS.items()]
    return spark.createDataFrame(rows, "book string, book_num int, testament string, canonical boolean")


def book_number(book: Column) -> Column:
    """A book's number, 0 if there is no such book."""
    return F.array_position(F.array(*[F.lit(b) for b in BOOKS]), F.upper(book)).cast("int")


def book_id(number: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(b) for b in BOOKS]), number - 1), F.lit("***"))


# --- references ------------------------------------------------------------------------


def parse(ref: Column) -> Column:
    """struct<book, book_num, chapter, verse (text), verse_num (the first)>; null if it is none.  Right-to-left marks are dropped."""
    clean = F.regexp_replace(F.trim(ref), "[‎‏]", "")
    pattern = r"^(\w{3}) (\d+):(\d+[a-z]?(?:[,-]\d+[a-z]?)*)(?:/\w+)?$"
    part = lambda i: F.regexp_extract(clean, pattern, i)
    found = F.struct(
        F.upper(part(1)).alias("book"), book_number(part(1)).alias("book_num"), part(2).try_cast("int").alias("chapter"), part(3).alias("verse"), F.regexp_extract(part(3), r"^(\d+)", 1).try_cast("int").alias("verse_num")
    )
    return F.when(clean.rlike(pattern) & (book_number(part(1)) > 0), found)


def pack(book_num: Column, chapter: Column, verse: Column) -> Column:
    """bbbcccvvv; each part modulo 1000."""
    cut = lambda c: F.pmod(c, F.lit(1000))
    return cut(book_num) * 1_000_000 + cut(chapter) * 1000 + cut(verse)


def unpack(number: Column) -> Column:
    return F.struct(F.floor(number / 1_000_000).cast("int").alias("book_num"), F.pmod(F.floor(number / 1000), F.lit(1000)).cast("int").alias("chapter"), F.pmod(number, F.lit(1000)).cast("int").alias("verse"))


def segment_of(verse: Column) -> Column:
    """The letter behind a verse's number, if any."""
    return F.regexp_extract(verse, r"^\d+([a-z]*)", 1)


def without_segments(verse: Column) -> Column:
    return F.regexp_replace(verse, r"(\d)[a-z]+", "$1")


def all_verses(verse: Column) -> Column:
    """array<int> of the verses of a bridge: `3-5,7` has 3, 4, 5 and 7."""

    def numbers(piece: Column) -> Column:
        ends = F.split(without_segments(piece), "-")
        first, last = F.get(ends, F.lit(0)).cast("int"), F.element_at(ends, -1).cast("int")
        return F.when(last > first, F.sequence(first, last)).otherwise(F.array(first))

    return F.flatten(F.transform(F.split(verse, ","), numbers))


def overlapping(verse1: Column, verse2: Column) -> Column:
    """Whether two verse texts share a verse; of one verse, segments of different letters don't."""
    a, b = segment_of(verse1), segment_of(verse2)
    single = ~verse1.rlike("[,-]") & ~verse2.rlike("[,-]")
    return F.arrays_overlap(all_verses(verse1), all_verses(verse2)) & ~(single & (a != "") & (b != "") & (a != b))


def compared(number1: Column, verse1: Column, number2: Column, verse2: Column) -> Column:
    """-1, 0 or 1: the order of two references by bbbcccvvv, then by their segments; those without a segment come first."""
    one, two = F.struct(number1.cast("long").alias("n"), segment_of(verse1).alias("s")), F.struct(number2.cast("long").alias("n"), segment_of(verse2).alias("s"))
    return F.when(one < two, -1).when(one == two, 0).otherwise(1)


def exactly_equal(number1: Column, verse1: Column, versification1: Column, number2: Column, verse2: Column, versification2: Column) -> Column:
    """Whether book, chapter, the whole text of the verse and the versification (by name) are the same."""
    return number1.eqNullSafe(number2) & verse1.eqNullSafe(verse2) & versification1.eqNullSafe(versification2)


def merged_verses(verse1: Column, verse2: Column) -> Column:
    """The text of all verses of two texts, runs as ranges."""
    both = F.array_sort(F.array_distinct(F.concat(all_verses(verse1), all_verses(verse2))))
    empty = F.expr("CAST(array() AS array<struct<a:int,b:int>>)")

    def step(done: Column, v: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce(last["b"] + 1 == v, F.lit(False))
        head = F.when(joins, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.concat(head, F.array(F.struct(F.when(joins, last["a"]).otherwise(v).alias("a"), v.alias("b"))))

    return F.array_join(F.transform(F.aggregate(both, empty, step), lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"], r["b"]))), ",")


# --- versifications ----------------------------------------------------------------------


@dataclass(frozen=True)
class Versification:
    """name, and rows: chapters (book_num, chapter, last_verse), mappings (own, standard), excluded (number), segments (number, segment)."""

    name: str
    chapters: dict[tuple[int, int], int]
    mappings: list[tuple[int, int]]
    excluded: frozenset[int]
    segments: list[tuple[int, str]]

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {
            "chapters": spark.createDataFrame([(b, c, v) for (b, c), v in self.chapters.items()], "book_num int, chapter int, last_verse int"),
            "mappings": spark.createDataFrame(self.mappings, "own long, standard long"),
            "excluded": spark.createDataFrame([(n,) for n in self.excluded], "number long"),
            "segments": spark.createDataFrame(self.segments, "number long, segment string"),
        }


def _number(text: str) -> int:
    book, place = text.split()
    chapter, verse = place.split(":")
    if book.upper() not in NUMBERS:
        raise ValueError(f"invalid book {book!r}")
    return NUMBERS[book.upper()] * 1_000_000 + int(chapter) * 1000 + int(verse)


def _run(text: str) -> list[int]:
    """`GEN 1:3-5` as numbers."""
    first, _, last = text.strip().partition("-")
    number = _number(first)
    return list(range(number, number + max(0, int(last or 0) - number % 1000) + 1))


def parse_versification(text: str, name: str = "", base: Versification | None = None) -> Versification:
    """Read the lines of a .vrs file, over another versification if one is given.

    Chapters with their last verses (`GEN 1:31 2:25`, END drops later chapters),
    mappings (`GEN 31:55 = GEN 32:1`, or &: one verse to many), excluded verses
    (-) and segments (*).  # starts a comment, #! a line that counts.
    """
    chapters = dict(base.chapters) if base else {}
    mappings = list(base.mappings) if base else []
    excluded = set(base.excluded) if base else set()
    segments = list(base.segments) if base else []
    for at, raw in enumerate(text.splitlines(), 1):
        found = re.match(r'#\s*Versification\s+"(.+)"', raw.strip())
        name = name or (found[1] if found else "")
        line = raw.strip()
        line = line[2:].strip() if line.startswith("#!") else line.split("#")[0].strip()
        if not line:
            continue
        try:
            if "=" in line:
                own, standard = (_run(side) for side in line.lstrip("&").split("="))
                if line[0] == "&":
                    if min(len(own), len(standard)) != 1:
                        raise ValueError("neither side is one verse")
                    mappings += [(o, s) for o in own for s in standard]
                else:
                    mappings += [(o, standard[0] + i) for i, o in enumerate(own)]
            elif line[0] == "-":
                excluded.add(_number(line[1:]))
            elif line[0] == "*":
                head, _, rest = line[1:].replace(", ", ",").partition(",")
                segments += [(_number(head), s.strip()) for s in rest.split(",") if s.strip()]
            else:
                book, *parts = line.split()
                number = NUMBERS[book.upper()]
                last = 0
                for part in parts:
                    if part == "END":
                        for key in [k for k in chapters if k[0] == number and k[1] > last]:
                            del chapters[key]
                        break
                    last, verses = map(int, part.split(":"))
                    for missing in range(1, last):
                        chapters.setdefault((number, missing), 1)
                    chapters[number, last] = verses
        except (ValueError, KeyError) as error:
            raise ValueError(f"invalid versification line {at}: {raw!r} ({error})") from error
    return Versification(name, chapters, mappings, frozenset(excluded), segments)


def verse_rows(spark: SparkSession, vrs: Versification) -> DataFrame:
    """book_num, chapter, verse, number of every verse that is not excluded, in canonical books."""
    own = vrs.tables(spark)
    rows = own["chapters"].where("last_verse > 0").select("book_num", "chapter", F.explode(F.sequence(F.lit(1), "last_verse")).alias("verse"))
    rows = rows.withColumn("number", pack(F.col("book_num"), F.col("chapter"), F.col("verse")).cast("long"))
    canonical = F.broadcast(canon(rows.sparkSession).where("canonical").select("book_num"))
    return rows.join(own["excluded"], "number", "left_anti").join(canonical, "book_num", "left_semi")


def last_verses(spark: SparkSession, vrs: Versification) -> DataFrame:
    """book_num, last_chapter, last_verse (of that chapter)."""
    return vrs.tables(spark)["chapters"].groupBy("book_num").agg(F.max(F.struct("chapter", "last_verse")).alias("x")).select("book_num", F.col("x.chapter").alias("last_chapter"), F.col("x.last_verse").alias("last_verse"))


def change_versification(df: DataFrame, source: Versification, target: Versification, number: str = "number") -> DataFrame:
    """df with new_number: each bbbcccvvv of the source's in the target.

    By way of the standard; a verse that both map alike and the target has stays.
    A verse mapped to many gives its first.  The mapping tables are as small as
    their files, some thousand rows.
    """
    spark = df.sparkSession

    def small(rows: list[tuple[int, int]], a: str, b: str) -> DataFrame:
        first: dict[int, int] = {}
        for x, y in rows:
            first.setdefault(x, y)
        return F.broadcast(spark.createDataFrame(list(first.items()), f"{a} long, {b} long"))

    out = small(source.mappings, "__o", "__standard")
    same = small(target.mappings, "__t", "__same")
    back = small([(s, o) for o, s in target.mappings], "__s", "__back")
    chapters = F.broadcast(spark.createDataFrame([(b * 1000 + c, v) for (b, c), v in target.chapters.items()], "__chapter long, __last int"))
    key = F.col(number).cast("long")
    standard, alike = F.coalesce("__standard", key), F.coalesce("__same", key)
    joined = df.join(out, key == F.col("__o"), "left").join(same, key == F.col("__t"), "left").join(chapters, F.floor(key / 1000) == F.col("__chapter"), "left")
    joined = joined.withColumn("__at", standard).join(back, F.col("__at") == F.col("__s"), "left")
    stays = (standard == alike) & F.coalesce(F.pmod(key, F.lit(1000)) <= F.col("__last"), F.lit(False)) & (F.floor(key / 1_000_000) != NUMBERS["ESG"])
    found = F.when(stays, key).otherwise(F.coalesce("__back", standard))
    return joined.withColumn("new_number", found).drop("__o", "__standard", "__t", "__same", "__chapter", "__last", "__at", "__s", "__back")


def verse_lines(verses: DataFrame, rows: DataFrame) -> DataFrame:
    """number, line for every verse: the texts of its rows, `<range>` in a range after its start, or nothing.

    verses has number; rows has number, row_ord, text, in_range, range_start.
    """
    per_verse = rows.groupBy("number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("row_ord", "text")))), lambda x: x["text"]), " ").alias("line"),
        F.bool_and(F.col("in_range") & ~F.col("range_start") & (F.col("text") == "")).alias("inside"),
    )
    return verses.join(per_verse, "number", "left").select("number", F.when(F.col("inside"), F.lit("<range>")).otherwise(F.coalesce("line", F.lit(""))).alias("line"))


def diagnose(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """kind (missing or extra), first, last: runs of verses (number) that only one side has."""
    both = expected.select("number", F.lit(True).alias("e")).distinct().join(observed.select("number", F.lit(True).alias("o")).distinct(), "number", "full")
    odd = both.where("e IS NULL OR o IS NULL").select("number", F.when(F.col("o").isNull(), "missing").otherwise("extra").alias("kind"))
    chapter = F.floor(F.col("number") / 1000)
    run = F.col("number") - F.row_number().over(Window.partitionBy("kind", "__chapter").orderBy("number"))
    return odd.withColumn("__chapter", chapter).withColumn("__run", run).groupBy("kind", "__chapter", "__run").agg(F.min("number").alias("first"), F.max("number").alias("last")).select("kind", "first", "last")


def parse_selection(text: str) -> dict[int, list[int]]:
    """Books and chapters of `OT;MAT-JHN;-LUK;GEN 1-3,5`; an empty list stands for all chapters."""
    found: dict[int, list[int]] = {}

    def books(name: str) -> list[int]:
        if name in ("OT", "NT"):
            return list(range(1, 40)) if name == "OT" else list(range(40, 67))
        first, _, last = name.partition("-")
        numbers = [NUMBERS.get(n, 0) for n in (first, last or first)]
        if 0 in numbers or numbers[0] > numbers[1]:
            raise ValueError(f"invalid books {name!r}")
        return list(range(numbers[0], numbers[1] + 1))

    pieces = [p.strip() for p in text.split(";") if p.strip()]
    for piece in [p for p in pieces if p[0] != "-"]:
        name, _, chapters = piece.partition(" ")
        if chapters:
            numbers = [n for part in chapters.replace(" ", "").split(",") for a, _, b in [part.partition("-")] for n in range(int(a), int(b or a) + 1)]
            found[books(name)[0]] = sorted({*found.get(books(name)[0], []), *numbers})
        else:
            found |= {b: [] for b in books(name)}
    for piece in [p[1:].strip() for p in pieces if p[0] == "-"]:
        for b in books(piece):
            if b not in found:
                raise ValueError(f"{piece!r} is not selected")
            del found[b]
    return dict(sorted(found.items()))


#: What can be said of a reference.
VALID, UNKNOWN, OUT_OF_RANGE, OUT_OF_ORDER, REPEATED = "valid", "unknown_versification", "out_of_range", "verse_out_of_order", "verse_repeated"


def valid_status(df: DataFrame, vrs: Versification | None, book_num: str = "book_num", chapter: str = "chapter", verse: str = "verse") -> DataFrame:
    """df with status: whether each of a reference's verses is in the versification, and they rise.

    The first verse that is not, in the order of the text, decides.  Books out of
    the canon have any verse.  The tables joined are as small as a versification.
    """
    if vrs is None:
        return df.withColumn("status", F.lit(UNKNOWN))
    spark = df.sparkSession
    chapters = F.broadcast(spark.createDataFrame([(b * 1000 + c, v) for (b, c), v in vrs.chapters.items()], "__chapter long, __last int"))
    gone: dict[int, list[int]] = {}
    for n in vrs.excluded:
        gone.setdefault(n // 1000, []).append(n % 1000)
    excluded = F.broadcast(spark.createDataFrame(list(gone.items()), "__at long, __gone array<int>"))
    canonical = F.broadcast(canon(spark).select(F.col("book_num").alias("__book"), "canonical"))
    key = F.col(book_num).cast("long") * 1000 + F.col(chapter)
    joined = df.join(chapters, key == F.col("__chapter"), "left").join(excluded, key == F.col("__at"), "left").join(canonical, F.col(book_num) == F.col("__book"), "left")
    outside = lambda v: F.coalesce((v < 0) | (v > F.col("__last")) | F.array_contains(F.coalesce("__gone", F.expr("CAST(array() AS array<int>)")), v), F.lit(True))
    verses = all_verses(F.col(verse))
    before = lambda i: F.get(verses, i - 1)
    one = lambda v, i: F.when(F.col("canonical") & outside(v), OUT_OF_RANGE).when((i > 0) & (before(i) > v), OUT_OF_ORDER).when((i > 0) & (before(i) == v), REPEATED)
    found = F.get(F.filter(F.transform(verses, one), lambda x: x.isNotNull()), F.lit(0))
    status = F.when(F.col("canonical").isNull(), OUT_OF_RANGE).when(F.col(verse).rlike(r"^\d"), F.coalesce(found, F.lit(VALID))).otherwise(OUT_OF_RANGE)
    return joined.withColumn("status", status).drop("__chapter", "__last", "__at", "__gone", "__book", "canonical")


def has_cross_book_mappings(spark: SparkSession, vrs: Versification, standard: Versification) -> bool:
    """Whether a verse of the versification is one of another book in the standard one."""
    moved = change_versification(verse_rows(spark, vrs).select("number"), vrs, standard)
    return not moved.where(F.floor(F.col("number") / 1_000_000) != F.floor(F.col("new_number") / 1_000_000)).isEmpty()
