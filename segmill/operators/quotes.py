"""Quotation marks: finding them, their context, conventions, and which convention texts follow.

A mark table has a row for each mark: text_id, row_ord, position (code points),
mark, before and after (the characters beside it, empty at an end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.functions import characters as ch

# The code points of quotation marks; < and > count too, doubled ones as one mark.
MARKS = [0x22, 0x27, 0xAB, 0xBB, *range(0x2018, 0x2020), 0x2039, 0x203A, 0x2E42, *range(0x300C, 0x3010), *range(0x301D, 0x3020), *range(0xFE41, 0xFE45), 0xFF02, 0xFF07, 0xFF62, 0xFF63]
PATTERN = f"<<|>>|{ch.char_class([*MARKS, ord('<'), ord('>')])}"

# Conventions by name, opening and closing marks from the outermost level in.
CONVENTIONS = {
    "standard_english": "“” ‘’ “” ‘’",
    "typewriter_english": "\"\" '' \"\" ''",
    "british_english": "‘’ “” ‘’ “”",
    "british_typewriter_english": "'' \"\" '' \"\"",
    "hybrid_typewriter_english": "“” '' \"\"",
    "standard_french": "«» ‹› «» ‹›",
    "typewriter_french": "<<>> <> <<>> <>",
    "french_variant": "«» ‹› “” ‘’",
    "western_european": "«» “” ‘’",
    "british_inspired_western_european": "«» ‘’ “”",
    "typewriter_western_european": "<<>> \"\" ''",
    "typewriter_western_european_variant": "\"\" <> ''",
    "hybrid_typewriter_western_european": "«» \"\" ''",
    "hybrid_british_typewriter_western_european": "«» '' \"\"",
    "central_european": "„“ ‚‘ „“ ‚‘",
    "central_european_guillemets": "»« ›‹ »« ›‹",
    "standard_swedish": "”” ’’ ”” ’’",
    "standard_finnish": "»» ’’",
    "eastern_european": "„” ‚’ „” ‚’",
    "standard_russian": "«» „“ ‚‘",
    "standard_arabic": "”“ ’‘ ”“ ’‘",
    "non-standard_arabic": "«» ’‘ ”“",
    "arabic_inspired_western_european": "«» ”“ ’‘",
}


def levels(spare: str) -> list[tuple[str, str]]:
    return [(p[: len(p) // 2], p[len(p) // 2 :]) for p in spare.split()]


def conventions(spark: SparkSession) -> DataFrame:
    """name, depth (from 1), direction (opening, closing), mark; one row each."""
    rows = [(name, depth, direction, mark) for name, marks in CONVENTIONS.items() for depth, pair in enumerate(levels(marks), 1) for direction, mark in zip(("opening", "closing"), pair, strict=True)]
    return spark.createDataFrame(rows, "name string, depth int, direction string, mark string")


#: What stands before a mark that begins a quotation.
INTRODUCER = r"[:,]\s*$"


def find_marks(df: DataFrame, text: Column, *keys: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The mark table of a column's texts: keys, nth, position, mark, before, after, introduced, and the columns to carry.

    What is beside a mark is read off the text between marks before rows are made of them, so no row holds a text.
    """
    cut = df.select(*keys, *carry, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("__marks"), F.split(text, PATTERN, -1).alias("__gaps"))
    held = cut.where(F.size("__marks") > 0)
    gap, mark = lambda i: F.get("__gaps", i), lambda i: F.get("__marks", i)
    beside = lambda g, m, end: F.when(g != "", end(g, F.lit(1))).otherwise(F.coalesce(end(m, F.lit(1)), F.lit("")))
    found = F.transform(
        "__marks",
        lambda m, i: F.struct(
            m.alias("mark"), F.length(gap(i)).alias("ahead"),
            beside(gap(i), mark(i - 1), F.right).alias("before"), beside(gap(i + 1), mark(i + 1), F.left).alias("after"),
            gap(i).rlike(INTRODUCER).alias("introduced"),
        ),
    )
    each = held.select(*keys, *carry, F.posexplode(found).alias("nth", "x"))
    so_far = Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select(*keys, *carry, "nth", (F.sum(F.col("x.ahead") + F.length("x.mark")).over(so_far) - F.length("x.mark")).alias("position"), "x.mark", "x.before", "x.after", "x.introduced")


def marked_context(marks: DataFrame) -> DataFrame:
    """The mark table with what context says: could_open, could_close, apostrophe."""
    white = lambda c: (F.col(c) == "") | F.col(c).rlike(f"^{ch.white()}$")
    letter = lambda c: F.col(c).rlike(r"^[\p{L}\p{N}]$")
    punctuation = lambda c: F.col(c).rlike(f"^{ch.category('P')}$")
    mark = lambda c: F.col(c).rlike(f"^(?:{PATTERN})$")
    single = F.col("mark").isin("'", "’", "‘")
    apostrophe = single & letter("before") & letter("after")
    return marks.withColumns(
        {
            "apostrophe": apostrophe,
            "could_open": ~apostrophe & (white("before") | mark("before") | F.col("before").rlike(r"^[(\[{:,—–-]$")) & ~white("after"),
            "could_close": ~apostrophe & ~white("before") & (white("after") | punctuation("after") | mark("after")),
        }
    )


def nested(context: DataFrame, *keys: str, deepest: int = 4) -> DataFrame:
    """Opening and closing marks with their depth (from 1): keys, nth, mark, direction, depth, too_deep.

    The depth of a closing mark is that of the last one open before it.
    """
    sides = context.where(~F.col("apostrophe") & (F.col("could_open") | F.col("could_close")))
    opening = F.col("could_open") & ~(F.col("could_close") & F.col("mark").isin("”", "’", "»", "›", ">>", ">"))
    step = F.when(opening, 1).otherwise(-1)
    order = Window.partitionBy(*keys).orderBy("nth")
    so_far = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    depth = F.greatest(so_far + F.when(opening, 0).otherwise(1), F.lit(1))
    return sides.withColumn("direction", F.when(opening, "opening").otherwise("closing")).withColumn("depth", depth).withColumn("too_deep", F.col("depth") > deepest).select(*keys, "nth", "mark", "direction", "depth", "too_deep")


def tabulate(resolved: DataFrame, *keys: str) -> DataFrame:
    """keys, depth, direction, mark, n, of the marks that nested() placed."""
    return resolved.where("NOT too_deep").groupBy(*keys, "depth", "direction", "mark").agg(F.count(F.lit(1)).alias("n"))


def similarities(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, name, n, score: how far marks agree with each convention.

    At each depth the share of marks that are the convention's counts by the
    number of marks there, times the share at the depth before it.
    """
    table = F.broadcast(conventions(counts.sparkSession).select("name", F.col("depth").alias("d"), F.col("direction").alias("r"), F.col("mark").alias("m")))
    names = F.broadcast(conventions(counts.sparkSession).select("name").distinct().withColumn("__one", F.lit(1)))
    each = counts.withColumn("__one", F.lit(1)).join(names, "__one").drop("__one").alias("c")
    judged = each.join(table.alias("t"), (F.col("c.name") == F.col("t.name")) & (F.col("depth") == F.col("d")) & (F.col("direction") == F.col("r")) & (F.col("mark") == F.col("m")), "left")
    by_depth = judged.groupBy(*keys, "c.name", "depth").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("m").isNotNull(), F.col("n")).otherwise(0)).alias("right"))
    share = F.col("right") / F.col("n")
    before = F.coalesce(F.lag(share).over(Window.partitionBy(*keys, "name").orderBy("depth")), F.lit(1.0))
    return by_depth.withColumn("__score", share * F.col("n") * before).groupBy(*keys, "name").agg(F.sum("n").alias("n"), (F.sum("__score") / F.sum("n")).alias("score"))


def detect(scores: DataFrame, *keys: str) -> DataFrame:
    """keys, name, score of the best convention (the first of equals by name), where any mark agrees."""
    best = F.max(F.struct("score", F.col("n").alias("n"), F.reverse("name").alias("x"), "name"))
    return scores.where("score > 0").groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.name").alias("name"), F.col("b.score").alias("score"))


def combined(scores: DataFrame) -> DataFrame:
    """name, score over all keys, weighted by their numbers of marks; conventions without any score are left out."""
    return scores.groupBy("name").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score")).where("score > 0")


def convert(text: Column, source: str, target: str) -> Column:
    """A text's marks in another convention, where each of the source's marks stands for one mark of the target."""
    pairs: dict[str, set[str]] = {}
    for old, new in zip(levels(CONVENTIONS[source]), levels(CONVENTIONS[target]), strict=False):
        for a, b in zip(old, new, strict=True):
            pairs.setdefault(a, set()).add(b)
    unclear = [a for a, b in pairs.items() if len(b) > 1]
    if unclear:
        raise ValueError(f"{unclear} stand for several marks; resolve them by depth first")
    for a, b in sorted(pairs.items(), key=lambda x: -len(x[0])):
        text = F.replace(text, F.lit(a), F.lit(f"{ord(next(iter(b))[0]):x}.{len(next(iter(b)))}"))
    for b in {next(iter(v)) for v in pairs.values()}:
        text = F.replace(text, F.lit(f"{ord(b[0]):x}.{len(b)}"), F.lit(b))
    return text
