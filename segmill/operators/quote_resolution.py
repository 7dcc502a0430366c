"""Resolving quotation marks: direction and depth of each, what is wrong with a chapter's, and rewriting them.

A segment table has a row for each run of text: keys (a chapter), ord (its
order there), verse, paragraph (whether a paragraph starts with it), embedded
(whether a note or a verse number stands before it) and text.  A mark table has
a row for each mark with all that rules ask of its surroundings, so that
resolving is one pass over a chapter's marks, whose state is the stack of open
marks.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from segmill.functions import characters as ch
from segmill.functions.tokens import apart
from segmill.operators import quotes as qu

OPENING, CLOSING = "opening", "closing"
#: Issues of a chapter.
UNPAIRED, DEEP, INCOMPATIBLE, AMBIGUOUS, UNEXPECTED = "unpaired", "too_deep", "incompatible", "ambiguous", "unexpected"
#: Marks are open in no more than so many levels.
DEEPEST = 4

#: Marks found are gathered in blocks, so that none is copied more than a block's times.
BLOCK = 128

# Punctuation that may follow a closing mark.
AFTER = r"^[.,;?!)\]\-—۔،؛]$"
APOSTROPHES = ("'", "’", "‘")


class Conventions:
    """What a set of conventions, by name, says of marks."""

    def __init__(self, names: Iterable[str] = qu.CONVENTIONS):
        self.levels = {name: qu.levels(qu.CONVENTIONS[name]) for name in names}
        every = [(d, a, b) for pairs in self.levels.values() for d, (a, b) in enumerate(pairs, 1)]
        self.pairs = sorted({(a, b) for _, a, b in every})
        self.placed = sorted({(d, OPENING, a) for d, a, _ in every} | {(d, CLOSING, b) for d, _, b in every})

    def opens(self, mark: Column) -> Column:
        return mark.isin(sorted({a for a, _ in self.pairs}))

    def closes(self, mark: Column) -> Column:
        return mark.isin(sorted({b for _, b in self.pairs}))

    def paired(self, opening: Column, closing: Column) -> Column:
        return F.coalesce(F.concat_ws("\t", opening, closing).isin(["\t".join(p) for p in self.pairs]), F.lit(False))

    def stands_at(self, mark: Column, depth: Column, direction: str) -> Column:
        return F.concat_ws("\t", depth.cast("string"), mark).isin([f"{d}\t{m}" for d, r, m in self.placed if r == direction])

    def least_depth(self, mark: Column, direction: str) -> Column:
        """The outermost level that has the mark, null if none has."""
        least: dict[str, int] = {}
        for d, r, m in self.placed:
            if r == direction:
                least[m] = min(d, least.get(m, d))
        found = F.lit(None).cast("int")
        for m, d in least.items():
            found = F.when(mark == m, d).otherwise(found)
        return found


def segments(books: DataFrame) -> DataFrame:
    """The segment table of books (book, chapter, verse, position, style, text): chapters are keys, headings are left out.

    A run starts a paragraph unless the run before it is of the same style and another verse.
    """
    order = Window.partitionBy("book", "chapter").orderBy("position")
    before = lambda c: F.lag(c).over(order)
    goes_on = (before("style") == F.col("style")) & (before("verse") != F.col("verse"))
    placed = books.withColumns({"paragraph": ~F.coalesce(goes_on, F.lit(False)), "embedded": F.lit(True)})
    return placed.where("verse <> '0'").select("book", "chapter", F.col("position").alias("ord"), "verse", "paragraph", "embedded", "text")


def placed_marks(rows: DataFrame, conventions: Conventions, *keys: str) -> DataFrame:
    """The mark table of a segment table: keys, ord, verse, nth (in the chapter), start, end, mark, and what surrounds it."""
    in_verse = Window.partitionBy(*keys, "verse").orderBy("ord")
    beside = {
        "__last": F.when(~F.col("paragraph"), F.right(F.lag("text").over(in_verse), F.lit(1))),
        "__first": F.when(~F.lead("paragraph").over(in_verse), F.left(F.lead("text").over(in_verse), F.lit(1))),
    }
    # One exchange for all windows: they part rows by the keys and more.
    held = rows.where("text <> ''").repartition(*keys).withColumns({**beside, "__length": F.length("text")})
    found = qu.find_marks(held, F.col("text"), *keys, "ord", carry=("verse", "paragraph", "embedded", "__last", "__first", "__length")).withColumnRenamed("nth", "__nth")
    known = found.where(conventions.opens(F.col("mark")) | conventions.closes(F.col("mark")))
    order = Window.partitionBy(*keys).orderBy("ord", "__nth")
    end = F.col("position") + F.length("mark")
    previous = F.when(F.col("position") == 0, F.nullif("__last", F.lit(""))).otherwise(F.col("before"))
    following = F.when(end == F.col("__length"), F.nullif("__first", F.lit(""))).otherwise(F.col("after"))
    has = lambda c, pattern: F.coalesce(c.rlike(pattern), F.lit(False))
    white, latin = rf"^(?:{ch.white()}|~)$", r"^\p{IsLatin}$"
    marks = known.withColumns({"start": F.col("position"), "end": end, "previous": previous, "following": following, "nth": F.row_number().over(order)})
    return marks.select(
        *keys, "ord", "verse", "nth", "start", "end", "mark", "paragraph", F.col("previous").alias("previous"), F.col("__length").alias("length"),
        conventions.opens(F.col("mark")).alias("opens"), conventions.closes(F.col("mark")).alias("closes"),
        F.when(F.col("previous").isNull(), F.col("paragraph") | F.col("embedded")).otherwise(has(F.col("previous"), white)).alias("white_before"),
        has(F.col("following"), white).alias("white_after"), has(F.col("following"), AFTER).alias("mark_after"),
        F.coalesce(conventions.closes(F.col("following")), F.lit(False)).alias("closing_after"),
        "introduced",
        (has(F.col("previous"), latin) & has(F.col("following"), latin)).alias("in_word"), has(F.col("previous"), "^s$").alias("after_s"),
        (F.col("start") == 0).alias("at_start"), (F.col("end") == F.col("__length")).alias("at_end"),
        F.coalesce(F.lead("start").over(order) == F.col("end"), F.lit(False)).alias("joined_to_next"), F.lead("mark").over(order).alias("next_mark"),
    )


def _chapters(marks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    columns = [c for c in marks.columns if c not in keys and c != "nth"]
    return marks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("nth", *columns))).alias("marks"))


#: What a pass over a chapter's marks gives.
FOUND = "array<struct<nth:int,ord:bigint,start:int,end:int,mark:string,depth:int,direction:string>>"


def _one(m: Column, depth: Column, direction: str) -> Column:
    return F.array(F.struct(m["nth"].cast("int").alias("nth"), m["ord"].cast("long").alias("ord"), m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end"), m["mark"].alias("mark"), depth.cast("int").alias("depth"), F.lit(direction).alias("direction")))


NO_MARKS = f"CAST(array() AS {FOUND})"


def _none_found() -> Column:
    return F.struct(F.expr(f"CAST(array() AS array<{FOUND}>)").alias("full"), F.expr(NO_MARKS).alias("last"))


def _more(found: Column, out: Column) -> Column:
    whole = F.size(found["last"]) >= BLOCK
    return F.struct(F.when(whole, F.concat(found["full"], F.array(found["last"]))).otherwise(found["full"]).alias("full"), F.when(whole, out).otherwise(F.concat(found["last"], out)).alias("last"))


def _all_found(found: Column) -> Column:
    return F.concat(F.flatten(found["full"]), found["last"])


def resolve(marks: DataFrame, conventions: Conventions, *keys: str, paragraphs: bool = True) -> DataFrame:
    """keys, found (marks with depth and direction), issues of each chapter, by a stack of open marks.

    A mark opens, closes, is an apostrophe, or goes on with open quotations at
    the start of a paragraph: it repeats the opening marks (English) or has
    closing ones (Spanish), one for each level.  With paragraphs, only there.
    """
    return _chapters(marks, keys).select(*keys, _by_stack(conventions, paragraphs).alias("r")).select(*keys, "r.found", "r.issues")


def _by_stack(conventions: Conventions, paragraphs: bool) -> Column:
    """struct<found, issues> of an array of marks."""
    stack = _Stack(conventions, paragraphs)

    @arrow_udf(f"struct<found:{FOUND},issues:array<string>>")
    def by_stack(marks: pa.Array) -> pa.Array:
        return stack.resolved(marks)

    return apart(by_stack)("marks")


class _Stack:
    """The pass over each chapter's marks, a batch of chapters at a time."""

    def __init__(self, conventions: Conventions, paragraphs: bool):
        self.paragraphs, self.pairs, self.placed = paragraphs, frozenset(conventions.pairs), frozenset(conventions.placed)

    def action(self, m: tuple, stack: list[str], again: int, style: str) -> str:
        (mark, opens, closes, previous, paragraph, white_before, white_after, mark_after, closing_after, introduced, in_word, after_s, at_start, at_end, joined_to_next, next_mark) = m
        depth = len(stack)
        top = stack[-1] if stack else None
        after = white_after or mark_after
        pair = (top, mark) in self.pairs
        due = stack[again] if again < depth and (paragraph or not self.paragraphs) else None  # the level that a repeated mark would stand for
        begins = at_start and (depth <= 1 or joined_to_next)
        if opens and (not closes or ((white_before or (top is not None and top == previous) or introduced) and not after)):
            if style != "spanish" and mark == due and (again > 0 or begins):
                return "english"
            return DEEP if depth >= DEEPEST else "open"
        if mark in APOSTROPHES:
            possessive = after_s and after and (not pair or (top, next_mark) in self.pairs)
            if in_word or possessive or (mark == "'" if not stack else not pair):
                return "none"
        if closes and (not opens or ((after or at_end or closing_after) and not white_before)):
            if style != "english" and (due, mark) in self.pairs and (again > 0 or (begins and mark == "»")):
                return "spanish"
            return "close" if stack else UNPAIRED
        if closes and pair and (at_end or not white_after or white_before):
            return "close"
        if opens and (introduced or (white_before and white_after and not stack)):
            return "open"
        return UNPAIRED if closes and not stack and not white_before and (at_end or white_after) else AMBIGUOUS

    def resolved(self, marks: pa.Array) -> pa.Array:
        every = marks.flatten()
        fields = {every.type.field(k).name: every.field(k) for k in range(every.type.num_fields)}
        asked = ("mark", "opens", "closes", "previous", "paragraph", "white_before", "white_after", "mark_after", "closing_after", "introduced", "in_word", "after_s", "at_start", "at_end", "joined_to_next", "next_mark")
        rows = zip(*[fields[c].to_pylist() for c in asked], strict=True)
        taken, depths, directions, offsets, issues = [], [], [], [0], []
        k = 0
        for n in pc.list_value_length(marks).to_pylist():
            stack, again, style, wrong = [], 0, "", set()
            for k, m in enumerate(islice(rows, n), k):
                done, depth = self.action(m, stack, again, style), len(stack)
                if done in ("english", "spanish"):
                    depth, direction, style = again + 1, OPENING, done
                    again = 0 if again + 1 == len(stack) else again + 1
                elif done == "open":
                    stack.append(m[0])
                    depth, direction = depth + 1, OPENING
                elif done == "close":
                    stack.pop()
                    direction = CLOSING
                else:
                    if done != "none":
                        wrong.add(done)
                    continue
                if done in ("open", "close") and (depth, direction, m[0]) not in self.placed:
                    wrong.add(INCOMPATIBLE)
                taken.append(k)
                depths.append(depth)
                directions.append(direction)
            k += n > 0
            offsets.append(len(taken))
            issues.append(sorted(wrong | {UNPAIRED} if stack else wrong))
        own = pa.array(taken, pa.int64())
        held = {"nth": pa.int32(), "ord": pa.int64(), "start": pa.int32(), "end": pa.int32(), "mark": pa.string()}
        columns = {c: fields[c].take(own).cast(t) for c, t in held.items()} | {"depth": pa.array(depths, pa.int32()), "direction": pa.array(directions, pa.string())}
        found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))
        return pa.StructArray.from_arrays([found, pa.array(issues, pa.list_(pa.string()))], ["found", "issues"])


def resolve_singly(marks: DataFrame, conventions: Conventions, *keys: str) -> DataFrame:
    """keys, found, issues of each chapter without a stack: each mark by its surroundings, at the outermost level that has it."""
    return _chapters(marks, keys).select(*keys, _one_by_one(conventions).alias("r")).select(*keys, "r.found", "r.issues")


def _one_by_one(conventions: Conventions) -> Column:
    """struct<found, issues> of an array of marks."""
    empty = F.struct(F.lit("").alias("last"), F.lit(-1).cast("long").alias("ord"), F.lit(-1).alias("end"), _none_found().alias("found"), F.expr("CAST(array() AS array<string>)").alias("issues"))

    def step(s: Column, m: Column) -> Column:
        both = m["opens"] & m["closes"]
        behind_opening = (s["last"] == OPENING) & (s["ord"] == m["ord"]) & (s["end"] == m["start"])
        opening = (m["opens"] & ~m["closes"]) | (both & (m["at_start"] | m["white_before"] | behind_opening | m["introduced"]) & ~(m["white_after"] | m["mark_after"]))
        closing = (m["closes"] & ~m["opens"]) | (both & (m["white_after"] | m["mark_after"] | m["at_end"]) & ~m["white_before"])
        clear = opening | closing
        opens = F.when(opening, True).when(closing, False).otherwise(s["last"] != OPENING)
        depth = F.when(opens, conventions.least_depth(m["mark"], OPENING)).otherwise(conventions.least_depth(m["mark"], CLOSING))
        out = F.when(depth.isNull(), F.expr(f"CAST(array() AS {FOUND})")).when(opens, _one(m, depth, OPENING)).otherwise(_one(m, depth, CLOSING))
        issue = F.when(~clear, AMBIGUOUS).when(depth.isNull(), UNEXPECTED)
        return F.struct(
            F.when(depth.isNull(), s["last"]).when(opens, OPENING).otherwise(CLOSING).alias("last"),
            F.when(depth.isNull(), s["ord"]).otherwise(m["ord"].cast("long")).alias("ord"), F.when(depth.isNull(), s["end"]).otherwise(m["end"].cast("int")).alias("end"),
            _more(s["found"], out).alias("found"), F.when(issue.isNotNull(), F.array_union(s["issues"], F.array(issue))).otherwise(s["issues"]).alias("issues"),
        )

    finish = lambda s: F.struct(_all_found(s["found"]).alias("found"), F.array_sort(s["issues"]).alias("issues"))
    return F.aggregate("marks", empty, step, finish)


# --- which conventions can be meant --------------------------------------------------

# Shares and counts by which a mark is taken for an apostrophe, or for one of a pair.
NEGLIGIBLE, RARE, ALIKE, MID_WORD, APOSTROPHES_PER_CHARACTER = 0.01, 0.1, 0.3, 0.3, 0.02
SOLE, MUCH_MORE, SAME_RATE = 5, 10, 0.2


def mark_statistics(rows: DataFrame, marks: DataFrame, conventions: Conventions, group: str, *keys: str) -> DataFrame:
    """group, mark, n, all, initial, middle, final, apostrophes, characters, earlier, later of all marks of a group of chapters.

    earlier and later count the verses in which a mark stands before its partner
    or after it, where each stands there once; a mark that both opens and closes
    counts in both if it stands there twice and no other partner does.
    """
    n = lambda c: F.count_if(c)
    straight = F.col("mark").isin("'", "’")
    initial = straight & ~F.col("white_after") & (F.col("at_start") | F.col("white_before"))
    middle = straight & ~initial & ~F.col("white_after") & ~F.col("white_before")
    final = straight & ~initial & ~middle & (F.col("at_end") | F.col("white_after")) & ~F.col("white_before")
    by_mark = marks.groupBy(group, "mark").agg(F.count(F.lit(1)).alias("n"), n(initial).alias("initial"), n(middle).alias("middle"), n(final).alias("final"))
    whole = marks.groupBy(group).agg(F.count(F.lit(1)).alias("all"), n(straight).alias("apostrophes"))
    characters = rows.groupBy(group).agg(F.sum(F.length("text")).alias("characters"))

    verse = list(dict.fromkeys([group, *keys, "verse"]))
    held = marks.groupBy(*verse, "mark").agg(F.count(F.lit(1)).alias("k"), F.min("nth").alias("at"))
    spark = marks.sparkSession
    pairs = F.broadcast(spark.createDataFrame(conventions.pairs, "mark string, partner string"))  # the conventions' own
    other = held.select(*verse, F.col("mark").alias("partner"), F.col("k").alias("__k"), F.col("at").alias("__at"))
    met = held.where("k = 1").join(pairs.where("mark <> partner"), "mark").join(other.where("__k = 1"), [*verse, "partner"]).where(F.col("at") < F.col("__at"))
    either = pairs.where("mark <> partner").unionByName(pairs.where("mark <> partner").select(F.col("partner").alias("mark"), F.col("mark").alias("partner")))
    twins = held.where("k = 2").join(pairs.where("mark = partner").select("mark"), "mark").join(either.join(other, "partner").select(*verse, "mark").distinct(), [*verse, "mark"], "left_anti")
    seen = met.select(group, "mark", F.lit(1).alias("e"), F.lit(0).alias("l")).unionAll(met.select(group, F.col("partner"), F.lit(0), F.lit(1))).unionAll(twins.select(group, "mark", F.lit(1), F.lit(1)))
    order = seen.groupBy(group, "mark").agg(F.sum("e").alias("earlier"), F.sum("l").alias("later"))
    return by_mark.join(whole, group).join(characters, group).join(order, [group, "mark"], "left").fillna(0, ["earlier", "later"])


def compatible_conventions(statistics: DataFrame, conventions: Conventions, group: str) -> DataFrame:
    """group, name of the conventions that the observed opening and closing marks fit."""
    share = lambda c: F.col(c) / (F.col("initial") + F.col("middle") + F.col("final"))
    placed = F.col("initial") + F.col("middle") + F.col("final") > 0
    apart = placed & ((share("initial") < RARE) | (share("final") < RARE) | ((F.abs(share("initial") - share("final")) < ALIKE) & (share("middle") > MID_WORD)))
    only_apostrophe = F.col("mark").isin("'", "’") & (F.coalesce(apart, F.lit(False)) | (F.col("apostrophes") > APOSTROPHES_PER_CHARACTER * F.col("characters")))
    usual = (F.col("n") >= NEGLIGIBLE * F.col("all")) & ~only_apostrophe
    more = lambda a, b: ((F.col(b) == 0) & (F.col(a) > SOLE)) | (F.col(a) > MUCH_MORE * F.col(b))
    both_ways = F.col("mark").isin([a for a, b in conventions.pairs if a == b])
    alike = (F.col("earlier") > 0) & (F.abs(F.col("later") - F.col("earlier")) < SAME_RATE * (F.col("later") + F.col("earlier"))) & both_ways
    opens, closes = conventions.opens(F.col("mark")), conventions.closes(F.col("mark"))
    judged = statistics.where(usual).select(group, "mark", (opens & (more("earlier", "later") | alike)).alias("opening"), (closes & (more("later", "earlier") | alike)).alias("closing"))
    seen = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), F.col("mark"))))
    observed = judged.groupBy(group).agg(seen("opening").alias("opening"), seen("closing").alias("closing"))
    named = [(name, [a for a, _ in levels], [b for _, b in levels]) for name, levels in conventions.levels.items()]
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, a)).alias("a"), F.array(*map(F.lit, b)).alias("b")) for n, a, b in named]))
    each = observed.withColumn("c", names)
    fits = (F.size(F.array_except("opening", "c.a")) == 0) & (F.size(F.array_except("closing", "c.b")) == 0)
    first = F.array_contains(F.col("opening"), F.get("c.a", F.lit(0))) & F.array_contains(F.col("closing"), F.get("c.b", F.lit(0)))
    return each.where(fits & first).select(group, F.col("c.name").alias("name"))


# --- rewriting ------------------------------------------------------------------------


def works_singly(source: str, target: str) -> bool:
    """Whether each mark of a convention stands for one mark of the other, at whatever level."""
    for side in (0, 1):
        found: dict[str, set[str]] = {}
        for old, new in zip(qu.levels(qu.CONVENTIONS[source]), qu.levels(qu.CONVENTIONS[target]), strict=False):
            found.setdefault(old[side], set()).add(new[side])
        if any(len(x) > 1 for x in found.values()):
            return False
    return True


def strategy(issues: Column, singly: bool) -> Column:
    """How a chapter is rewritten: full (by depth), singly or skip."""
    broken = F.array_contains(issues, UNPAIRED) | F.array_contains(issues, DEEP)
    return F.when(F.array_contains(issues, AMBIGUOUS), "skip").when(broken, "singly" if singly else "skip").otherwise("full")


def rewritten(rows: DataFrame, source: str, target: str, *keys: str) -> DataFrame:
    """keys, ord, verse, text, strategy: the segment table's texts with marks of the target convention, chapter by chapter.

    Marks deeper than the target's levels, and apostrophes, stay.
    """
    own = Conventions([source])
    chapters = _chapters(placed_marks(rows, own, *keys), keys).select(*keys, F.get("marks", F.lit(0))["ord"].alias("first"), "marks", _by_stack(own, False).alias("r"))
    planned = chapters.withColumn("strategy", strategy(F.col("r.issues"), works_singly(source, target)))
    # Chapters are resolved singly only where that is asked for.
    chosen = planned.select(*keys, "first", "strategy", F.explode_outer(F.when(F.col("strategy") == "full", F.col("r.found")).when(F.col("strategy") == "singly", _one_by_one(own)["found"])).alias("m"))
    new = F.lit(None).cast("string")
    for depth, pair in enumerate(qu.levels(qu.CONVENTIONS[target]), 1):
        for direction, mark in zip((OPENING, CLOSING), pair, strict=True):
            new = F.when((F.col("m.depth") == depth) & (F.col("m.direction") == direction), mark).otherwise(new)
    change = F.when(F.col("m").isNotNull(), F.struct("m.start", "m.end", F.coalesce(new, "m.mark").alias("mark")))
    # A chapter without changes still says its strategy, at its first mark's segment; from there all others learn it.
    changes = chosen.groupBy(*keys, F.coalesce("m.ord", "first").alias("ord")).agg(F.sort_array(F.collect_list(change)).alias("changes"), F.first("strategy").alias("__strategy"))
    joined = rows.join(changes, [*keys, "ord"], "left").withColumn("strategy", F.max("__strategy").over(Window.partitionBy(*keys)))
    # Pieces between changes, each followed by its new mark.
    kept = F.expr("transform(changes, (c, i) -> concat(substring(text, if(i = 0, 0, changes[i - 1].end) + 1, c.start - if(i = 0, 0, changes[i - 1].end)), c.mark))")
    rest = F.expr("substring(text, element_at(changes, -1).end + 1)")
    text = F.when(F.coalesce(F.size("changes"), F.lit(0)) < 1, F.col("text")).otherwise(F.concat(F.array_join(kept, ""), rest))
    return joined.select(*keys, "ord", "verse", text.alias("text"), F.coalesce("strategy", F.lit("full")).alias("strategy"))
