"""Aligning two or more corpora row by row.

A corpus is a DataFrame of segments: text_id, ref, segment (array<string>),
sentence_start, in_range, range_start (boolean), content_type.  Rows meet by
equality of (text_id, ref); any orderable ref type will do.  Rows of a range (a
run of rows of which the first holds the text) are merged with what they meet,
which needs the order of refs: only texts that have ranges take that path.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["text_id", "ref"]
SIDE = ["segment", "sentence_start", "in_range", "range_start", "content_type"]


def text_universe(corpora: Sequence[DataFrame], all_rows: Sequence[bool]) -> DataFrame:
    """text_id of the texts that can have rows: those in every corpus, and all of corpora with all_rows."""
    ids = [c.select("text_id").distinct() for c in corpora]
    shared = reduce(lambda a, b: a.join(b, "text_id", "left_semi"), ids)
    return reduce(lambda a, b: a.unionByName(b), [i for i, every in zip(ids, all_rows, strict=True) if every], shared).distinct()


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _steps(corpora: Sequence[DataFrame], all_rows: Sequence[bool]) -> DataFrame:
    """One row per ref and combination of rows: text_id, ref, s0, s1, ... (structs, null if absent).

    Inner joins where no side asks for all its rows and none has ranges would do,
    but ranges may start at a ref that others lack; the filter after the outer
    join is what keeps texts without ranges to their matches.
    """
    universe = text_universe(corpora, all_rows)
    sides = [c.join(universe, "text_id", "left_semi").select(*KEY, F.struct(*SIDE).alias(f"s{i}")) for i, c in enumerate(corpora)]
    return reduce(lambda a, b: a.join(b, KEY, "full"), sides)


def align_n(corpora: Sequence[DataFrame], all_rows: Sequence[bool] | None = None) -> DataFrame:
    """text_id, ref, refs, segments, sentence_starts, in_ranges, range_starts (arrays with an entry per corpus), content_type.

    A ref that all corpora have gives a row for each combination of its rows.  A
    ref that some lack gives a row of the sides with all_rows, if there are any.
    In a range, rows are collected into one until a new range or an ordinary row
    starts: where all sides are present, if a side is in a range and no other
    side has all_rows; where some are absent, if a present side is in a range and
    an absent one has not all_rows.  A merged row has the refs and segments of
    all that it collected and is no range itself.  Absent sides of ordinary rows
    take the ref of the present ones.  ref is the row's first ref.
    """
    n = len(corpora)
    every = list(all_rows) if all_rows is not None else [False] * n
    steps = _steps(corpora, every)
    here = [F.col(f"s{i}").isNotNull() for i in range(n)]
    ranged = [F.coalesce(F.col(f"s{i}.in_range"), F.lit(False)) for i in range(n)]
    whole = _all(here)
    merges_whole = _any([ranged[i] & F.lit(not any(every[j] for j in range(n) if j != i)) for i in range(n)])
    merges_part = _any(ranged) & _any([~here[i] & F.lit(not every[i]) for i in range(n)])
    merges = F.when(whole, merges_whole).otherwise(merges_part)
    shown = [here[i] & (whole | F.lit(every[i])) for i in range(n)]
    fresh = whole & _all([~here[i] | F.coalesce(F.col(f"s{i}.range_start"), F.lit(False)) | ~ranged[i] for i in range(n)])
    kind = F.when(merges, F.lit("merge")).when(_any(shown), F.lit("row")).otherwise(F.lit("drop"))
    steps = steps.withColumns({"__kind": kind, "__fresh": fresh}).filter("__kind <> 'drop'")

    def parts(refs: Column, segments: Column, starts: Column, in_ranges: Column, range_starts: Column, content: Column, first: Column) -> list[Column]:
        return [
            F.col("text_id"), first.alias("ref"), refs.alias("refs"), segments.alias("segments"), starts.alias("sentence_starts"), in_ranges.alias("in_ranges"), range_starts.alias("range_starts"), content.alias("content_type"),
        ]

    none = F.expr("CAST(array() AS array<string>)")
    flag = lambda i, name: F.when(shown[i], F.col(f"s{i}.{name}")).otherwise(F.lit(False))
    last_type = F.coalesce(*[F.when(shown[i], F.col(f"s{i}.content_type")) for i in reversed(range(n))])
    rows = steps.filter("__kind = 'row'").select(
        *parts(
            F.array(*[F.array("ref")] * n),
            F.array(*[F.when(shown[i], F.col(f"s{i}.segment")).otherwise(none) for i in range(n)]),
            F.array(*[flag(i, "sentence_start") for i in range(n)]),
            F.array(*[flag(i, "in_range") for i in range(n)]),
            F.array(*[flag(i, "range_start") for i in range(n)]),
            last_type,
            F.col("ref"),
        )
    )
    # Only texts with merges need order.  The i-th island is the i-th run of merges that no row or fresh range breaks.
    order = Window.partitionBy("text_id").orderBy("ref")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged_texts = steps.filter("__kind = 'merge'").select("text_id").distinct()
    broken = (F.col("__kind") == "row") | F.col("__fresh") | F.coalesce(F.lag("__kind").over(order) == "row", F.lit(True))
    islands = steps.join(ranged_texts, "text_id", "left_semi").withColumn("__break", broken.cast("int")).withColumn("__island", F.sum("__break").over(so_far)).filter("__kind = 'merge'")
    collected = islands.groupBy("text_id", "__island").agg(F.array_sort(F.collect_list(F.struct("ref", *[f"s{i}" for i in range(n)]))).alias("__all"), F.min("ref").alias("__first"))
    side = lambda i: F.filter("__all", lambda x: x[f"s{i}"].isNotNull())

    def field(i: int, name: str) -> Column:
        return F.transform(side(i), lambda x: x[f"s{i}"][name])

    def start(i: int) -> Column:
        with_text = F.filter(side(i), lambda x: F.size(x[f"s{i}"]["segment"]) > 0)
        return F.coalesce(F.get(with_text, F.lit(0))[f"s{i}"]["sentence_start"], F.try_element_at(side(i), F.lit(-1))[f"s{i}"]["sentence_start"], F.lit(False))

    merged = collected.select(
        *parts(
            F.array(*[F.transform(side(i), lambda x: x["ref"]) for i in range(n)]),
            F.array(*[F.flatten(field(i, "segment")) for i in range(n)]),
            F.array(*[start(i) for i in range(n)]),
            F.array(*[F.lit(False)] * n),
            F.array(*[F.lit(False)] * n),
            F.coalesce(*[F.try_element_at(side(i), F.lit(-1))[f"s{i}"]["content_type"] for i in reversed(range(n))]),
            F.col("__first"),
        )
    )
    return rows.unionByName(merged)


def align_rows(source: DataFrame, target: DataFrame, alignments: DataFrame | None = None, all_source_rows: bool = False, all_target_rows: bool = False) -> DataFrame:
    """Parallel rows of two corpora; see align_n.

    alignments (text_id, ref, pairs) are looked up by the row's first ref where
    both sides have tokens; pairs is null where there are none.
    """
    rows = align_n([source, target], [all_source_rows, all_target_rows])
    names = {"segments": "segment", "sentence_starts": "sentence_start", "in_ranges": "in_range", "range_starts": "range_start", "refs": "refs"}
    sides = [F.get(many, F.lit(i)).alias(f"{side}_{one}") for i, side in enumerate(("source", "target")) for many, one in names.items()]
    found = rows.select(*KEY, *sides, "content_type")
    if alignments is None:
        return found.withColumn("pairs", F.expr("CAST(NULL AS array<struct<source_index:int,target_index:int>>)"))
    full = (F.size("source_segment") > 0) & (F.size("target_segment") > 0)
    pairs = alignments.select("text_id", "ref", "pairs")
    return found.join(pairs, KEY, "left").withColumn("pairs", F.when(full, F.col("pairs")))
