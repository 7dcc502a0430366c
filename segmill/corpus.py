"""Corpora as thin wrappers around DataFrames.

A TextCorpus has rows (text_id, row_ord, ref, segment, sentence_start, in_range,
range_start, content_type), a ParallelCorpus the columns of align_rows(), an
AlignmentCorpus (text_id, row_ord, ref, pairs).  Every method adds to the plan
and returns a new corpus; nothing runs before an action.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions import tokens as tk
from segmill.operators import rows as ro
from segmill.operators.align import align_rows

PAIR = "struct<source_index:int,target_index:int,is_sure:boolean,translation_score:double,alignment_score:double>"


class _Algebra:
    """What all corpora share; subclasses name their segment columns."""

    df: DataFrame
    _segments: tuple[str, ...] = ()

    def _with(self, df: DataFrame, **flags):
        return replace(self, df=df, **flags)

    def texts(self) -> DataFrame:
        """Distinct text ids."""
        return self.df.select("text_id").distinct()

    def filter_texts(self, wanted: Sequence[str] | Column | DataFrame):
        """Only rows of the texts listed, of those that a condition on text_id holds for, or of a DataFrame's text_id."""
        if isinstance(wanted, DataFrame):
            return self._with(self.df.join(wanted.select("text_id").distinct(), "text_id", "left_semi"))
        return self._with(self.df.where(wanted if isinstance(wanted, Column) else F.col("text_id").isin(list(wanted))))

    def filter(self, condition: Column | str):
        return self._with(self.df.where(condition))

    def filter_nonempty(self):
        """Rows in which every side has a token."""
        return self._with(self.df.where(self._filled()))

    def _filled(self) -> Column:
        return reduce(lambda a, b: a & b, [F.size(c) > 0 for c in self._segments])

    def filter_by_index(self, condition: Callable[[Column], Column]):
        """condition gets the row's position, from 0 in corpus order."""
        return self._with(ro.with_index(self.df, "__index").where(condition(F.col("__index"))).drop("__index"))

    def take(self, n: int):
        """The first n rows in corpus order."""
        return self._with(self.df.orderBy("text_id", "row_ord").limit(n))

    def transform(self, columns: dict[str, Column], **flags):
        return self._with(self.df.withColumns(columns), **flags)

    def map(self, *columns: Column) -> DataFrame:
        return self.df.select(*columns)

    def map_by_index(self, columns: Callable[[Column], Sequence[Column]]) -> DataFrame:
        return ro.with_index(self.df, "__index").select(*columns(F.col("__index")))

    def count(self, include_empty: bool = True) -> int:
        return self.df.count() if include_empty else self.df.where(self._filled()).count()

    def batch(self, size: int) -> DataFrame:
        """The rows with batch, the number of the chunk of `size` rows they are in."""
        return ro.with_index(self.df, "__index").withColumn("batch", F.floor(F.col("__index") / size)).drop("__index")

    def interleaved_split(self, percent: float | None = None, size: int | None = None, include_empty: bool = True, seed: int = 0) -> DataFrame:
        """The rows with held_out; see split()."""
        pool = F.lit(True) if include_empty else self._filled()
        return ro.held_out(self.df, pool, percent, size, seed)

    def split(self, percent: float | None = None, size: int | None = None, include_empty: bool = True, seed: int = 0):
        """(main, held out): a sample without replacement of exactly the size asked for.

        The size is a share of the rows, a number, or the smaller of both, and a
        tenth by default.  Without include_empty, empty rows are in neither part.
        """
        marked = self.interleaved_split(percent, size, include_empty, seed)
        if not include_empty:
            marked = marked.where(self._filled())
        return self._with(marked.where("NOT held_out").drop("held_out")), self._with(marked.where("held_out").drop("held_out"))


@dataclass(frozen=True)
class TextCorpus(_Algebra):
    df: DataFrame
    is_tokenized: bool = False
    versification: str | None = None

    _segments = ("segment",)

    def tokenize(self, tokenizer: str | Callable[[Column], Column] = "whitespace", force: bool = False) -> TextCorpus:
        if self.is_tokenized and not force:
            return self
        return self.transform({"segment": tk.retokenized(F.col("segment"), tk.tokenizer(tokenizer))}, is_tokenized=True)

    def detokenize(self, detokenizer: str | Callable[[Column], Column] = "whitespace", force: bool = False) -> TextCorpus:
        if not self.is_tokenized and not force:
            return self
        return self.transform({"segment": tk.rejoined(F.col("segment"), tk.detokenizer(detokenizer))}, is_tokenized=False)

    def normalize(self, form: str = "NFC") -> TextCorpus:
        return self.transform({"segment": tk.normalized(F.col("segment"), form)})

    def nfc_normalize(self) -> TextCorpus:
        return self.normalize("NFC")

    def nfd_normalize(self) -> TextCorpus:
        return self.normalize("NFD")

    def nfkc_normalize(self) -> TextCorpus:
        return self.normalize("NFKC")

    def nfkd_normalize(self) -> TextCorpus:
        return self.normalize("NFKD")

    def lowercase(self) -> TextCorpus:
        return self.transform({"segment": tk.lowercased(F.col("segment"))})

    def escape_spaces(self) -> TextCorpus:
        return self.transform({"segment": tk.spaces_escaped(F.col("segment"))})

    def unescape_spaces(self) -> TextCorpus:
        return self.transform({"segment": tk.spaces_unescaped(F.col("segment"))})

    def align_rows(self, target: TextCorpus, alignments: AlignmentCorpus | None = None, all_source_rows: bool = False, all_target_rows: bool = False) -> ParallelCorpus:
        found = align_rows(self.df, target.df, alignments.df if alignments else None, all_source_rows, all_target_rows)
        return ParallelCorpus(found.withColumn("row_ord", F.col("ref")), self.is_tokenized, target.is_tokenized)


@dataclass(frozen=True)
class ParallelCorpus(_Algebra):
    df: DataFrame
    is_source_tokenized: bool = False
    is_target_tokenized: bool = False

    _segments = ("source_segment", "target_segment")

    def _sides(self, make: Callable[[Column], Column], side: str | None) -> dict[str, Column]:
        return {f"{s}_segment": make(F.col(f"{s}_segment")) for s in ("source", "target") if side in (None, s)}

    def tokenize(self, source="whitespace", target=None, force: bool = False) -> ParallelCorpus:
        return self.tokenize_source(source, force).tokenize_target(target or source, force)

    def tokenize_source(self, tokenizer="whitespace", force: bool = False) -> ParallelCorpus:
        if self.is_source_tokenized and not force:
            return self
        return self.transform(self._sides(lambda c: tk.retokenized(c, tk.tokenizer(tokenizer)), "source"), is_source_tokenized=True)

    def tokenize_target(self, tokenizer="whitespace", force: bool = False) -> ParallelCorpus:
        if self.is_target_tokenized and not force:
            return self
        return self.transform(self._sides(lambda c: tk.retokenized(c, tk.tokenizer(tokenizer)), "target"), is_target_tokenized=True)

    def detokenize(self, source="whitespace", target=None, force: bool = False) -> ParallelCorpus:
        found = self
        if self.is_source_tokenized or force:
            found = found.transform(self._sides(lambda c: tk.rejoined(c, tk.detokenizer(source)), "source"), is_source_tokenized=False)
        if self.is_target_tokenized or force:
            found = found.transform(self._sides(lambda c: tk.rejoined(c, tk.detokenizer(target or source)), "target"), is_target_tokenized=False)
        return found

    def normalize(self, form: str = "NFC", side: str | None = None) -> ParallelCorpus:
        return self.transform(self._sides(lambda c: tk.normalized(c, form), side))

    def lowercase(self, side: str | None = None) -> ParallelCorpus:
        return self.transform(self._sides(tk.lowercased, side))

    def escape_spaces(self, side: str | None = None) -> ParallelCorpus:
        return self.transform(self._sides(tk.spaces_escaped, side))

    def unescape_spaces(self, side: str | None = None) -> ParallelCorpus:
        return self.transform(self._sides(tk.spaces_unescaped, side))

    def invert(self) -> ParallelCorpus:
        """Source and target change places, and so do the ends of pairs."""
        swapped = {c: F.col(c.replace("source_", "target_", 1) if c.startswith("source_") else c.replace("target_", "source_", 1)) for c in self.df.columns if c.startswith(("source_", "target_"))}
        return replace(self, df=self.df.withColumns(swapped | {"pairs": ro.inverted(F.col("pairs"))}), is_source_tokenized=self.is_target_tokenized, is_target_tokenized=self.is_source_tokenized)

    def to_tuples(self) -> DataFrame:
        return self.df.select("source_segment", "target_segment")

    def to_table(self, text_id: str = "text", ref: str = "ref", source: str = "source", target: str = "target", alignment: str = "alignment") -> DataFrame:
        """A plain table: segments joined by spaces, pairs as text; for toPandas() or a writer."""
        join = lambda c: F.array_join(c, " ")
        return self.df.select(
            F.col("text_id").alias(text_id), F.col("ref").alias(ref), join("source_segment").alias(source), join("target_segment").alias(target), ro.pairs_to_string(F.col("pairs")).alias(alignment)
        )

    def to_translations(self, source_lang: str, target_lang: str) -> DataFrame:
        """Nested form: translation struct<source, target>, alignment struct<source indices, target indices>."""
        join = lambda c: F.array_join(c, " ")
        ends = lambda c: F.transform("pairs", lambda p: p[c])
        return self.df.select(
            F.col("text_id").alias("text"),
            "ref",
            F.struct(join("source_segment").alias(source_lang), join("target_segment").alias(target_lang)).alias("translation"),
            F.struct(ends("source_index").alias(source_lang), ends("target_index").alias(target_lang)).alias("alignment"),
        )


@dataclass(frozen=True)
class AlignmentCorpus(_Algebra):
    df: DataFrame

    _segments = ("pairs",)

    def filter_texts(self, wanted: Sequence[str] | Column | DataFrame) -> AlignmentCorpus:
        """As for other corpora, but an empty list stands for all texts."""
        return self if isinstance(wanted, (list, tuple, set)) and not wanted else super().filter_texts(wanted)

    def invert(self) -> AlignmentCorpus:
        """Pairs with their ends swapped, each once."""
        return self.transform({"pairs": F.array_distinct(ro.inverted(F.col("pairs")))})


def flatten(corpora: Sequence[TextCorpus | ParallelCorpus | AlignmentCorpus]):
    """All rows of corpora of one kind, in that order; tokenized only if all of them are."""
    if not corpora:
        raise ValueError("there is no corpus to flatten")
    if len({type(c) for c in corpora}) > 1:
        raise TypeError("corpora of different kinds can't be flattened")
    first = corpora[0]
    if len(corpora) == 1:
        return first
    df = reduce(lambda a, b: a.unionByName(b), [c.df.withColumn("corpus_ord", F.lit(i)) for i, c in enumerate(corpora)])
    flags = {name: all(getattr(c, name) for c in corpora) for name in ("is_tokenized", "is_source_tokenized", "is_target_tokenized") if hasattr(first, name)}
    return replace(first, df=df, **flags)


def from_table(
    df: DataFrame, source: str = "source", target: str = "target", text_id: str = "text", ref: str = "ref", alignment: str = "alignment", default_text_id: str = "*all*"
) -> ParallelCorpus:
    """A parallel corpus of any table: a missing text column gives one text, a missing ref column the row's number.

    An empty string is an empty segment.  The alignment, if there is one, is text (see pairs_from_string) or an array of pairs.
    """
    segment = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.array(c))
    kinds = dict(df.dtypes)
    pairs = F.expr(f"CAST(NULL AS array<{PAIR}>)")
    if alignment in kinds:
        pairs = ro.pairs_from_string(F.col(alignment)) if kinds[alignment] == "string" else F.col(alignment)
    key = F.col(ref) if ref in kinds else F.monotonically_increasing_id()
    flags = {f"{s}_{f}": F.lit(f == "sentence_start") for s in ("source", "target") for f in ("sentence_start", "in_range", "range_start")}
    return ParallelCorpus(
        df.select(
            (F.col(text_id) if text_id in kinds else F.lit(default_text_id)).alias("text_id"), key.alias("ref"), segment(source).alias("source_segment"), segment(target).alias("target_segment"), pairs.alias("pairs"),
        )
        .withColumns({"row_ord": F.col("ref"), "source_refs": F.array("ref"), "target_refs": F.array("ref"), "content_type": F.lit("segment")} | flags)
    )


def from_translations(df: DataFrame, source_lang: str, target_lang: str, translation: str = "translation", alignment: str = "alignment", **names) -> ParallelCorpus:
    """A parallel corpus of a nested table: translation is a map or struct by language, or struct<language, translation> arrays side by side."""
    kind = dict(df.dtypes)[translation]
    if kind.startswith("struct<language:array"):
        at = lambda lang: F.get(F.transform(F.filter(F.arrays_zip(f"{translation}.language", f"{translation}.translation"), lambda x: x["language"] == lang), lambda x: x["translation"]), F.lit(0))
    else:
        at = lambda lang: F.col(translation)[lang]
    df = df.withColumns({"__source": at(source_lang), "__target": at(target_lang)})
    if alignment in df.columns:
        ends = lambda lang: F.col(alignment)[lang]
        zipped = F.zip_with(ends(source_lang), ends(target_lang), lambda s, t: F.struct(s.cast("int").alias("source_index"), t.cast("int").alias("target_index"), F.lit(True).alias("is_sure"), F.lit(-1.0).alias("translation_score"), F.lit(-1.0).alias("alignment_score")))
        df = df.withColumn(alignment, zipped)
    return from_table(df, source="__source", target="__target", alignment=alignment, **names)
