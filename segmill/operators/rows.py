"""Row operators that look at positions, samples and word pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one text that a task numbers: row_ord is cut into blocks of this width.
BLOCK = 1 << 20


def with_index(df: DataFrame, name: str = "index", block: int = BLOCK) -> DataFrame:
    """df with each row's position, from 0, in the order of (text_id, row_ord).

    Rows are counted by block of row_ord, blocks are added up by text, and texts
    by their totals; a task numbers the rows of one block, never of a whole text.
    """
    keyed = df.withColumn("__block", F.floor(F.col("row_ord") / block))
    blocks = keyed.groupBy("text_id", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    texts = blocks.groupBy("text_id").agg(F.sum("__n").alias("__n")).withColumn("__texts", before(Window.partitionBy(F.lit(1)).orderBy("text_id"))).drop("__n")
    starts = blocks.withColumn("__blocks", before(Window.partitionBy("text_id").orderBy("__block"))).drop("__n").join(texts, "text_id")
    nth = F.row_number().over(Window.partitionBy("text_id", "__block").orderBy("row_ord"))
    return keyed.join(starts, ["text_id", "__block"]).withColumn(name, F.col("__texts") + F.col("__blocks") + nth - 1).drop("__block", "__blocks", "__texts")


def sample_size(total: int, percent: float | None, size: int | None) -> int:
    """Rows to hold out: a share of all, a number, or the smaller; a tenth by default."""
    if percent is None and size is None:
        percent = 0.1
    if percent is None:
        return min(size, total)
    share = int(percent * total)
    return share if size is None else min(size, share)


def held_out(df: DataFrame, pool: Column, percent: float | None, size: int | None, seed: int) -> DataFrame:
    """df with held_out: true for exactly the asked number of rows of the pool.

    Rows are ranked by a hash of key and seed.  The first digits of the hash are
    counted; rows below the digits where the size is reached are in, and only
    rows with just those digits are ranked among themselves.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("text_id").cast("string"), F.col("row_ord").cast("string")).cast("binary"))
    hashed = df.withColumns({"__pool": pool, "__hash": digest, "__head": F.substring(digest, 1, 4)})
    counts = hashed.where("__pool").groupBy("__head").count()  # 65,536 rows at most
    wanted = sample_size(counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0], percent, size)
    heads = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(1)).orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = heads.where(F.col("__before") < wanted).withColumn("__inside", F.col("__before") + F.col("count") <= wanted)
    edge = hashed.where("__pool").join(heads.where("NOT __inside"), "__head").withColumn("__rank", F.row_number().over(Window.partitionBy("__head").orderBy("__hash", "text_id", "row_ord")))
    edge = edge.where(F.col("__before") + F.col("__rank") <= wanted).select(F.col("__hash").alias("__edge"))
    inside = heads.where("__inside").select(F.col("__head").alias("__in"))
    marked = hashed.join(F.broadcast(inside), F.col("__head") == F.col("__in"), "left").join(edge, F.col("__hash") == F.col("__edge"), "left")
    return marked.withColumn("held_out", F.col("__pool") & (F.col("__in").isNotNull() | F.col("__edge").isNotNull())).drop("__pool", "__hash", "__head", "__in", "__edge")


# --- word pairs ----------------------------------------------------------------


def inverted(pairs: Column) -> Column:
    """Pairs with source and target index swapped, and all other fields kept."""
    return F.transform(pairs, lambda p: p.withField("source_index", p["target_index"]).withField("target_index", p["source_index"]))


def _score(value: Column) -> Column:
    """Eight digits after the point, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.8f", value), "0+$", ""), r"\.$", "")


def pairs_to_string(pairs: Column, scores: bool = False) -> Column:
    """`i-j` pairs joined by spaces, NULL for index -1; with scores `i-j:translation:alignment` as far as they are known (not negative)."""
    index = lambda i: F.when(i < 0, F.lit("NULL")).otherwise(i.cast("string"))

    def one(p: Column) -> Column:
        text = F.concat_ws("-", index(p["source_index"]), index(p["target_index"]))
        if not scores:
            return text
        first = F.when(p["translation_score"] >= 0, F.concat(F.lit(":"), _score(p["translation_score"]))).otherwise(F.lit(""))
        second = F.when((p["translation_score"] >= 0) & (p["alignment_score"] >= 0), F.concat(F.lit(":"), _score(p["alignment_score"]))).otherwise(F.lit(""))
        return F.concat(text, first, second)

    return F.array_join(F.transform(pairs, one), " ")


def pairs_from_string(text: Column) -> Column:
    """array<struct<source_index, target_index, is_sure, translation_score, alignment_score>>; scores are -1 where not given."""
    index = lambda s: F.when(s == "NULL", F.lit(-1)).otherwise(s.cast("int"))

    def one(item: Column) -> Column:
        fields = F.split(item, ":")
        ends = F.split(F.get(fields, F.lit(0)), "-")
        score = lambda k: F.coalesce(F.get(fields, F.lit(k)).cast("double"), F.lit(-1.0))
        return F.struct(
            index(F.get(ends, F.lit(0))).alias("source_index"),
            index(F.get(ends, F.lit(1))).alias("target_index"),
            F.lit(True).alias("is_sure"),
            score(1).alias("translation_score"),
            score(2).alias("alignment_score"),
        )

    return F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), one)
