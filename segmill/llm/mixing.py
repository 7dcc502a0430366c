"""Mixing sources to target weights by systematic sampling.

Within a source, documents are put in a fixed order; each adds its expected
number of copies to a running sum, one offset per source is added, and a
document is emitted once per integer that the sum crosses.  As all documents of
a source expect the same number of copies, the running sum is rank times rate,
so only ranks are needed.  They come from three levels: rows in the size classes
before, rows in the salts of the class before, and the row number in the cell
(source, side, class, salt).  Salts grow with the table, so no task ever holds a
source or a class, however hot.

A source's largest documents come first and expect whole copies: from the largest
down each gets the number that brings the words taken nearest to its rate, so
the running sum is the same before and behind them.  What they leave of the
target is the rate of the others.  Their order goes up by size through one half of them and down
through the other, so what the offset adds on one side it takes on the other,
and the words taken stay near the target.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.llm.common import documents, n_words_of, shared_table, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Rows of a source and class under one salt, about, where one source has them all; 16 salts at least.
SALT_ROWS, LEAST_SALTS = 100_000, 16
#: Classes of the side that goes up are less by this, so they come first; those of the other side are negative.
TURN = 10_000
#: So many of a source's largest documents expect whole copies.
LARGEST = 64


def _source_key(source: Column) -> Column:
    """Never null; orders by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def _size_class(size: Column) -> Column:
    """Digits and leading two digits: sizes in a class differ by 10 % at most, from 10 on."""
    digits = size.cast("string")
    return F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")


def _hashed(doc_id: Column) -> Column:
    """32 random bits of an id, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def _offset(key: Column, seed: int) -> Column:
    """The source's random offset in [0, 1): fixed by its name and the seed."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))


def source_targets(cells: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """One row per source: __key, source_size, target.

    Weights go to the sources in their order, repeating.  The targets share
    `share` times all sizes by weight; none exceeds `cap` times its source's
    size, and what a capped source leaves goes to the others by weight.  Sorted
    by the level at which it is capped, each source's candidate level is what
    the sources before it leave, over the weights from it on; the first level
    that caps nobody else is the one.  The table has a row per source only.
    """
    by_source = cells.groupBy("__key").agg(F.sum("__words").alias("source_size"))
    everyone = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(everyone.orderBy("__key")) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = everyone.orderBy("__ratio", "__key")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    onward = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        by_source.withColumn("__weight", weight)
        .withColumn("__ratio", F.col("source_size") * cap / F.col("__weight"))
        .withColumn("__total", F.sum("source_size").over(everyone) * share)
        .withColumn("__level", (F.col("__total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("__weight").over(onward))
        .withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__key", "__level"))).over(everyone)["__level"])
        .withColumn("target", F.least(F.col("source_size") * cap, F.coalesce(F.col("__level") * F.col("__weight"), F.col("source_size") * cap)))
        .select("__key", "source_size", "target")
    )


def mix(docs: DataFrame, size: str = "size", weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 1) -> DataFrame:
    """docs with source_size, target and copies (long); every row is kept.

    docs has doc_id, source and the non-negative size column; any other columns
    pass through, but for source_size, target and copies, which are replaced.  A
    null source is a source of its own, the last.  Rows that repeat a doc_id are
    separate documents.  An empty table gives an empty one; sources without words
    get target 0 and no copies.  No document gets more than ceil(cap) copies.  The
    same input and seed give the same copies.
    """
    docs = docs.drop(*[c for c in ("source_size", "target", "copies") if c != size])
    salts = max(LEAST_SALTS, -(-docs.count() // SALT_ROWS))
    hashed = _hashed(F.col("doc_id"))
    down = F.pmod(hashed, F.lit(2)) == 1
    rows = docs.withColumns({"__key": _source_key(F.col("source")), "__class": F.when(down, -_size_class(F.col(size))).otherwise(_size_class(F.col(size)) - TURN), "__salt": F.pmod(F.floor(hashed / 2), F.lit(salts))})
    cell = ["__key", "__class", "__salt"]
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__rows"), F.sum(size).alias("__words"))
    targets = source_targets(cells, weights, share, cap)
    largest = _whole_copies(rows.select(*cell, F.col(size).alias("__size"), "doc_id"), targets, cap)
    held = largest.select("__key", F.explode("__list").alias("e")).groupBy("__key", F.col("e.__class").alias("__class"), F.col("e.__salt").alias("__salt"))
    held = held.agg(F.sum("e.n").alias("__held"), F.collect_list(F.struct("e.__size", "e.doc_id", "e.copies")).alias("__largest"))
    cells = cells.join(held, cell, "left").withColumn("__rows", F.col("__rows") - F.coalesce("__held", F.lit(0))).drop("__words", "__held")
    before = lambda w: F.coalesce(F.sum("__rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("source_size") - F.coalesce("__sizes", F.lit(0.0))
    rate = F.when(left > 0, F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), (F.col("target") - F.coalesce("__taken", F.lit(0.0))) / left))).otherwise(F.lit(0.0))
    targets = targets.join(largest.drop("__list"), "__key", "left").select("__key", "source_size", "target", rate.alias("__rate"))
    classes = cells.groupBy("__key", "__class").agg(F.sum("__rows").alias("__rows")).join(targets, "__key").withColumn("__before", before(Window.partitionBy("__key").orderBy("__class")))
    inside = before(Window.partitionBy("__key", "__class").orderBy("__salt"))
    cells = cells.withColumn("__inside", inside).drop("__rows").join(classes.drop("__rows"), ["__key", "__class"])
    cells = cells.select(*cell, "source_size", "target", "__largest", (F.col("__before") + F.col("__inside")).alias("__ahead"), "__rate", _offset(F.col("__key"), seed).alias("__start"))
    own = F.get(F.filter("__largest", lambda e: (e["__size"] == F.col(size)) & e["doc_id"].eqNullSafe(F.col("doc_id"))), 0)["copies"]
    within = Window.partitionBy(*cell).orderBy(F.col("__own").isNotNull(), F.when(F.col("__class") > -TURN / 2, -F.col(size)).otherwise(F.col(size)), "doc_id")
    rank = F.col("__ahead") + F.row_number().over(within)
    crossed = lambda r: F.floor(r * F.col("__rate") + F.col("__start"))
    copies = F.coalesce("__own", crossed(F.col("__rank")) - crossed(F.col("__rank") - 1))
    joined = rows.join(cells, cell).withColumn("__own", own).withColumn("__rank", rank)
    return joined.withColumn("copies", copies.cast("long")).drop(*cell, "__ahead", "__rank", "__rate", "__start", "__largest", "__own")


def _whole_copies(rows: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """__key, __list (class, salt, size, doc_id, n, copies of the largest documents), __sizes and __taken (words of them, and taken of them).

    Rows alike in size and doc_id count together, and none of them where they would be
    more than LARGEST.  From the largest down, copies bring the words taken so far
    nearest to the rate times the words so far.
    """
    order = Window.partitionBy("__key").orderBy(F.desc("__size"), "doc_id")
    first = rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= LARGEST + 1)
    alike = first.groupBy("__key", "__class", "__salt", "__size", "doc_id").agg(F.count("*").alias("n"), F.max("__n").alias("__n")).where(F.col("__n") <= LARGEST)
    lists = alike.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__n", "__class", "__salt", "__size", "doc_id", "n"))).alias("all")).join(targets, "__key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    kind = dict(rows.dtypes)["doc_id"]
    done = f"array<struct<__class:int, __salt:bigint, __size:bigint, doc_id:{kind}, n:bigint, copies:bigint>>"
    start = F.struct(F.lit(0.0).alias("sizes"), F.lit(0.0).alias("taken"), F.array().cast(done).alias("list"))

    def step(s: Column, e: Column) -> Column:
        words = (e["n"] * e["__size"]).cast("double")
        sizes = s["sizes"] + words
        copies = F.when(words > 0, F.least(F.lit(float(math.ceil(cap))), F.greatest(F.lit(0.0), F.floor((F.col("__r") * sizes - s["taken"]) / words + 0.5)))).otherwise(F.lit(0.0))
        one = F.struct(e["__class"].alias("__class"), e["__salt"].alias("__salt"), e["__size"].alias("__size"), e["doc_id"].alias("doc_id"), e["n"].alias("n"), copies.alias("copies"))
        return F.struct(sizes.alias("sizes"), (s["taken"] + copies * words).alias("taken"), F.concat(s["list"], F.array(one).cast(done)).alias("list"))

    folded = lists.withColumn("__r", rate).select("__key", F.aggregate("all", start, step).alias("f"))
    return folded.select("__key", F.col("f.list").alias("__list"), F.col("f.sizes").alias("__sizes"), F.col("f.taken").alias("__taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as it is taken."""
    sized = docs.withColumn("__size", n_words_of(text_of()))
    names = docs.columns
    packed = sized.select("doc_id", "source", "__size", F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    taken = mix(packed, "__size", **options).filter("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).select("__row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = documents(spark, sf_dir).select("doc_id", "source", n_words_of(text_of()).alias("size"))
    mixed = mix(shared_table(sizes, "mix-sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


OP1_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w,
         1.5 * (SELECT sum(source_size) FROM by_source) AS total
  FROM by_source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS ratio,
         (total::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighted),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT lvl FROM levels WHERE lvl <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * w, 2.0::DOUBLE * source_size)) AS target
  FROM levels),
hashed AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS x, length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS class FROM sizes),
valued AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate, coalesce('0' || s.source, '1') AS key,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, s.doc_id NULLS FIRST) AS n
  FROM hashed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
fold AS (
  SELECT key, 0::BIGINT AS n, 0.0::DOUBLE AS sizes, 0.0::DOUBLE AS taken, 0.0::DOUBLE AS copies FROM (SELECT DISTINCT key FROM valued)
  UNION ALL
  SELECT f.key, v.n, f.sizes + v.size, f.taken + v.size * c.copies, c.copies
  FROM fold f JOIN valued v ON v.key = f.key AND v.n = f.n + 1 AND v.n <= 64,
       LATERAL (SELECT CASE WHEN v.size > 0 THEN least(2.0::DOUBLE, greatest(0.0::DOUBLE, floor((v.rate * (f.sizes + v.size) - f.taken) / v.size + 0.5))) ELSE 0.0::DOUBLE END AS copies) c),
ends AS (SELECT key, max_by(sizes, n) AS sizes, max_by(taken, n) AS taken FROM fold GROUP BY key),
ranked AS (
  SELECT v.doc_id, v.source, v.size, v.source_size, v.target,
         CASE WHEN v.source_size - e.sizes > 0 THEN least(2.0::DOUBLE, greatest(0.0::DOUBLE, (v.target - e.taken) / (v.source_size - e.sizes))) ELSE 0.0 END AS rate,
         ('0x' || substr(md5(v.key || ':1'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY v.source, v.n <= 64 ORDER BY x % 2, CASE WHEN x % 2 = 1 THEN -class ELSE class END,
                            (x // 2) % (SELECT greatest(16, (count(*) + 99999) // 100000) FROM sizes),
                            CASE WHEN x % 2 = 1 THEN -size ELSE size END, doc_id NULLS FIRST) AS k,
         f.copies AS own
  FROM valued v JOIN ends e ON e.key = v.key LEFT JOIN fold f ON f.key = v.key AND f.n = v.n)
SELECT doc_id, size, source_size, target, CAST(coalesce(own, floor(k * rate + u) - floor((k - 1) * rate + u)) AS BIGINT) * size AS taken, source,
       CAST(coalesce(own, floor(k * rate + u) - floor((k - 1) * rate + u)) AS BIGINT) AS copies
FROM ranked
"""
