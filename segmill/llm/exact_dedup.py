"""Exact deduplication over an extendible-hash index on shared files.

The index maps the leading bits of a 64-bit text hash to buckets.  Its
directory starts shallow and doubles: each round counts the bytes that fall
into every open bucket (one aggregation over the narrow key table) and splits
those over capacity by some more bits, until all fit, hold a single key, which
no bit can split, or are as deep as the directory goes.  A bucket that is still
over capacity gets pages, and a row's page follows from its doc_id.

Every row finds its bucket in the directory and is sent to the owner task of
that bucket and page, once and at every size.  The owner sorts its key range,
so rows with one key stand together and form a chain, a link for each text, as
texts are compared byte for byte.  It writes the index: a narrow row per
document with its link.  Only the links of paged buckets, a row for each page
and text, are compared once more across pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.llm.common import documents, shared_table, text_of

#: Buckets that a table would fill evenly, at most, and the least bytes of one.
BUCKETS, LEAST_BYTES = 1 << 16, 32 << 10
#: Bytes that a row takes beside its text.
OVERHEAD = 64
#: Depths of the directory: the first, what one round adds, and the last.
FIRST_BITS, STEP_BITS, MAX_BITS = 8, 2, 24
#: Up to so many rows the directory goes to every task, beyond it is joined by sorting.
DIRECTORY_ROWS = 1 << 20


def _prefix(key: Column, bits: int) -> Column:
    """The leading bits of a key, as a non-negative long."""
    return F.shiftrightunsigned(key, 64 - bits)


def build_directory(entries: DataFrame, capacity: int) -> DataFrame:
    """Rows (depth, prefix, n_bytes, pages) of buckets that together cover every key.

    entries: __key long, __bytes long.  Each round looks at open buckets only.
    Rows number at most 4 for each bucket split, of which every depth has at most
    as many as all bytes hold the capacity.
    """
    done: DataFrame | None = None
    rest, bits = entries, FIRST_BITS
    while True:
        sizes = shared_table(
            rest.groupBy(_prefix(F.col("__key"), bits).alias("prefix")).agg(F.sum("__bytes").alias("n_bytes"), F.min("__key").alias("__low"), F.max("__key").alias("__high")),
            f"exact-directory-{bits}",
        )
        over = (F.col("n_bytes") > capacity) & (F.col("__low") != F.col("__high")) & F.lit(bits < MAX_BITS)
        settled = sizes.filter(~over).select(F.lit(bits).alias("depth"), "prefix", "n_bytes", F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / capacity)).cast("int").alias("pages"))
        done = settled if done is None else done.unionByName(settled)
        split = sizes.filter(over).select(F.col("prefix").alias("__split"))
        if split.isEmpty():
            return shared_table(done, "exact-directory")
        rest = rest.join(split, _prefix(F.col("__key"), bits) == F.col("__split"), "left_semi")
        bits += STEP_BITS


def build_index(docs: DataFrame, capacity: int | None = None, key_bits: int = 64) -> DataFrame:
    """The index, a row per row of docs, laid out by its owners.

    doc_id, __sha; __bucket, __page, __key and __link, which name the row's link;
    within the link and page: __keep (largest doc_id), __n (rows), __nth (1 for
    the row that stays); __pages of the bucket; __head, the text of each page's
    link if there are more pages.  Without a capacity it follows from the bytes
    of all rows.  Fewer key_bits make keys collide, for tests.
    """
    text = text_of()
    key = F.xxhash64(text)
    key = key if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)
    rows = docs.select("doc_id", text.alias("__text"), key.alias("__key"))
    entries = shared_table(rows.select("__key", (F.octet_length("__text") + OVERHEAD).cast("long").alias("__bytes")), "exact-entries")
    if capacity is None:
        capacity = max(LEAST_BYTES, (entries.agg(F.sum("__bytes")).first()[0] or 0) // BUCKETS)
    directory = build_directory(entries, capacity)
    depths = sorted(r.depth for r in directory.select("depth").distinct().collect())  # 9 at most
    found = directory.select("depth", "prefix", "pages").hint("broadcast" if directory.count() <= DIRECTORY_ROWS else "merge")
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("__key"), d).alias("prefix")) for d in depths or [FIRST_BITS]]))
    start = F.expr(f"shiftleft(prefix, 64 - depth) ^ {-(2**63)}").alias("__bucket")
    page = F.pmod(F.xxhash64("doc_id"), F.col("pages")).cast("int").alias("__page")
    placed = rows.withColumn("__at", at).select("*", "__at.depth", "__at.prefix").join(found, ["depth", "prefix"]).select("doc_id", "__text", "__key", start, page, F.col("pages").alias("__pages"))
    chain = Window.partitionBy("__bucket", "__page", "__key")
    link = Window.partitionBy("__bucket", "__page", "__key", "__text")
    index = placed.repartition("__bucket", "__page").withColumns(
        {
            "__nth": F.row_number().over(link.orderBy(F.desc_nulls_last("doc_id"))),
            "__keep": F.max("doc_id").over(link),
            "__n": F.count(F.lit(1)).over(link),
            "__link": F.dense_rank().over(chain.orderBy("__text")),
        }
    )
    head = F.when((F.col("__pages") > 1) & (F.col("__nth") == 1), F.col("__text")).alias("__head")
    return shared_table(index.select("doc_id", "__bucket", "__page", "__pages", "__key", "__link", "__nth", "__keep", "__n", F.unhex(F.sha2("__text", 256)).alias("__sha"), head), "exact-index")


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, read off the index.

    Texts are equal when their bytes are; null counts as empty.  The row with
    the largest doc_id stays (a null doc_id is the smallest); where rows of a
    group share that doc_id, one of them.  An empty table gives an empty one.
    Other columns of docs are not looked at.  Options are build_index()'s.
    """
    index = build_index(docs, **options)
    name = ["__bucket", "__page", "__key", "__link"]
    heads = index.filter("__pages > 1 AND __nth = 1").select(*name, "__head", "__keep", "__n")
    whole = heads.groupBy("__key", "__head").agg(F.max("__keep").alias("__keep_all"), F.sum("__n").alias("__n_all"))
    links = heads.join(whole, ["__key", "__head"]).select(*name, "__keep_all", "__n_all")
    found = index.drop("__head").join(links, name, "left")
    keep = F.when(F.col("__n_all").isNull(), F.col("__keep")).otherwise(F.col("__keep_all"))
    return found.withColumn("keep_id", keep).select(
        "doc_id",
        "keep_id",
        F.coalesce("__n_all", "__n").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__nth") == 1)).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with the columns of docs.

    Which row of a group that is says exact_groups(): the largest doc_id, null
    being the smallest, and one row of those that share it, null and empty texts
    being equal.  An empty table gives an empty one.
    """
    groups = shared_table(exact_groups(docs, **options).filter("group_size > 1").select("doc_id", "keep_id", "kept", "text_sha256"), "exact-groups")
    named = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__hash")).distinct()
    here = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.sha2(text_of(), 256) == F.col("__hash"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    left = docs.join(named(groups.filter(~stays)).hint("merge"), here, "left_anti")  # the same plan at every size
    tied = named(groups.filter(stays & ~F.col("kept")))
    if tied.isEmpty():
        return left
    one = left.join(tied, here, "left_semi").withColumn("__body", text_of()).dropDuplicates(["doc_id", "__body"]).drop("__body")
    return left.join(tied, here, "left_anti").unionByName(one)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP7_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AND row_number() OVER (PARTITION BY text, doc_id) = 1 AS kept,
       sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)
"""
