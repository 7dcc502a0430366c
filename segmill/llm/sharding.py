"""Sharding into equal byte ranges by histogram sort.

Documents are ordered by a hash of their text, so equal texts stay together.
Splitters are found without moving rows: candidate boundaries are probed, the
exact bytes between neighbouring probes are counted in every partition and
added up, and each splitter's interval is narrowed to the two probes around its
target, until it is within tolerance or a single key.  Then rows move once.

A text whose copies hold more bytes than a shard should gets a shard to itself
and the rest share the others, as no splitter can divide it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.llm.common import documents, shared_table, text_of

SHARDS = 24
#: Bytes that a document takes beside its text.
OVERHEAD = 8
#: A splitter is settled within this share of a shard.
TOLERANCE = 0.0005
#: Probes over the whole key space at first, then for each open splitter.
FIRST_PROBES = 4095
PROBES = 63
#: Rows of a shard that one task numbers.
CELL_ROWS = 100_000
LOW, HIGH = -(2**63), 2**63 - 1


def _below(keys: DataFrame, probes: list[int]) -> list[int]:
    """Exact bytes of the keys that are at most each probe; the probes are sorted."""
    edges = np.array(probes, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = np.searchsorted(edges, batch.column("key").to_numpy())
            bytes_ = np.zeros(len(edges) + 1, np.int64)
            np.add.at(bytes_, bucket, batch.column("size").to_numpy())
            used = np.flatnonzero(bytes_)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bytes_[used])], ["bucket", "n_bytes"])

    counted = keys.select("key", "size").mapInArrow(count, "bucket long, n_bytes long").groupBy("bucket").agg(F.sum("n_bytes").alias("n_bytes"))
    sums = np.zeros(len(edges) + 1, np.int64)
    for row in counted.collect():  # as many rows as probes at most
        sums[row.bucket] = row.n_bytes
    return np.cumsum(sums)[:-1].tolist()


def splitters(keys: DataFrame, shards: int, total: int, tolerance: float = TOLERANCE) -> list[int]:
    """shards - 1 keys, ascending; a shard ends with its splitter."""
    wanted = [total * j / shards for j in range(1, shards)]
    lows, highs = [(LOW, 0)] * len(wanted), [(HIGH, total)] * len(wanted)
    step = 2**64 // (FIRST_PROBES + 1)
    probes = [LOW + step * i for i in range(1, FIRST_PROBES + 1)]
    while probes and wanted:
        found = list(zip(probes, _below(keys, probes), strict=True))
        below = np.array([b for _, b in found])
        probes = []
        for j, want in enumerate(wanted):
            k = int(np.searchsorted(below, want, side="right"))  # probes before k hold want at most
            if k and found[k - 1][0] > lows[j][0]:
                lows[j] = found[k - 1]
            if k < len(found) and found[k][0] < highs[j][0]:
                highs[j] = found[k]
            near = min(want - lows[j][1], highs[j][1] - want)
            width = highs[j][0] - lows[j][0]
            if near > tolerance * total / shards and width > 1:
                n = min(PROBES, width - 1)
                probes += [lows[j][0] + width * i // (n + 1) for i in range(1, n + 1)]
        probes = sorted(set(probes))
    return [lo[0] if want - lo[1] <= hi[1] - want else hi[0] for want, lo, hi in zip(wanted, lows, highs, strict=True)]


def shard_of(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> Column:
    """The shard of a row by its key, as an expression.  keys: key long (one text or more), size long."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    largest = keys.groupBy("key").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "key").limit(shards).collect()  # shards rows at most
    alone, rest = [], total
    for row in largest:
        if len(alone) < shards - 1 and row["size"] * (shards - len(alone)) > rest:
            alone.append(row["key"])
            rest -= row["size"]
    left = keys.filter(~F.col("key").isin(alone)) if alone else keys
    edges = splitters(left, shards - len(alone), rest, tolerance)
    by_range = sum((F.when(F.col("key") > e, 1).otherwise(0) for e in edges), F.lit(0))
    found = by_range
    for k, key in enumerate(alone):
        found = F.when(F.col("key") == key, shards - len(alone) + k).otherwise(found)
    return found.cast("int")


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def assign_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus OVERHEAD, nulls count as empty.  Equal
    texts share a shard.  Slots number each shard's rows from 0 without gaps:
    cells of a shard are counted, and rows numbered within cells, so a hot shard
    is no single task.  Rows that repeat a doc_id have slots of their own.  An
    empty table gives an empty one.  Other columns of docs are not looked at.
    """
    text = text_of()
    sized = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _key(text).alias("key"))
    sized = shared_table(sized, "shard-sizes")
    cells = max(1, -(-sized.count() // (shards * CELL_ROWS)))
    placed = sized.withColumn("shard", shard_of(sized, shards, tolerance)).withColumn("__cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)))
    ahead = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n")).select("shard", "__cell", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    nth = F.row_number().over(Window.partitionBy("shard", "__cell").orderBy("key", "doc_id"))
    return placed.join(counts, ["shard", "__cell"]).withColumn("slot", F.col("__ahead") + nth - 1).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 1) -> None:
    """Write docs under path, a folder for each shard, of `files` files; equal texts share a file."""
    text = text_of()
    keyed = docs.withColumns({"key": _key(text), "size": (F.octet_length(text) + OVERHEAD).cast("long")})
    shard = shard_of(shared_table(keyed.select("key", "size"), "shard-keys"), shards)
    placed = keyed.withColumn("shard", shard).withColumn("__file", F.pmod("key", F.lit(files)))
    placed.repartition(shards * files, "shard", "__file").drop("key", "size", "__file").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign_shards(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
