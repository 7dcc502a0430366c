"""Near-duplicate detection by SimHash with deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits, so two fingerprints that
differ in at most three bits have a segment where they differ in at most one.
Every segment is indexed once per bit with that bit deleted: segments that
differ in at most one bit share such a variant.  Variants are counted first:
most stand alone and are dropped.  An equality join on the others finds the
candidates, its condition compares whole fingerprints, and each pair is taken
from one variant only.  Under a crowded variant the other segment is cut into one
block more than bits may differ, of which one must agree, so that pairs are not
formed among all.  Rows with one fingerprint are a class and enter once, so a hot
group of copies is one row.

Classes and links are tables; their components come from rounds of large-star
and small-star, each round written to the shared folder.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.llm.common import documents, shared_table, text_of

SHINGLE = 3
MAX_BITS = 2
SEED = 42
SEGMENT = 32
#: A variant with more fingerprints than this is crowded.
CROWD = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: str, size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of `size` words, A-Z lower-cased, joined by a space; a shorter text is one run."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - size + 1)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i : i + BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, print (long) of every row.  A null text is an empty one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(t, shingle, seed)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(rows, "doc_id long, print long")


def variants(print_: Column, first: int = 0) -> Column:
    """array<struct<at int, key long>>: each segment with each of its bits deleted.

    at numbers segment and bit, from 64 * first on.
    """
    found = []
    for segment in range(2):
        part = F.shiftright(print_, SEGMENT * segment).bitwiseAND(F.lit((1 << SEGMENT) - 1))
        found += [F.struct(F.lit(64 * first + SEGMENT * segment + bit).alias("at"), part.bitwiseAND(F.lit(((1 << SEGMENT) - 1) ^ (1 << bit))).alias("key")) for bit in range(SEGMENT)]
    return F.array(*found)


def print_links(classes: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct longs classes.print that differ in at most max_bits (3 at most) bits.

    A pair is made where the deleted bit is the one that differs, or at bit 0
    if the segment is equal; of two such segments, and of blocks under crowded
    variants, it can come more than once.
    """
    if max_bits > 3:
        raise ValueError("two segments with one deletion find up to three differing bits")
    index = classes.select("print", F.explode(variants(F.col("print"))).alias("v"))
    index = index.select("print", F.col("v.at").alias("at"), F.col("v.key").alias("key")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("at", "key")))
    index = shared_table(index.filter("n > 1"), "simhash-index")
    blocks = max_bits + 1
    other = F.expr(f"shiftrightunsigned(print, {SEGMENT} - at DIV {SEGMENT} * {SEGMENT}) & {(1 << SEGMENT) - 1}")
    width = -(-SEGMENT // blocks)
    cut = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftright(other, width * i).bitwiseAND(F.lit((1 << width) - 1)).alias("bits")) for i in range(blocks)])
    alone = F.array(F.struct(F.lit(blocks).alias("block"), F.lit(0).cast("long").alias("bits")))
    keyed = index.withColumn("c", F.explode(F.when(F.col("n") > crowd, cut).otherwise(alone))).select("at", "key", "c.*", "print")
    same = ["at", "key", "block", "bits"]
    bit = F.pmod(F.col("at"), F.lit(SEGMENT))
    inside = F.expr(f"shiftright(a ^ b, at DIV {SEGMENT} * {SEGMENT}) & {(1 << SEGMENT) - 1}")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    met = keyed.withColumnRenamed("print", "a").join(keyed.withColumnRenamed("print", "b").hint("merge"), same)
    return met.filter((F.col("a") < F.col("b")) & near & ((inside != 0) | (bit == 0))).select("a", "b")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, root for every node of links(a, b): root is the smallest node that it reaches.

    Rounds of large-star and small-star: every node joins its larger, then its
    smaller neighbours to the smallest it knows.  The number of edges never
    grows, and the rounds about with the logarithm of a component's size.
    """
    mark = lambda table: table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    edges = shared_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), name)
    state = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        after = shared_table(small, name)
        before, state = state, mark(after)
        if before == state:  # as many edges as before, and the same
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = after


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest doc_id that links reach, n_links the number of
    other fingerprints that this one links to.  Texts without words, null ones
    too, have fingerprint zero and link like others; texts of fewer words than a
    shingle are one shingle.  Null doc_ids link, but name no component unless
    nothing else does (then null).  Rows that repeat a doc_id each keep their
    fingerprint.  An empty table gives an empty one.  Other columns of docs are
    not looked at.
    """
    prints = shared_table(fingerprints(docs, shingle, seed), "simhash-prints")
    classes = shared_table(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    links = shared_table(print_links(classes, max_bits).distinct(), "simhash-links")
    ends = links.select(F.col("a").alias("print")).unionAll(links.select(F.col("b").alias("print"))).groupBy("print").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = components(links, "simhash-components").withColumnRenamed("node", "print")
    placed = classes.join(rooted, "print", "left").withColumn("root", F.coalesce("root", "print")).join(ends, "print", "left")
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return (
        prints.join(placed.join(smallest, "root").select("print", "component_id", "n_links"), "print")
        .select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


# --- near copies by similarity -------------------------------------------------

SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: Bits in which fingerprints of candidates differ at most.
SIMILAR_BITS = 3
#: One text in so many is looked at for common shingles, and so many of these are put last at most.
COMMON_SHARE, COMMON = 16, 300_000
#: Orders of leaders by key.
VEILS = 4
#: Classes of sizes differ by this factor.
SIZE_STEP = 1.05
#: Bits of the map of a set, which is compared under keys with more texts than this.
MAP_BITS, MAP_CROWD = 1024, 32
#: Against rounding in bounds.
SLACK = 1e-9


def shingle_set(text: str, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size, SEED))


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """MAP_BITS bits, each the parity of how many hashes fall on it.

    A hash that only one of two sets has turns one bit, so sets differ in as
    many hashes at least as their maps do in bits.
    """
    counts = np.bincount((hashes % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS)
    return np.packbits(counts & 1, bitorder="little").view(np.int64)


def common_shingles(texts: DataFrame, size: int = SIMILAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and ranks of shingles that several of the sampled texts have.

    They only say which shingles come last in the order of prefixes: any order
    finds the same pairs, a better one with fewer candidates.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, size).view(np.int64))], ["key"])

    sample = texts.filter(F.pmod("id", F.lit(COMMON_SHARE)) == 0).select("text").mapInArrow(rows, "key long")
    counted = sample.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n")).filter("n > 1")
    found = counted.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    keys, ranks = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], ranks[order]


def signatures(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], size: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """id, size (of the set of shingles), print (their fingerprint), bits (their parity map), prefix array<long> of every row.

    The prefix has the first shingles in one order for all texts (by rank, then
    hash), so many that sets of that similarity have one in common there.
    """
    keys, ranks = common

    def sign(text: str) -> tuple[int, int, np.ndarray, np.ndarray]:
        found = shingle_set(text, size)
        n, mark, bits = len(found), fingerprint(found), parity_map(found)
        if n and len(keys):
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            found = found[np.argsort(np.where(keys[at] == found, ranks[at], 0), kind="stable")]
        return n, mark, bits, found[: n - int(np.ceil(similarity * n - SLACK)) + 1].view(np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [sign(t) for t in part.column("text").to_pylist()]
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], ["id", "size", "print", "bits", "prefix"])

    return texts.mapInArrow(rows, "id long, size int, print long, bits array<long>, prefix array<long>")


def similar_groups(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """node, root (hashes of texts) of the texts that are near copies of others.

    Texts whose sets of `shingle`-word shingles have Jaccard similarity of
    `similarity` or more are linked, all of them, and similarity is verified on
    whole texts.  Candidates come in three turns.  First fingerprints of the
    sets, by their deletion variants, each bucket against its leader.  What they
    miss is found exactly: sets that similar have a shingle of their prefixes in
    common, so the texts under one shingle are candidates.  The second turn
    compares a leader of each shingle with one text of each component found so
    far, which links most of a hot group in rows that grow with its size.  Then
    every pair under a shingle that is in different components and can be similar
    by its sizes and maps is compared; pairs within one can't change it.  Links are
    between components found before, so that a turn has one link of two of them.
    """
    texts = docs.select(F.xxhash64(text_of()).alias("id"), text_of().alias("text"))
    signed = shared_table(signatures(texts, common_shingles(texts, shingle), shingle, similarity).dropDuplicates(["id"]), "similar-signatures")
    alike = shared_table(_printed(signed, similarity), "similar-pairs-0")
    index = signed.select("id", "size", F.posexplode("prefix").alias("at", "key"))
    index = index.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1").drop("n")
    index = shared_table(index, "similar-index")
    _release(docs)
    members = index.select("id").unionAll(alike.select(F.explode(F.array("a", "b")))).distinct()
    bodies = shared_table(_squeezed(texts.join(members.hint("merge"), "id", "left_semi")).dropDuplicates(["id"]), "similar-bodies")
    pairs, links = alike, _verified(alike.withColumns({"r": F.col("a"), "s": F.col("b")}), bodies, shingle, similarity, 0)
    for turn, candidates in ((1, _led), (2, lambda *x: _across(*x, signed.select("id", "bits")))):
        roots = shared_table(components(links, "similar-components"), "similar-roots")
        rooted = index.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        found = shared_table(candidates(rooted, similarity).join(pairs, ["a", "b"], "left_anti"), f"similar-pairs-{turn}")
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_verified(found, bodies, shingle, similarity, turn))
        pairs = pairs.unionByName(found.select("a", "b"))
    return shared_table(components(links, "similar-components"), "similar-roots")


def _release(frame: DataFrame) -> None:
    """Let go what was exchanged before: Spark clears such files only when both collectors have run."""
    gc.collect()
    frame.sparkSession._jvm.System.gc()


def _squeezed(texts: DataFrame) -> DataFrame:
    """id, body: texts compressed for the exchanges."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([squeeze.compress(t.encode("utf-8")) for t in batch.column("text").to_pylist()], pa.binary())], ["id", "body"])

    return texts.mapInArrow(rows, "id long, body binary")


def _sizes_fit(x: Column, y: Column, similarity: float) -> Column:
    return F.least(x, y) >= similarity * F.greatest(x, y) - SLACK


def _enough(both: Column, x: Column, y: Column, similarity: float) -> Column:
    """Whether `both` shingles in common make sets of x and y shingles similar."""
    return both >= similarity / (1 + similarity) * (x + y) - SLACK


def _printed(signed: DataFrame, similarity: float) -> DataFrame:
    """a, b: texts of one fingerprint with the first of them, and under each deletion variant the firsts with the least of them."""
    first = F.min(F.struct("id", "size")).over(Window.partitionBy("print"))
    classed = shared_table(signed.select("id", "size", "print", first.alias("y")), "similar-classes")
    same = classed.filter("id != y.id").select("id", "size", "y")
    index = classed.filter("id = y.id").select(F.struct("id", "size", "print").alias("x"), F.explode(variants(F.col("print"))).alias("v"))
    led = index.withColumn("y", F.min("x").over(Window.partitionBy("v"))).filter("x.id != y.id")
    led = led.filter(F.bit_count(F.col("x.print").bitwiseXOR(F.col("y.print"))) <= SIMILAR_BITS)
    both = same.select("id", "size", "y.*").toDF("i", "x", "j", "y").unionAll(led.select("x.id", "x.size", "y.id", "y.size"))
    return both.filter(_sizes_fit(F.col("x"), F.col("y"), similarity)).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def _led(index: DataFrame, similarity: float) -> DataFrame:
    """a, b, and their roots r, s: under every key its leader and one text of each other component (root).

    The leader has the fewest shingles before the key, which are rarer ones: among
    copies with edits it is the one with the fewest, to which most are similar.
    Of several it has the smallest id after an exclusive or that differs by some
    bits of the key.  Of the keys that two texts share, after the first no more
    are in common than the shorter rest has: pairs without such a key go.
    """
    veil = F.xxhash64(F.pmod("key", F.lit(VEILS)), F.lit(0))
    veiled = index.select("key", "root", F.struct("at", F.col("id").bitwiseXOR(veil).alias("m"), "size", "root").alias("x"))
    veiled = veiled.groupBy("key", "root").agg(F.min("x").alias("x"))
    led = veiled.select("key", "x", F.min("x").over(Window.partitionBy("key")).alias("y")).filter("x.m != y.m")
    x, y = F.col("x.size"), F.col("y.size")
    led = led.filter(_sizes_fit(x, y, similarity) & _enough(F.least(x - F.col("x.at"), y - F.col("y.at")), x, y, similarity))
    one, two = F.col("x.m").bitwiseXOR(veil), F.col("y.m").bitwiseXOR(veil)
    return led.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), F.col("x.root").alias("r"), F.col("y.root").alias("s")).dropDuplicates(["a", "b"])


def _across(index: DataFrame, similarity: float, maps: DataFrame) -> DataFrame:
    """a, b, and their roots r, s: all pairs of texts that share a key, are in different components and can be similar.

    Behind the first key that two texts share, no more are in common than the
    shorter rest has, so a pair that is similar passes that test there; keys at
    which it fails make no row.  For the larger text of a pair the test leaves
    sizes from `similarity` times its own up to some bound, which falls the
    further behind the key stands.  Texts meet by key and class of sizes, so those
    of a crowded key that are too unlike never do.  Under crowded keys their parity
    maps are compared, too: sets whose maps differ in more bits than similar sets
    have shingles that only one of them has make no row.
    """
    together = Window.partitionBy("key")
    crowded = index.withColumns({"low": F.min("root").over(together), "high": F.max("root").over(together), "n": F.count(F.lit(1)).over(together)})
    crowded = crowded.filter("low != high").drop("low", "high")
    mapped = maps.withColumnRenamed("id", "of").hint("merge")
    crowded = shared_table(crowded.join(mapped, (F.col("id") == F.col("of")) & (F.col("n") > MAP_CROWD), "left").drop("of", "n"), "similar-crowded")
    x, y = F.col("x"), F.col("y")
    of_size = lambda z: F.floor(F.log(F.greatest(z, F.lit(1.0))) / F.log(F.lit(SIZE_STEP))).cast("int")
    larger = crowded.select("key", F.col("root").alias("r"), F.col("id").alias("i"), F.col("size").alias("x"), F.col("at").alias("p"), F.col("bits").alias("c"))
    most = F.least(x.cast("double"), (x - F.col("p")) * ((1 + similarity) / similarity) - x + SLACK)
    larger = larger.withColumn("class", F.explode(F.sequence(of_size(x * similarity - SLACK), F.greatest(of_size(most), of_size(x * similarity - SLACK)))))
    other = crowded.select("key", F.col("root").alias("s"), F.col("id").alias("j"), F.col("size").alias("y"), F.col("at").alias("q"), F.col("bits").alias("d"), of_size(F.col("size")).alias("class"))
    first = (y < x) | ((y == x) & (F.col("i") < F.col("j")))
    fits = _sizes_fit(x, y, similarity) & _enough(F.least(x - F.col("p"), y - F.col("q")), x, y, similarity)
    turned = sum((F.bit_count(F.col("c")[k].bitwiseXOR(F.col("d")[k])) for k in range(MAP_BITS // 64)), F.lit(0))
    near = F.col("c").isNull() | F.col("d").isNull() | _enough((x + y - turned) / 2, x, y, similarity)
    met = larger.join(other.hint("merge"), ["key", "class"]).filter((F.col("r") != F.col("s")) & first & fits & near)
    return met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "r", "s").distinct()


def _verified(pairs: DataFrame, bodies: DataFrame, shingle: int, similarity: float, turn: int) -> DataFrame:
    """a, b: the roots r, s of the pairs whose texts' sets have at least that Jaccard similarity."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        whole = zstandard.ZstdDecompressor()
        of = lambda body: shingle_set(whole.decompress(body).decode("utf-8"), shingle)
        held, mine = None, None  # pairs come sorted by a
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"), strict=True)):
                if a != held:
                    held, mine = a, of(x.as_py())
                other = of(y.as_py())
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep[i] = both >= similarity * (len(mine) + len(other) - both) - SLACK
            yield batch.select(["r", "s"]).rename_columns(["a", "b"]).filter(pa.array(keep))

    _release(pairs)
    met = pairs.join(bodies.select(F.col("id").alias("b"), F.col("body").alias("y")).hint("merge"), "b")
    met = met.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("x")).hint("merge"), "a")
    return shared_table(met.select("a", "b", "r", "s", "x", "y").mapInArrow(rows, "a long, b long").distinct(), f"similar-links-{turn}")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near copies: of a group the text with the smallest doc_id stays (null last), with all its rows.

    Groups are those of similar_groups().  A null text is an empty one; texts
    without words are near copies of each other.  Repeated rows and
    equal texts are one text here and stay or go together.  An empty table gives an
    empty one; the columns are those of docs.
    """
    roots = similar_groups(docs, **options)
    text = F.xxhash64(text_of())
    ids = docs.select(text.alias("node"), F.col("doc_id").alias("__id")).join(roots, "node").groupBy("root", "node").agg(F.min("__id").alias("first_id"))
    best = ids.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "node"))["node"].alias("stays"))
    gone = shared_table(roots.join(best, "root").filter("node != stays").select(F.col("node").alias("__gone")), "similar-gone")
    _release(docs)
    return docs.join(gone.hint("merge"), text == F.col("__gone"), "left_anti")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
