"""Removal of repeated passages: every word in a WINDOW-word window that also starts earlier.

The corpus' suffixes, each cut to WINDOW words, are split by prefixes into
groups that fit memory, and each group's suffix tree is built by itself: a node
of depth WINDOW with more than one leaf is a repeat, and all its leaves but the
first in the order of (doc_id, start) are repeated windows.

Neighbouring suffixes overlap in all but a word, so they are not sent one by
one.  A suffix is read from its anchor on, the ANCHOR words inside it with the
smallest hash: equal suffixes have equal anchors, and neighbours mostly share
theirs, so one record holds a run of them.  The anchor is the prefix by which
they are grouped.  Where a group is too large, the prefix is lengthened to all
WINDOW words, and each suffix of it is a record of its own; such a group has one
node, goes through memory in pieces, and needs no more than its first leaf.

Three passes:

1. Records are cut from texts, by chunks of documents.  A window that stands
   earlier in its chunk is a repeat for certain and needs no comparison, so a
   passage that stands everywhere sends one record a chunk; an anchor that is
   frequent in its chunk is only told of, once.  An anchor's records are counted:
   single ones are dropped, as nothing equals them.
2. For the others, the words themselves are cut from texts and grouped.
3. Repeated windows go back to their documents.

Hashes only say what is compared: windows are equal when all words are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.llm.common import documents, shared_table, text_of

WINDOW = 20
ANCHOR = 6
#: A record holds so many windows at most.
RUN = 16
#: Words that are compared before the exchange.
CHUNK = 1 << 20
#: An anchor with more records than this in a chunk counts as frequent everywhere.
OFTEN = 64
#: Records of a group whose tree is built at once; groups of more have their prefix lengthened.
GROUP = 20_000
#: Stands for a null doc_id, and sorts first as that does.
NO_ID = -(2**63)
#: Odd multiplier of the rolling hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of records: to be compared, the same under a frequent anchor, known repeats, and word of a frequent anchor.
SENT, FREQUENT, KNOWN, NOTICE = range(4)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, by doubling from hashed words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    out, have, block, span = None, 0, words, 1
    left = size
    while left:
        if left & 1:
            n = len(words) - have - span + 1
            part = block[have : have + n]
            out = part if out is None else _mix(out[:n] * BASE + part)
            have += span
        left >>= 1
        if left:
            block = _mix(block[:-span] * BASE + block[span:])
            span *= 2
    return out[: len(words) - size + 1]


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def words_of_text(text: str) -> list[bytes]:
    return text.encode("utf-8").split()


def _interned(words: list[bytes], known: defaultdict) -> np.ndarray:
    """A number for each word, equal for equal words only; known grows by those not met before."""
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _numbers() -> defaultdict:
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    return known


def _tag(text: str) -> int:
    """Tells texts that share a doc_id apart."""
    return xxhash.xxh32_intdigest(text.encode("utf-8"))


MARK = "anchor long, doc_id long, tag long, place long"
MARK_NAMES = ["anchor", "doc_id", "tag", "place"]


def _cut(batches: Iterator[pa.RecordBatch], window: int, key_bits: int) -> Iterator[pa.RecordBatch]:
    """Records of texts, see _chunk()."""
    held, known, size = [], _numbers(), 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of_text(text)
            if len(words) >= window:
                held.append((doc, _tag(text), _interned(words, known)))
                size += len(words)
            if size >= CHUNK:
                yield from _chunk(held, known, window, key_bits)
                held, known, size = [], _numbers(), 0
    if held:
        yield from _chunk(held, known, window, key_bits)


def _chunk(held: list[tuple], known: defaultdict, window: int, key_bits: int) -> Iterator[pa.RecordBatch]:
    """anchor, doc_id, tag, place: start of the first window << 20, which windows from it on << 4, kind.

    Of equal windows in the chunk, compared by their words, only the first is to
    be compared further; the others are known repeats.
    """
    held.sort(key=lambda h: h[0])
    ids, tags = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
    sizes = np.array([len(h[2]) for h in held])
    ends = np.cumsum(sizes)
    words = np.concatenate([h[2] for h in held])
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[words]
    cut = np.uint64(64 - key_bits)
    nodes = run_hashes(hashed, window) >> cut
    anchors = sliding_min(run_hashes(hashed, ANCHOR) >> cut, window - ANCHOR + 1)
    owner = np.repeat(np.arange(len(held)), sizes)
    at = np.flatnonzero(owner[: len(nodes)] == owner[window - 1 :])  # windows inside one document
    owner, node, anchor = owner[at], nodes[at], anchors[at]
    doc, start = ids[owner], at - (ends - sizes)[owner]

    order = np.argsort(node, kind="stable")
    fresh = np.concatenate([[True], node[order][1:] != node[order][:-1]])
    first = np.empty(len(at), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
    known_repeat = (doc[first] != doc) | (start[first] != start)
    for k in range(window):
        like = np.flatnonzero(known_repeat)
        known_repeat[like] = words[at[like] + k] == words[at[first[like]] + k]

    heads = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
    run = np.cumsum(heads) - 1
    step = np.arange(len(at)) - np.flatnonzero(heads)[run]
    heads |= step % RUN == 0
    run, step, head = np.cumsum(heads) - 1, step % RUN, np.flatnonzero(heads)
    bits = [np.bincount(run, np.where(which, 1 << step, 0), len(head)).astype(np.int64) for which in (~known_repeat, known_repeat)]
    anchor, owner, start = anchor[head].view(np.int64), owner[head], start[head]
    anywhere = _mix(owner.astype(np.uint64) * BASE + start.astype(np.uint64)).view(np.int64)
    sent = bits[0] > 0
    names, which, counts = np.unique(anchor[sent], return_inverse=True, return_counts=True)
    often = np.zeros(len(head), bool)
    often[sent] = counts[which] > OFTEN

    def rows(some: np.ndarray, key: np.ndarray, held_bits: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(some), 20_000):
            part = some[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(ids[owner[part]]), pa.array(tags[owner[part]]), pa.array((start[part] << 20) | (held_bits[part] << 4) | kind)], MARK_NAMES)

    yield from rows(np.flatnonzero(sent & ~often), anchor, bits[0], SENT)
    yield from rows(np.flatnonzero(sent & often), anywhere, bits[0], FREQUENT)
    yield from rows(np.flatnonzero(bits[1] > 0), anywhere, bits[1], KNOWN)
    told = names[counts > OFTEN]
    none = np.zeros(len(told), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(none), pa.array(none), pa.array(none | NOTICE)], MARK_NAMES)


def marked(texts: DataFrame, window: int, key_bits: int, group: int) -> DataFrame:
    """anchor, doc_id, tag, place, level: 0 for known repeats, 1 to be grouped by anchor, 2 by all words."""
    cut = texts.mapInArrow(lambda b: _cut(b, window, key_bits), MARK)
    kind = F.col("place").bitwiseAND(F.lit(15))
    same = Window.partitionBy("anchor")
    counted = cut.withColumns({"n": F.count(F.lit(1)).over(same), "told": F.max(kind == NOTICE).over(same)})
    level = F.when(kind == KNOWN, 0).when((kind == FREQUENT) | F.col("told") | (F.col("n") > group), 2).otherwise(1)
    some = counted.filter((kind == KNOWN) | (kind == FREQUENT) | ((kind == SENT) & (F.col("n") > 1)))
    return shared_table(some.select(*MARK_NAMES, level.cast("byte").alias("level")), "repeat-marks")


SHIPPED = "key long, doc_id long, tag long, place long, words binary"
SHIPPED_NAMES = ["key", "doc_id", "tag", "place", "words"]


def _ship(batches: Iterator[pa.RecordBatch], window: int, key_bits: int) -> Iterator[pa.RecordBatch]:
    """The records' words, cut from the documents' texts; place is start << 16 | windows."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for doc, tag, body, records in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "body", "records")), strict=True):
            words = unpack.decompress(body).split()
            for record in records:
                start, bits = record["place"] >> 20, (record["place"] >> 4) & 0xFFFF
                if record["level"] == 1:
                    out.append((record["anchor"], doc, tag, (start << 16) | bits, b" ".join(words[start : start + bits.bit_length() - 1 + window])))
                    continue
                for b in range(bits.bit_length()):
                    if bits >> b & 1:
                        own = b" ".join(words[start + b : start + b + window])
                        out.append((xxhash.xxh64_intdigest(own) >> (64 - key_bits + 1), doc, tag, ((start + b) << 16) | 1, own))
            if len(out) > 20_000:
                yield _shipped(out)
                out = []
        yield _shipped(out)


def _shipped(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], SHIPPED_NAMES)


def tree_nodes(words: np.ndarray, depth: int) -> np.ndarray:
    """For each place the node of depth `depth` of the suffix tree, on the way to the suffix that starts there.

    words holds numbers of words.  A node is the class of the suffixes with the
    same first words; nodes are made from the root down, those of twice the depth
    from a node and the node behind it, so no two classes share a number.
    """
    node, level, span, found, have = words, None, 1, None, 0
    left = depth
    while True:
        if left & 1:
            found = node if found is None else _children(found, node[have:])
            have += span
        left >>= 1
        if not left:
            return found[: len(words) - depth + 1]
        level = node
        node = _children(level, level[span:])
        span *= 2


def _children(above: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Nodes below `above`, told apart by what follows."""
    n = min(len(above), len(behind))
    if not n:
        return np.empty(0, np.int64)
    return pd.factorize(above[:n] * (int(behind.max()) + 1) + behind[:n])[0]


def subtree_repeats(key: np.ndarray, doc: np.ndarray, place: np.ndarray, words: list[bytes], window: int) -> np.ndarray:
    """For each record of whole groups, sorted by key, doc and place, which of its windows are repeats, as bits.

    A leaf is a window; the node of depth `window` above it is internal where it
    has other leaves, of which the first stays.
    """
    bits = (place & 0xFFFF).astype(np.uint16)
    row, step = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little"))
    last = np.zeros(len(bits), np.int64)
    last[row] = step  # the largest comes last
    flat = b" ".join(words).split(b" ")
    sizes = last + window
    nodes = tree_nodes(_interned(flat, _numbers()), window)
    leaf = nodes[(np.cumsum(sizes) - sizes)[row] + step]
    _, first, node = np.unique(leaf, return_index=True, return_inverse=True)
    first = first[node]
    own, at = doc[row], (place >> 16)[row] + step
    repeat = (own[first] != own) | (at[first] != at)
    return np.bincount(row, np.where(repeat, 1 << step, 0), len(bits)).astype(np.int64)


RUNS = ["doc_id", "tag", "run"]


def _trees(batches: Iterator[pa.RecordBatch], window: int, group: int) -> Iterator[pa.RecordBatch]:
    """doc_id, tag, run = start << 16 | repeated windows, from records sorted by key, doc_id and place.

    Whole groups are searched together.  A group that outgrows memory is one of
    equal windows: what has come of it is searched, and its first leaves are kept.
    """
    held = None  # the open group, with what of it was searched before

    def search(table: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
        key, doc, place = (table.column(c).to_numpy() for c in ("key", "doc_id", "place"))
        found = subtree_repeats(key, doc, place, table.column("words").to_pylist(), window)
        hit = np.flatnonzero((found > 0) & ~table.column("old").to_numpy())
        runs = pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(table.column("tag").to_numpy()[hit]), pa.array((place[hit] >> 16 << 16) | found[hit])], RUNS)
        stay = table.filter(pa.array(found != (place & 0xFFFF)))
        return runs, stay.set_column(5, "old", pa.array(np.ones(len(stay), bool)))

    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch]).append_column("old", pa.array(np.zeros(batch.num_rows, bool)))
        table = new if held is None else pa.concat_tables([held, new])
        key = table.column("key").to_numpy()
        whole = int(np.searchsorted(key, key[-1]))
        if whole:
            yield search(table.slice(0, whole))[0]
        held = table.slice(whole)
        if len(held) > group:
            runs, held = search(held)
            yield runs
    if held is not None and len(held):
        yield search(held)[0]


def kept_words(text: str, runs: np.ndarray, window: int = WINDOW) -> tuple[int, list[bytes]]:
    """Number of words, and the words outside repeated windows; runs as from _trees."""
    words = words_of_text(text)
    if not len(runs):
        return len(words), words
    edges = np.zeros(len(words) + 1, np.int64)
    bits, start = runs & 0xFFFF, runs >> 16
    for b in range(RUN):
        at = start[(bits >> b) & 1 == 1] + b
        np.add.at(edges, at, 1)
        np.add.at(edges, at + window, -1)
    keep = np.cumsum(edges)[:-1] == 0
    return len(words), [words[i] for i in np.flatnonzero(keep).tolist()]


def without_repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP, key_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text.

    A null text has no words.  Of equal windows the one with the smallest
    (doc_id, start) stays, a null doc_id being the smallest; windows at the same
    start of rows that share a doc_id do not remove each other.  Texts of fewer
    words than a window keep all.  kept_text has the kept words joined by single
    spaces.  An empty table gives an empty one.  Other columns of docs are not
    looked at.  Fewer key_bits make hashes collide, for tests.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text"))
    marks = marked(texts, window, key_bits, group)
    owner = ["doc_id", "tag"]
    tagged = texts.mapInArrow(_squeeze, "doc_id long, tag long, body binary")
    records = marks.filter("level > 0").groupBy(*owner).agg(F.collect_list(F.struct("anchor", "place", "level")).alias("records"))
    shipped = tagged.join(records.hint("merge"), owner).select("doc_id", "tag", "body", "records").mapInArrow(lambda b: _ship(b, window, key_bits), SHIPPED)
    grouped = shipped.repartition("key").sortWithinPartitions("key", "doc_id", "place")
    found = grouped.mapInArrow(lambda b: _trees(b, window, group), "doc_id long, tag long, run long")
    known = marks.filter("level = 0").select("doc_id", "tag", F.expr("(shiftright(place, 20) << 16) | (shiftright(place, 4) & 65535)").alias("run"))
    runs = found.unionAll(known).groupBy(*owner).agg(F.collect_list("run").alias("runs"))
    kept = tagged.join(runs.hint("merge"), owner, "left").select("doc_id", "body", "runs").mapInArrow(lambda b: _keep(b, window), "doc_id long, n_words long, n_removed long, kept_text string")
    return kept.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are compressed for the exchange."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([_tag(t) for t in texts], pa.int64()), pa.array([pack.compress(t.encode("utf-8")) for t in texts], pa.binary())], ["doc_id", "tag", "body"]
        )


def _keep(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            words, removed, kept = [], [], []
            for body, runs in zip(part.column("body").to_pylist(), part.column("runs"), strict=True):
                n, left = kept_words(unpack.decompress(body).decode("utf-8"), np.array(runs.as_py() or [], np.int64), window)
                words.append(n)
                removed.append(n - len(left))
                kept.append(b" ".join(left).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT rid, doc_id, i, array_to_string(ws[i:i + 19], ' ') AS w FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
rep AS (SELECT rid, i FROM win QUALIFY rank() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, i) > 1),
cov AS (SELECT DISTINCT rid, i + k AS j FROM rep, (SELECT unnest(range(20)) AS k)),
word AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS j FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN cov USING (rid, j) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
