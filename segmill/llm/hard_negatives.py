"""Hard negatives by maximum inner product over cover trees.

Candidates get one more coordinate that brings all to the same norm, so a point near a query has a large
inner product with it.  Rows lie in blocks around a bounded sample of centres; each block has a cover tree,
whose nodes know how far their rows lie from their centre.  Level by level these radii bound the inner
products below a node, and nodes that lie outside all of a query's windows are skipped.  The leaves that are
left are read best first, and their inner products are exact integers, until no other can hold a better row.

Each block is also a chunk of queries: the anchors in it.  The pairs of chunks and blocks that can matter
follow from the blocks' own bounds, so neither queries nor candidates are ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.llm.common import shared_table

#: Rows of a block, about.
BLOCK_ROWS = 4096
#: At most so many centres are drawn, which bounds what the tasks that deal rows out are sent.
CENTRES = 1024
#: A level's radius is the last one's through this.
BASE = 1.2
#: A node of no more rows is a leaf, and one whose children would have fewer rows each than this on average.
LEAF_ROWS, CHILD_ROWS = 64, 16
#: Summaries of so many blocks are compared with a chunk of queries at a time.
SUMMARIES = 512
#: Leaves that a query reads in its first rounds; then all that are left.
ROUNDS = (1, 4)
POSITIVES, NEGATIVES = 5, 10
#: A window: negative scores between these hundredths of the positive's.
LOW, HIGH = 30, 90
ANCHOR_EVERY, NOISE_EVERY, LABELS = 100, 7, 10
#: Stands for a null id, which is last among ties.
NO_ID = (1 << 63) - 1


def prepared(vectors: DataFrame) -> DataFrame:
    """id, label, vector array<long>, dim, norm2 of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % NOISE_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    cells = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    kept = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    kept = kept.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), label.alias("label"), cells.alias("vector"))
    return kept.select("id", "label", "vector", F.size("vector").alias("dim"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("norm2"))


def augmented(rows: np.ndarray, most: float) -> np.ndarray:
    """rows with the coordinate that gives all the squared norm `most`."""
    return np.column_stack([rows, np.sqrt(np.maximum(0, most - (rows * rows).sum(1)))])


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order of the points in which every node's are consecutive, nodes by level).

    Nodes have centre (a place in the order), start, end, parent, leaf, level and
    radius: no point of the node is farther from its centre.
    """
    order = np.arange(len(points))
    nodes = []
    spread = np.sqrt(((points - points[0]) ** 2).sum(1))
    level = [(0, len(points), 0, -1, float(spread.max()), float(spread.max()))]  # start, end, centre, parent, radius, scale
    depth = 0
    while level:
        below = []
        for start, end, centre, parent, radius, scale in level:
            own, part = len(nodes), order[start:end].copy()
            cover = scale / BASE
            split = _split(points[part], int(np.flatnonzero(part == centre)[0]), cover) if end - start > LEAF_ROWS and radius > 0 else None
            nodes.append([start, end, centre, parent, split is None, depth, radius])
            if split is not None:
                centres, near, far = split
                by = np.argsort(near, kind="stable")
                order[start:end] = part[by]
                ends = np.cumsum(np.bincount(near, minlength=len(centres)))
                for k, c in enumerate(centres):
                    a, b = start + int(ends[k - 1] if k else 0), start + int(ends[k])
                    below.append((a, b, int(part[c]), own, float(far[near == k].max()), cover))
        level, depth = below, depth + 1
    places = np.empty(len(points), np.int64)
    places[order] = np.arange(len(points))
    columns = list(zip(*nodes, strict=True))
    found = {c: np.array(columns[k], np.int64) for k, c in enumerate(("start", "end", "centre", "parent", "leaf", "level"))}
    return order, found | {"centre": places[found["centre"]], "radius": np.array(columns[6])}


def _split(points: np.ndarray, centre: int, cover: float) -> tuple[list[int], np.ndarray, np.ndarray] | None:
    """Centres no two of which are within `cover`, each point's nearest and its distance; None where that parts too little or too much."""
    while True:
        centres, near = [centre], np.zeros(len(points), np.int64)
        far = np.sqrt(((points - points[centre]) ** 2).sum(1))
        while far.max() > cover:
            if len(centres) * CHILD_ROWS > len(points):
                return None
            centres.append(int(far.argmax()))
            there = np.sqrt(((points - points[centres[-1]]) ** 2).sum(1))
            near[there < far] = len(centres) - 1
            far = np.minimum(far, there)
        if len(centres) > 1:
            return centres, near, far
        cover /= BASE  # a level with the one child itself


def bounds(products: np.ndarray, radius: np.ndarray, lengths: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of queries (rows) with what lies within radius of centres (columns) of these products.

    A query has no further coordinate, so its distance from an augmented point follows
    from their product; the triangle inequality and the product's own bound both hold.
    """
    squares = lengths[:, None] ** 2 + most
    distance = np.sqrt(np.maximum(0, squares - 2 * products))
    slack = 1e-9 * squares + 1e-6
    by_length = lengths[:, None] * radius
    low = np.maximum(products - by_length, (squares - (distance + radius) ** 2) / 2) - slack
    return low, np.minimum(products + by_length, (squares - np.maximum(0, distance - radius) ** 2) / 2) + slack


def meets(low: np.ndarray, high: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """Whether any window [least, greatest] of a query (rows) meets the bounds of a node (columns)."""
    found = np.zeros(low.shape, bool)
    for w in range(least.shape[1]):
        found |= (high >= least[:, w : w + 1]) & (low <= greatest[:, w : w + 1])
    return found


class Block:
    """A block's rows and tree, as its written row has them."""

    NODES = ("start", "end", "centre", "parent", "leaf", "level")

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        cells = np.frombuffer(row["vectors"], "<i8" if row["wide"] else "<i4").reshape(len(self.ids), row["dim"])
        self.most = row["most"]
        #: Doubles hold products below 2**53 exactly.
        self.vectors = cells.astype(np.int64 if self.most * 4 >= 2.0**53 else np.float64)
        self.radius = np.frombuffer(row["radius"], "<f8")
        nodes = np.frombuffer(row["nodes"], "<i8").reshape(len(self.NODES), -1)
        self.nodes = dict(zip(self.NODES, nodes, strict=True))

    def search(self, queries: np.ndarray, labels: np.ndarray, own: np.ndarray, same: bool, least: np.ndarray, greatest: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(query, window, scores, ids): the first k rows of the same label, or another, with a score in the window.

        least, greatest: bounds by query and window.  own: a query's place here, or -1.
        """
        nodes, rows = self.nodes, self.vectors
        lengths = np.sqrt((queries.astype(float) ** 2).sum(1))
        alive = np.zeros((len(queries), len(nodes["start"])), bool)
        top = np.full(alive.shape, -np.inf)
        for level in range(int(nodes["level"].max()) + 1):
            here = np.flatnonzero(nodes["level"] == level)
            before = np.ones((len(queries), len(here)), bool) if level == 0 else alive[:, nodes["parent"][here]]
            here, before = here[before.any(0)], before[:, before.any(0)]
            low, high = bounds((queries @ rows[nodes["centre"][here]].T).astype(float), self.radius[here], lengths, self.most)
            alive[:, here], top[:, here] = before & meets(low, high, least, greatest), high
        leaves = np.flatnonzero(nodes["leaf"])
        top = np.where(alive[:, leaves], top[:, leaves], -np.inf)
        order, waiting = np.argsort(-top, axis=1, kind="stable"), (top > -np.inf).sum(1)
        scores = np.full((len(queries), len(rows)), -np.inf) if rows.dtype == np.float64 else np.full((len(queries), len(rows)), np.iinfo(np.int64).min)
        nothing = scores.dtype.type(-np.inf) if rows.dtype == np.float64 else np.iinfo(np.int64).min
        fits = (labels[:, None] == self.labels) == same
        fits[np.flatnonzero(own >= 0), own[own >= 0]] = False
        read, active = np.zeros(len(queries), np.int64), waiting > 0
        for size in (*ROUNDS, len(leaves)):
            wanted = np.zeros(top.shape, bool)
            for q in np.flatnonzero(active):
                wanted[q, order[q, read[q] : min(waiting[q], read[q] + size)]] = True
            read[active] = np.minimum(waiting[active], read[active] + size)
            for leaf in np.flatnonzero(wanted.any(0)):
                who, part = np.flatnonzero(wanted[:, leaf]), slice(nodes["start"][leaves[leaf]], nodes["end"][leaves[leaf]])
                scores[who, part] = np.where(fits[who, part], queries[who] @ rows[part].T, nothing)
            ahead = np.where(read < waiting, top[np.arange(len(queries)), order[np.arange(len(queries)), np.minimum(read, len(leaves) - 1)]], -np.inf)
            unsure = np.zeros(len(queries), bool)
            for w in range(least.shape[1]):
                unsure |= self._kth(scores, least[:, w], greatest[:, w], nothing, k)[1] <= np.minimum(ahead, greatest[:, w])
            active &= (read < waiting) & unsure
            if not active.any():
                break
        for w in range(least.shape[1]):
            inside, kth = self._kth(scores, least[:, w], greatest[:, w], nothing, k)
            for q in range(len(queries)):
                found = np.flatnonzero(inside[q] & (scores[q] >= kth[q]))
                if len(found):
                    found = found[np.lexsort((self.ids[found], -scores[q, found]))][:k]
                    yield q, w, scores[q, found].astype(np.int64), self.ids[found]

    @staticmethod
    def _kth(scores: np.ndarray, least: np.ndarray, greatest: np.ndarray, nothing: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which scores lie in a window, and the k-th greatest of them (or nothing, where there are fewer)."""
        inside = (scores > nothing) & (scores >= least[:, None]) & (scores <= greatest[:, None])
        if scores.shape[1] < k:
            return inside, np.full(len(scores), nothing)
        return inside, np.partition(np.where(inside, scores, nothing), scores.shape[1] - k, axis=1)[:, -k]


BLOCK_SCHEMA = "block string, dim int, most double, wide boolean, ids binary, labels binary, vectors binary, radius binary, nodes binary, centre binary, cover double, anchors binary"


def blocks_of(rows: DataFrame, anchor_every: int = ANCHOR_EVERY, block_rows: int = BLOCK_ROWS, centres: int = CENTRES) -> DataFrame:
    """BLOCK_SCHEMA: every row of `prepared`, numbered by row, in one block, with the block's cover tree.

    Rows of one dimension go to the nearest of a sample of centres, one for each
    `block_rows` rows and `centres` at most.  What is around one centre is cut into blocks
    in turn, so a crowd of any size, or of copies, has blocks like any other.
    """
    kinds = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("most")).collect()  # a row a dimension
    most = {r["dim"]: r["most"] for r in kinds}
    chosen = {}
    for r in kinds:
        if r["n"] > block_rows:
            drawn = rows.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("id", "vector"), "id").limit(min(centres, -(-r["n"] // block_rows))).select("vector").collect()
            chosen[r["dim"]] = augmented(np.array([x["vector"] for x in drawn], float), r["most"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, near = np.array(batch.column("dim").to_pylist(), int), np.zeros(batch.num_rows, np.int64)
            for dim in set(dims.tolist()) & chosen.keys():
                at = np.flatnonzero(dims == dim)
                cells = batch.column("vector").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim).astype(float)
                near[at] = (augmented(cells, most[dim]) @ chosen[dim].T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "near"])

    dealt = shared_table(rows.mapInArrow(deal, "id long, label long, vector array<long>, dim int, norm2 double, row long, near long"), "negatives-rows")
    crowds = dealt.groupBy("dim", "near").agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("cuts"))
    placed = dealt.join(crowds, ["dim", "near"]).withColumn("block", F.concat_ws("/", "dim", "near", F.col("row") % F.col("cuts")))

    def build(part: pa.Table) -> pa.Table:
        block, dim = part.column("block")[0].as_py(), part.column("dim")[0].as_py()
        cells = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
        ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
        first = np.lexsort((*cells.T[::-1], labels, ids))  # the same tree each time
        points = augmented(cells[first].astype(float), most[dim])
        order, nodes = cover_tree(points)
        first = first[order]
        wide = bool(np.abs(cells).max(initial=0) >= 1 << 31)
        asked = np.flatnonzero((ids[first] % anchor_every == 0) & (ids[first] != NO_ID))
        row = {
            "block": block, "dim": dim, "most": most[dim], "wide": wide, "ids": ids[first].astype("<i8").tobytes(), "labels": labels[first].astype("<i8").tobytes(),
            "vectors": cells[first].astype("<i8" if wide else "<i4").tobytes(), "radius": nodes["radius"].astype("<f8").tobytes(), "nodes": np.stack([nodes[c] for c in Block.NODES]).astype("<i8").tobytes(),
            "centre": cells[first][nodes["centre"][0]].astype("<f8").tobytes(), "cover": float(nodes["radius"][0]), "anchors": asked.astype("<i8").tobytes(),
        }
        schema = pa.schema([("block", pa.string()), ("dim", pa.int32()), ("most", pa.float64()), ("wide", pa.bool_()), *((c, pa.binary()) for c in ("ids", "labels", "vectors", "radius", "nodes", "centre")), ("cover", pa.float64()), ("anchors", pa.binary())])
        return pa.Table.from_pylist([row], schema)

    return shared_table(placed.select("block", "dim", "id", "label", "vector").groupBy("block").applyInArrow(build, BLOCK_SCHEMA), "negatives-blocks")


#: A chunk of queries: the anchors of a block with their windows, by anchor and window.
CHUNK_SCHEMA = "chunk string, dim int, most double, n int, windows int, places binary, ids binary, labels binary, vectors binary, least binary, greatest binary, positives binary"
FOUND_SCHEMA = "chunk string, place long, window int, score long, id long"


def chunks_of(blocks: DataFrame) -> DataFrame:
    """CHUNK_SCHEMA of all anchors, with one window that holds everything."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.frombuffer(r["anchors"], "<i8")
                if len(at):
                    cells = np.frombuffer(r["vectors"], "<i8" if r["wide"] else "<i4").reshape(len(r["ids"]) // 8, r["dim"])[at]
                    n = len(at)
                    row = {"chunk": r["block"], "dim": r["dim"], "most": r["most"], "n": n, "windows": 1, "places": r["anchors"], "ids": np.frombuffer(r["ids"], "<i8")[at].tobytes(), "labels": np.frombuffer(r["labels"], "<i8")[at].tobytes(), "vectors": cells.astype("<i8").tobytes()}
                    yield pa.RecordBatch.from_pylist([row | {"least": np.full(n, -np.inf).tobytes(), "greatest": np.full(n, np.inf).tobytes(), "positives": b""}], CHUNK)

    return blocks.select("block", "dim", "most", "wide", "ids", "labels", "vectors", "anchors").mapInArrow(cut, CHUNK_SCHEMA)


CHUNK = pa.schema([("chunk", pa.string()), ("dim", pa.int32()), ("most", pa.float64()), ("n", pa.int32()), ("windows", pa.int32()), *((c, pa.binary()) for c in ("places", "ids", "labels", "vectors", "least", "greatest", "positives"))])


def _windows(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(row[c], "<f8").reshape(row["n"], row["windows"]) for c in ("least", "greatest"))


def pairs_of(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """chunk, block of those where a window of some query meets the block's bounds."""
    parts = -(-blocks.count() // SUMMARIES)
    ranked = blocks.select("block", "dim", "centre", "cover", F.pmod(F.xxhash64("block"), F.lit(max(1, parts))).alias("part"))
    summaries = ranked.groupBy("part", "dim").agg(F.sort_array(F.collect_list(F.struct("block", "cover", "centre"))).alias("blocks"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                queries = np.frombuffer(r["vectors"], "<i8").reshape(r["n"], r["dim"]).astype(float)
                centres = np.stack([np.frombuffer(b["centre"], "<f8") for b in r["blocks"]])
                low, high = bounds(queries @ centres.T, np.array([b["cover"] for b in r["blocks"]]), np.sqrt((queries**2).sum(1)), r["most"])
                hit = np.flatnonzero(meets(low, high, *_windows(r)).any(0)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]] * len(hit), pa.string()), pa.array([r["blocks"][b]["block"] for b in hit], pa.string())], ["chunk", "block"])

    asked = chunks.select("chunk", "dim", "most", "n", "windows", "vectors", "least", "greatest").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, parts) - 1).cast("long"))))
    return asked.join(summaries, ["part", "dim"]).drop("part").mapInArrow(meet, "chunk string, block string")


def search(chunks: DataFrame, blocks: DataFrame, pairs: DataFrame, same: bool, k: int) -> DataFrame:
    """FOUND_SCHEMA: for each pair the first k rows by query and window."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if r["block"] != name:
                    name, block = r["block"], Block({c: r[f"b_{c}"] for c in ("ids", "labels", "vectors", "wide", "dim", "most", "radius", "nodes")})
                places, labels = np.frombuffer(r["places"], "<i8"), np.frombuffer(r["labels"], "<i8")
                queries = np.frombuffer(r["vectors"], "<i8").reshape(r["n"], r["dim"]).astype(block.vectors.dtype)
                own = places if r["chunk"] == name else np.full(len(places), -1)
                least, greatest = _windows(r)
                for some in range(0, r["n"], 256):
                    part = slice(some, some + 256)
                    found = [(places[part][q], w, s, i) for q, w, scores, ids in block.search(queries[part], labels[part], own[part], same, least[part], greatest[part], k) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
                    columns = list(zip(*found, strict=True)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]] * len(found), pa.string()), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True))], ["chunk", "place", "window", "score", "id"])

    trees = blocks.select("block", *[F.col(c).alias(f"b_{c}") for c in ("ids", "labels", "vectors", "wide", "dim", "most", "radius", "nodes")])
    asked = chunks.select("chunk", "dim", "n", "windows", "places", "labels", "vectors", "least", "greatest")
    return pairs.join(asked, "chunk").join(trees, "block").mapInArrow(look, FOUND_SCHEMA)


def first(found: DataFrame, k: int) -> DataFrame:
    """found with rank: the first k by query and window."""
    order = Window.partitionBy("chunk", "place", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_windows(chunks: DataFrame, found: DataFrame, hundredths: tuple[int, int] | None, k: int) -> DataFrame:
    """chunks with new windows: from the k-th score found on, or between hundredths of each score found."""
    lists = found.groupBy("chunk").agg(F.collect_list(F.struct("place", "rank", "score", "id")).alias("found"))

    def renew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, windows = r["n"], k if hundredths else 1
                row_of = {p: i for i, p in enumerate(np.frombuffer(r["places"], "<i8").tolist())}
                least, greatest = np.full((n, windows), np.inf if hundredths else -np.inf), np.full((n, windows), -np.inf if hundredths else np.inf)
                positives = np.zeros((n, windows, 2), "<i8")
                for x in r["found"] or []:
                    q = row_of[x["place"]]
                    if hundredths:
                        least[q, x["rank"] - 1], greatest[q, x["rank"] - 1] = -(-hundredths[0] * x["score"] // 100), hundredths[1] * x["score"] // 100
                        positives[q, x["rank"] - 1] = x["score"], x["id"]
                    elif x["rank"] == k:
                        least[q, 0] = x["score"]
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in CHUNK.names} | {"windows": windows, "least": least.tobytes(), "greatest": greatest.tobytes(), "positives": positives.tobytes() if hundredths else b""}], CHUNK)

    return chunks.join(lists, "chunk", "left").mapInArrow(renew, CHUNK_SCHEMA)


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, hundredths: tuple[int, int] = (LOW, HIGH), anchor_every: int = ANCHOR_EVERY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of embeddings (vec_id, embedding, label).

    Rows with a null label, a null vector or any null or non-finite component take no
    part.  A null vec_id is never an anchor and is last among ties.  Repeated rows are
    rows like others: each repeats its results as an anchor, and is another row for its
    copies.  Vectors meet those of their own length only, the empty ones too.  Scores must
    fit in a long.  Ties go by smaller vec_id.  An empty table gives an empty one;
    further columns are not looked at.
    """
    blocks = blocks_of(shared_table(prepared(vectors).withColumn("row", F.monotonically_increasing_id()), "negatives-cells"), anchor_every, block_rows)
    chunks = shared_table(chunks_of(blocks), "negatives-chunks")
    # an anchor's own block gives a score that its last positive reaches at least
    home = chunks.select("chunk", F.col("chunk").alias("block"))
    near = shared_table(first(search(chunks, blocks, home, True, positives), positives), "negatives-near")
    bounded = shared_table(with_windows(chunks, near, None, positives), "negatives-bounded")
    away = pairs_of(bounded, blocks).where("chunk <> block")
    far = search(bounded, blocks, away, True, positives)
    best = shared_table(first(near.drop("rank").unionAll(far), positives), "negatives-positives")
    asked = shared_table(with_windows(chunks, best, hundredths, positives), "negatives-windows")
    found = first(search(asked, blocks, pairs_of(asked, blocks), False, negatives), negatives)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                places, ids = np.frombuffer(r["places"], "<i8"), np.frombuffer(r["ids"], "<i8")
                pairs = np.frombuffer(r["positives"], "<i8").reshape(r["n"], r["windows"], 2)
                q, w = (x.ravel() for x in np.indices(pairs.shape[:2]))
                yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]] * len(q), pa.string()), pa.array(places[q]), pa.array(w, pa.int32()), pa.array(ids[q]), pa.array(pairs[q, w, 1]), pa.array(pairs[q, w, 0])], ["chunk", "place", "window", "anchor_id", "positive_id", "positive_score"])

    named = asked.select("chunk", "n", "windows", "places", "ids", "positives").mapInArrow(anchors, "chunk string, place long, window int, anchor_id long, positive_id long, positive_score long")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return found.join(named, ["chunk", "place", "window"]).select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != NO_ID, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = f"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % {NOISE_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN {LOW} * p.score AND {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}
"""
