"""A Merkle manifest of a dataset, kept as a postorder append log.

Each row is a leaf; the rows of a group, in order, are the leaves of a tree whose nodes have up to
`fanout` children, and the roots of the groups' trees are the leaves of a tree above them.  Leaves are
numbered once; an aligned builder takes the leaves of one whole subtree and appends every node to its
log when the node's last child is there, that is in postorder.  A log is therefore one row of digests a
builder, and the roots of builders are the leaves of the builders above.

Where a node stands in such a log follows from the sizes of the subtrees alone (`position`).  Proofs are
read from the written logs by those places, from the top down: each builder's row gets the siblings
above its root, once for all of its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm.common import documents, shared_table

FANOUT = 8
#: A builder's subtree has this many levels of runs, so fanout to this power of leaves.
LEVELS = 4
#: What a leaf of documents holds, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of values, each as its bytes in UTF-8, a colon and itself, or '-' for null; nothing can pass for anything else."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def height(leaves: int, fanout: int = FANOUT) -> int:
    """Levels of runs until one node remains; none for a lone leaf."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // fanout), levels + 1
    return levels


def position(level: int, index: int, leaves: int, levels: int, fanout: int = FANOUT) -> int:
    """Place in a postorder log, from 0, of the index-th node of a level, in a tree of so many leaves and levels.

    When the node is written, `end` leaves are there: all nodes up to its own level
    that end with them are written too, above it only those that ended before it began.
    """
    start, end = index * fanout**level, min((index + 1) * fanout**level, leaves)
    return sum(-(-end // fanout**k) for k in range(level + 1)) + sum(start // fanout**k for k in range(level + 1, levels + 1)) - 1


def append_log(leaves: Sequence[str], levels: int, fanout: int = FANOUT) -> list[str]:
    """Digests of all nodes of the subtree over these leaves, in the order in which they are complete."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def close(level: int) -> None:
        node = digest(*runs[level])
        runs[level].clear()
        log.append(node)
        runs[level + 1].append(node)

    for leaf in leaves:
        log.append(leaf)
        runs[0].append(leaf)
        level = 0
        while level < levels and len(runs[level]) == fanout:
            close(level)
            level += 1
    for level in range(levels):
        if runs[level]:
            close(level)
    return log


def siblings(log: Sequence[str], leaves: int, levels: int, fanout: int = FANOUT) -> list[list[tuple[str, str]]]:
    """By level and node below the root: the digests left and right of it in its run, joined; read from the log by place."""
    found = []
    for level in range(levels):
        count = -(-leaves // fanout**level)
        nodes = [log[position(level, k, leaves, levels, fanout)] for k in range(count)]
        found.append([("".join(nodes[k - k % fanout : k]), "".join(nodes[k + 1 : k - k % fanout + fanout])) for k in range(count)])
    return found


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings, from the lowest level up, amount to."""
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """leaves (tree string, ...) with place, from 0 in each tree by `order`, and n, the tree's leaves.

    Rows are dealt out by ranges and sorted; a range's first place in a tree is the
    number of the tree's rows in earlier ranges.  A tree of any share of the rows
    spreads over many ranges.
    """
    dealt = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = shared_table(dealt.withColumn("__at", F.monotonically_increasing_id()), "merkle-leaves")
    rows = rows.withColumn("__range", F.shiftright("__at", 33))
    ranges = rows.groupBy("tree", "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = "sum(__rows) over (partition by tree order by __range rows between unbounded preceding and 1 preceding)"
    ranges = ranges.select("tree", "__range", (F.coalesce(F.expr(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.expr("sum(__rows) over (partition by tree)").alias("n"))
    return rows.join(ranges, ["tree", "__range"]).withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")


def _packed(digests: Sequence[str]) -> bytes:
    return bytes.fromhex("".join(digests))


def _unpacked(raw: bytes) -> list[str]:
    text = bytes(raw).hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


LOG_SCHEMA = "tree string, block long, n long, leaves long, levels int, log binary, root string"


def append_logs(leaves: DataFrame, carried: Sequence[str] = (), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row a builder: LOG_SCHEMA, and the carried columns of its leaves as arrays.

    leaves: tree, place, n (leaves of the tree), digest string.  A builder has the
    aligned places of one block; the tree's only builder goes up to its root.
    """
    width = fanout**levels
    kinds = dict(leaves.dtypes)
    schema = LOG_SCHEMA + "".join(f", `{c}` array<{kinds[c]}>" for c in carried)

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        first, m = rows.slice(0, 1).to_pylist()[0], rows.num_rows
        up = levels if first["n"] > width else height(first["n"], fanout)
        log = append_log(rows.column("digest").to_pylist(), up, fanout)
        built = {"tree": first["tree"], "block": first["block"], "n": first["n"], "leaves": m, "levels": up, "log": _packed(log), "root": log[-1]}
        kinds = {"tree": pa.string(), "levels": pa.int32(), "log": pa.binary(), "root": pa.string()}
        found = [pa.array([v], kinds.get(c, pa.int64())) for c, v in built.items()]
        lists = [pa.array([rows.column(c).to_pylist()], pa.list_(rows.schema.field(c).type)) for c in carried]
        return pa.Table.from_arrays(found + lists, [*built, *carried])

    blocks = leaves.withColumn("block", F.floor(F.col("place") / F.lit(width)))
    return blocks.select("tree", "block", "n", "place", "digest", *carried).groupBy("tree", "block").applyInArrow(build, schema)


def build_forest(leaves: DataFrame, carried: Sequence[str] = (), fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The written logs, lowest builders first; the roots of each are the leaves of the next, up to one builder a tree."""
    width, logs = fanout**levels, []
    while not logs or leaves is not None:
        log = shared_table(append_logs(leaves, () if logs else carried, fanout, levels), f"merkle-log-{len(logs)}")
        logs.append(log)
        above = log.where(F.col("n") > width)
        leaves = above.select("tree", F.col("block").alias("place"), F.ceil(F.col("n") / F.lit(width)).alias("n"), F.col("root").alias("digest")) if above.head(1) else None
    return logs


def roots(logs: Sequence[DataFrame], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """tree, root of every tree."""
    found = [log.where(F.col("n") <= fanout**levels).select("tree", "root") for log in logs]
    out = found[0]
    for one in found[1:]:
        out = out.unionAll(one)
    return out


def log_nodes(logs: Sequence[DataFrame], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Every node of the forest once: tree, position (in the tree's one postorder log), level, index, digest."""
    schema, out = "tree string, position long, level int, index long, digest string", None
    kinds = pa.schema([("tree", pa.string()), ("position", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())])

    for turn, log in enumerate(logs):

        def nodes(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    digests, below, tall = _unpacked(r["log"]), turn * levels, height(r["total"], fanout)
                    rows = []
                    for level in range(1 if turn else 0, r["levels"] + 1):  # a leaf above the lowest builders is a root there
                        for k in range(-(-r["leaves"] // fanout**level)):
                            index = r["block"] * fanout ** (levels - level) + k
                            rows.append((r["tree"], position(below + level, index, r["total"], tall, fanout), below + level, index, digests[position(level, k, r["leaves"], r["levels"], fanout)]))
                    yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, x, strict=True)) for x in rows], kinds)

        counted = logs[0].groupBy("tree").agg(F.max("n").alias("total"))
        part = log.select("tree", "block", "leaves", "levels", "log").join(counted, "tree").mapInArrow(nodes, schema)
        out = part if out is None else out.unionAll(part)
    return out


PATH_SCHEMA = "tree string, block long, above array<struct<left: string, right: string>>"


def paths(logs: Sequence[DataFrame], above: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The lowest logs with `above`: the siblings of all levels above a builder's root, lowest first.

    above: tree, and the siblings above the tree's own root.
    """
    width = fanout**levels

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for batch in batches:
            for r in batch.to_pylist():
                near = siblings(_unpacked(r["log"]), r["leaves"], r["levels"], fanout)
                own = [[{"left": x[0], "right": x[1]} for level, part in enumerate(near) for x in [part[k // fanout**level]]] + r["above"] for k in range(r["leaves"])]
                for at in range(0, len(own), 256):
                    some = own[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * len(some), pa.string()), pa.array(range(r["block"] * width + at, r["block"] * width + at + len(some)), pa.int64()), pa.array(some, kind)], ["tree", "block", "above"])

    tops = [log.where(F.col("n") <= width).select("tree", "block").join(above, "tree") for log in logs]
    have = tops[-1]
    for turn in range(len(logs) - 1, 0, -1):
        joined = logs[turn].select("tree", "block", "leaves", "levels", "log").join(have, ["tree", "block"])
        have = joined.mapInArrow(down, PATH_SCHEMA).unionByName(tops[turn - 1].select("tree", "block", "above"))
    return logs[0].join(have, ["tree", "block"])


def manifest(rows: DataFrame, carried: Sequence[str] = (), order: Sequence[str] = ("id", "digest"), fanout: int = FANOUT, levels: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Logs of the groups' trees, logs of the tree above them, and the lowest logs of the groups with the siblings above.

    rows: tree string (a group, in order of its bytes), digest string, and what `order` and
    `carried` name.  Rows that are alike in `order` have the same digest, so their order is of no account.
    An empty table has empty logs.
    """
    logs = build_forest(numbered(rows, order), carried, fanout, levels)
    groups = roots(logs, fanout, levels)
    tops = numbered(groups.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("digest")), ("id",))
    top_logs = build_forest(tops, ("id",), fanout, levels)
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    whole = roots(top_logs, fanout, levels).select("tree", F.col("root").alias("whole"))
    lowest = paths(top_logs, whole.select("tree", nothing.alias("above")), fanout, levels).join(whole, "tree")

    def tree_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                near = siblings(_unpacked(r["log"]), r["leaves"], r["levels"], fanout)
                for k, tree in enumerate(r["id"]):
                    above = [{"left": x[0], "right": x[1]} for level, part in enumerate(near) for x in [part[k // fanout**level]]] + r["above"]
                    yield pa.RecordBatch.from_pylist([{"tree": tree, "above": above, "whole": r["whole"]}], pa.schema([("tree", pa.string()), ("above", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("whole", pa.string())]))

    trees = shared_table(lowest.select("leaves", "levels", "log", "id", "above", "whole").mapInArrow(tree_paths, "tree string, above array<struct<left: string, right: string>>, whole string"), "merkle-trees")
    named = trees.select("tree", "whole").join(groups.withColumnRenamed("root", "subroot"), "tree")
    return logs, top_logs, paths(logs, trees.select("tree", "above"), fanout, levels).join(named, "tree")


PROOF_SCHEMA = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(lowest: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """PROOF_SCHEMA of every leaf: its proof's digest, and the root that its claim (null: the leaf itself) folds to.

    lowest: as `manifest` gives it, carrying `id` long and `claim` string.
    """

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m, up, log = r["leaves"], r["levels"], _unpacked(r["log"])
                near, above = siblings(log, m, up, fanout), [(x["left"], x["right"]) for x in r["above"]]
                tail = "".join(left + right for left, right in above)
                over = [""] * (-(-m // fanout**up))  # siblings of all levels from a node's own on, joined
                over[:] = [tail] * len(over)
                for level in range(up - 1, 0, -1):
                    over = [left + right + over[k // fanout] for k, (left, right) in enumerate(near[level])]
                out: dict[str, list] = {c: [] for c in ("leaf", "proof", "folded", "ok")}
                for k, claim in enumerate(r["claim"]):
                    leaf = log[position(0, k, m, up, fanout)]
                    left, right = near[0][k] if up else ("", "")
                    out["leaf"].append(leaf)
                    out["proof"].append(digest(left, right, over[k // fanout if up else 0]))
                    folded = fold(claim or leaf, [*(part[k // fanout**level] for level, part in enumerate(near)), *above])
                    out["folded"].append(folded)
                    out["ok"].append(folded == r["whole"])
                same = lambda x: pa.array(np.repeat(np.array([x], object), m), pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(r["id"], pa.int64()), pa.array(out["leaf"]), same(r["subroot"]), same(r["whole"]), pa.array(out["proof"]), pa.array(out["folded"]), pa.array(out["ok"])], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return lowest.select("id", "claim", "leaves", "levels", "log", "above", "subroot", "whole").mapInArrow(prove, PROOF_SCHEMA)


def document_leaves(docs: DataFrame, group: str = "lang", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """tree, id, digest, claim (the leaf after tampering; null: as it is) of documents.

    The null group's tree comes first.  Tampering lower-cases A-Z in the texts of the
    doc_id whose decimal CRC-32 three divides.
    """
    text = F.col("text")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & text.rlike("[A-Z]")
    altered = leaf_of([F.translate(text, UPPER, LOWER) if c == "text" else F.col(c) for c in columns])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf_of([F.col(c) for c in columns]).alias("digest"), F.when(tampered, altered).alias("claim"))


def document_proofs(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Manifest of documents with every row's proof, checked against a tampered copy.

    Each row is a leaf, repeated rows too, which share their doc_id and follow each
    other; a null doc_id comes first.  Null is a value of its own in any column, so
    null and empty texts differ.  A text of any length is hashed whole in the JVM and only
    its digest goes on.  An empty table gives an empty one; further columns are not looked at.
    """
    leaves = shared_table(document_leaves(docs), "merkle-digests")
    _, _, lowest = manifest(leaves, ("id", "claim"), fanout=fanout, levels=levels)
    return proofs(lowest, fanout).withColumnRenamed("id", "doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_proofs(documents(spark, sf_dir))


def _runs_sql(name: str, group: str, order: str, source: str) -> str:
    """CTEs <name> (rows by group, numbered) and <name>_up (every node of every level, with its run's siblings)."""
    part = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, " if group else ""
    return f"""
{name} AS (SELECT *, row_number() OVER ({part} ORDER BY {order}) - 1 AS place, count(*) OVER ({part}) AS n FROM {source}),
{name}_up AS (
    SELECT {keys}0 AS level, place, node, n FROM {name}
    UNION ALL
    SELECT {keys}level + 1 AS level, place // 8 AS place, sha256(string_agg(node, '' ORDER BY place)) AS node, (max(n) + 7) // 8 AS n
    FROM {name}_up WHERE n > 1 GROUP BY {keys}level, place // 8
)"""


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in COLUMNS) + ")"
_TEXT = f"translate(text, '{UPPER}', '{LOWER}')"
_TAMPERED = "sha256(" + " || ".join(_FIELD.format(_TEXT if c == "text" else c) for c in COLUMNS) + ")"
#: CRC-32 bit by bit, over the bits of doc_id's decimal digits from the lowest of each on.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length(doc_id::VARCHAR)), lambda k: ((ascii((doc_id::VARCHAR)[k // 8 + 1]) >> (k % 8)::INTEGER) & 1)::BIGINT)),
    lambda c, b: CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""

OP11_SQL = f"""
WITH RECURSIVE base AS MATERIALIZED (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF} AS node, CASE WHEN {_CRC} % 3 = 0 THEN {_TAMPERED} ELSE {_LEAF} END AS claim FROM documents
), {_runs_sql("low", "tree", "doc_id, node", "base")},
subroots AS (SELECT tree, node FROM low_up WHERE n = 1),
{_runs_sql("high", "", "tree", "subroots")},
whole AS (SELECT node AS root FROM high_up WHERE n = 1),
low_near AS (
    SELECT a.tree, a.level, a.place, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
    FROM low_up a JOIN low_up b ON a.tree = b.tree AND a.level = b.level AND a.place // 8 = b.place // 8 WHERE a.n > 1 GROUP BY ALL
),
high_near AS (
    SELECT a.level, a.place, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
    FROM high_up a JOIN high_up b ON a.level = b.level AND a.place // 8 = b.place // 8 WHERE a.n > 1 GROUP BY ALL
),
walk AS (
    SELECT doc_id, node AS leaf, tree, false AS high, 0 AS level, place, n, claim AS folded, '' AS proof FROM low
    UNION ALL
    SELECT w.doc_id, w.leaf, w.tree, CASE WHEN w.high THEN true ELSE w.n = 1 END,
        CASE WHEN NOT w.high AND w.n = 1 THEN 0 ELSE w.level + 1 END,
        CASE WHEN NOT w.high AND w.n = 1 THEN h.place ELSE w.place // 8 END,
        CASE WHEN NOT w.high AND w.n = 1 THEN h.n ELSE (w.n + 7) // 8 END,
        CASE WHEN NOT w.high AND w.n = 1 THEN w.folded ELSE sha256(coalesce(ln.l, hn.l) || w.folded || coalesce(ln.r, hn.r)) END,
        CASE WHEN NOT w.high AND w.n = 1 THEN w.proof ELSE w.proof || coalesce(ln.l, hn.l) || coalesce(ln.r, hn.r) END
    FROM walk w LEFT JOIN high h ON h.tree = w.tree AND NOT w.high AND w.n = 1
    LEFT JOIN low_near ln ON NOT w.high AND ln.tree = w.tree AND ln.level = w.level AND ln.place = w.place AND w.n > 1
    LEFT JOIN high_near hn ON w.high AND hn.level = w.level AND hn.place = w.place AND w.n > 1
    WHERE NOT (w.high AND w.n = 1)
)
SELECT w.doc_id, w.leaf, s.node AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM walk w JOIN subroots s ON s.tree = w.tree CROSS JOIN whole WHERE w.high AND w.n = 1
"""
