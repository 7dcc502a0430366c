"""Edit distances, pairwise alignment and clustering; a row or a group is small, and there are many of them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from segmill.functions.tokens import apart

# --- edit distances ----------------------------------------------------------------------


def edit_distance(a: Column, b: Column) -> Column:
    """Of two strings, at unit costs."""
    return F.levenshtein(a, b)


def _operations(x: list, y: list, prefix: bool, costs: tuple[float, float, float], same: Callable) -> tuple[float, str]:
    """(cost, operations) from x to y: H hit, S substitution, D deletion, I insertion.  With prefix, what of y follows the best match is free (P)."""
    insert, delete, change = costs
    n, m = len(x), len(y)
    table = np.zeros((n + 1, m + 1))
    table[:, 0], table[0, :] = np.arange(n + 1) * delete, np.arange(m + 1) * insert
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            table[i, j] = min(table[i - 1, j - 1] + same(x[i - 1], y[j - 1]) * change, table[i - 1, j] + delete, table[i, j - 1] + insert)
    j = int(np.argmin(table[n])) if prefix else m
    cost, i, trace = float(table[n, j]), n, ["P"] * (m - j)
    while i or j:
        if i and j and np.isclose(table[i, j], table[i - 1, j - 1] + same(x[i - 1], y[j - 1]) * change):
            trace.append("H" if x[i - 1] == y[j - 1] else "S")
            i, j = i - 1, j - 1
        elif j and np.isclose(table[i, j], table[i, j - 1] + insert):
            trace.append("I")
            j -= 1
        else:
            trace.append("D")
            i -= 1
    return cost, "".join(reversed(trace))


def edit_operations(a: Column, b: Column, prefix: bool = False, costs: tuple[float, float, float] = (1.0, 1.0, 1.0), words: bool = False) -> Column:
    """struct<cost, operations> of two strings, or of two arrays of words.

    costs are those of insertion, deletion and substitution; between words a
    substitution costs its share of the words' character distance.
    """

    def same(x, y):
        return 0.0 if x == y else 1.0 if not words else _operations(list(x), list(y), False, (1, 1, 1), lambda p, q: float(p != q))[0] / max(len(x), len(y), 1)

    @pandas_udf("struct<cost:double,operations:string>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_operations(list(x), list(y), prefix, costs, same) for x, y in zip(xs, ys, strict=True)], columns=["cost", "operations"])

    return apart(run)(a, b)


# --- pairwise alignment --------------------------------------------------------------------

MODES = ("global", "semi_global", "half_local", "local")


@dataclass(frozen=True)
class Scores:
    """What moves add to an alignment of single items.

    expansion, compression and transposition are None where they are not allowed.
    """

    match: int = 100
    mismatch: int = 0
    gap: int = -100
    expansion: int | None = None
    compression: int | None = None
    transposition: int | None = None

    def moves(self, x: list, y: list, i: int, j: int):
        """(items of x, items of y, score) of the moves that end at i, j."""
        if i and j:
            yield 1, 1, self.match if x[i - 1] == y[j - 1] else self.mismatch
        if j:
            yield 0, 1, self.gap
        if self.expansion is not None and i and j > 1:
            yield 1, 2, self.expansion if x[i - 1] in y[j - 2 : j] else self.mismatch
        if i:
            yield 1, 0, self.gap
        if self.compression is not None and i > 1 and j:
            yield 2, 1, self.compression if y[j - 1] in x[i - 2 : i] else self.mismatch
        if self.transposition is not None and i > 1 and j > 1 and x[i - 2] == y[j - 1] and x[i - 1] == y[j - 2]:
            yield 2, 2, self.transposition


def align_pair(x: list, y: list, mode: str, scores: Scores) -> tuple[int, list[tuple[str, str]], int, int, int, int]:
    """(score, columns, start1, end1, start2, end2) of the best alignment of two sequences.

    global: all of both; semi_global: free ends; half_local: both from the
    start, ends free; local: any parts.
    """
    n, m = len(x), len(y)
    best = np.full((n + 1, m + 1), np.iinfo(np.int64).min // 2)
    came: dict[tuple[int, int], tuple[int, int]] = {}
    free_start = mode in ("local", "semi_global")
    for i in range(n + 1):
        for j in range(m + 1):
            if (i, j) == (0, 0) or (free_start and (i == 0 or j == 0)):
                best[i, j] = 0
                continue
            for a, b, score in scores.moves(x, y, i, j):
                if best[i - a, j - b] + score > best[i, j]:
                    best[i, j], came[i, j] = best[i - a, j - b] + score, (a, b)
            if mode == "local" and best[i, j] < 0:
                best[i, j] = 0
                came.pop((i, j), None)
    if mode == "global":
        ends = [(n, m)]
    elif mode == "semi_global":
        ends = [(i, m) for i in range(n + 1)] + [(n, j) for j in range(m)]
    else:
        ends = [(i, j) for i in range(n + 1) for j in range(m + 1)]
    i, j = max(ends, key=lambda e: best[e])
    total, end1, end2, columns = int(best[i, j]), i, j, []
    while (i, j) in came and not (mode == "local" and best[i, j] == 0):
        a, b = came[i, j]
        columns.append((" ".join(map(str, x[i - a : i])), " ".join(map(str, y[j - b : j]))))
        i, j = i - a, j - b
    return total, columns[::-1], i, end1, j, end2


def best_alignments(x: list, y: list, mode: str, scores: Scores, most: int) -> tuple[int, list[list[tuple[str, str]]]]:
    """(score, alignments as columns): all that have the best score, the first `most` of them in the order of their moves."""
    n, m = len(x), len(y)
    low, free = np.iinfo(np.int64).min // 2, mode in ("local", "semi_global")
    best, came = np.full((n + 1, m + 1), low), defaultdict(list)
    for i in range(n + 1):
        for j in range(m + 1):
            moves = [(int(best[i - a, j - b]) + score, a, b) for a, b, score in scores.moves(x, y, i, j)] if i or j else []
            best[i, j] = max([0, *(v for v, *_ in moves)] if mode == "local" or not (i or j) or (free and not (i and j)) else [v for v, *_ in moves])
            if mode != "semi_global" or (i and j):
                came[i, j] = [(a, b) for v, a, b in moves if v == best[i, j]]
    ends = {"global": [(n, m)], "semi_global": sorted({*((i, m) for i in range(n + 1)), *((n, j) for j in range(m + 1))})}.get(mode) or [(i, j) for i in range(n + 1) for j in range(m + 1)]
    total = int(max(best[e] for e in ends))
    found: list[list[tuple[str, str]]] = []
    open_ = [(*e, ()) for e in reversed(ends) if best[e] == total]
    while open_ and len(found) < most:
        i, j, columns = open_.pop()
        stops = (i, j) == (0, 0) or (free and best[i, j] == 0 and (mode == "local" or not (i and j)))
        if stops:
            found.append(list(columns))
        else:
            for a, b in reversed(came[i, j]):
                open_.append((i - a, j - b, ((" ".join(map(str, x[i - a : i])), " ".join(map(str, y[j - b : j]))), *columns)))
    return total, found


def all_aligned(a: Column, b: Column, mode: str = "global", scores: Scores = Scores(), most: int = 100) -> Column:
    """struct<score, alignments array<array<struct<a, b>>>> of two arrays: every best alignment, `most` at most, as their number grows without bound."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")

    @pandas_udf("struct<score:long,alignments:array<array<struct<a:string,b:string>>>>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        found = [best_alignments(list(x), list(y), mode, scores, most) for x, y in zip(xs, ys, strict=True)]
        return pd.DataFrame({"score": [f[0] for f in found], "alignments": [[[{"a": p, "b": q} for p, q in one] for one in f[1]] for f in found]})

    return apart(run)(a, b)


def aligned(a: Column, b: Column, mode: str = "global", scores: Scores = Scores()) -> Column:
    """struct<score, normalized, columns array<struct<a, b>>, start1, end1, start2, end2> of two arrays.

    The normalized score is the share of the most that the longer could have,
    items outside the alignment counting half.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")

    def most(n: int, start: int, end: int) -> int:
        return (end - start) * scores.match + (n - end + start) * (scores.match // 2)

    @pandas_udf("struct<score:long,normalized:double,columns:array<struct<a:string,b:string>>,start1:int,end1:int,start2:int,end2:int>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(xs, ys, strict=True):
            score, columns, s1, e1, s2, e2 = align_pair(list(x), list(y), mode, scores)
            top = max(most(len(x), s1, e1), most(len(y), s2, e2))
            rows.append((score, max(0.0, min(1.0, score / top)) if top else 0.0, [{"a": p, "b": q} for p, q in columns], s1, e1, s2, e2))
        return pd.DataFrame(rows, columns=["score", "normalized", "columns", "start1", "end1", "start2", "end2"])

    return apart(run)(a, b)


# --- clustering --------------------------------------------------------------------------


def _square(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    items = sorted({*pdf["a"], *pdf["b"]})
    at = {x: i for i, x in enumerate(items)}
    d = np.zeros((len(items), len(items)))
    for a, b, v in zip(pdf["a"], pdf["b"], pdf["distance"], strict=True):
        d[at[a], at[b]] = d[at[b], at[a]] = v
    return items, d


def _tree(pdf: pd.DataFrame, joining: bool) -> list[tuple[str, str, float]]:
    """Edges (parent, child, length) of UPGMA, or of neighbour joining; inner nodes are numbered #0, #1, ...

    An inner node that would hang on an edge without length gives its children to its parent.
    """
    items, d = _square(pdf)
    names, size, height = list(items), {x: 1 for x in items}, {x: 0.0 for x in items}
    dist = {frozenset((a, b)): d[i, j] for i, a in enumerate(items) for j, b in enumerate(items) if i < j}
    children: dict[str, list[tuple[str, float]]] = {}
    made = 0
    while len(names) > (2 if joining else 1):
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        r = {a: sum(dist[frozenset((a, b))] for b in names if b != a) / (len(names) - 2) for a in names} if joining else dict.fromkeys(names, 0.0)
        a, b = min(pairs, key=lambda p: dist[frozenset(p)] - r[p[0]] - r[p[1]])
        gap, node = dist.pop(frozenset((a, b))), f"#{made}"
        made += 1
        left = gap / 2 + (r[a] - r[b]) / 2 if joining else gap / 2 - height[a]
        right = gap - left if joining else gap / 2 - height[b]
        children[node] = []
        for child, length in ((a, left), (b, right)):
            children[node] += children.pop(child) if length <= 0 and child in children else [(child, max(length, 0.0))]
        height[node], size[node] = gap / 2, size[a] + size[b]
        names = [x for x in names if x not in (a, b)]
        for x in names:
            da, db = dist.pop(frozenset((x, a))), dist.pop(frozenset((x, b)))
            dist[frozenset((x, node))] = (da + db - gap) / 2 if joining else (size[a] * da + size[b] * db) / size[node]
        names.append(node)
    edges = [(p, c, length) for p, cs in children.items() for c, length in cs]
    if joining and len(names) == 2:
        edges.append((names[1], names[0], dist[frozenset(names)]))
    return edges


def cluster_trees(distances: DataFrame, group: str, method: str = "upgma") -> DataFrame:
    """group, parent, child, length: a tree for each group of distances (group, a, b, distance).

    A group is a matrix that fits into a task; there may be any number of groups.
    """
    kind = dict(distances.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = _tree(pdf, method == "neighbor_joining")
        return pd.DataFrame([(pdf[group].iloc[0], *e) for e in edges], columns=[group, "parent", "child", "length"])

    return distances.groupBy(group).applyInPandas(run, f"{group} {kind}, parent string, child string, length double")


def flat_clusters(distances: DataFrame, group: str, threshold: float) -> DataFrame:
    """group, item, cluster (its first item): merged while mean distance less a quarter of its deviation is within the threshold."""
    kind = dict(distances.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items, d = _square(pdf)
        clusters = [[i] for i in range(len(items))]
        while len(clusters) > 1:
            linkage = lambda p: (lambda v: v.mean() - 0.25 * v.std())(d[np.ix_(clusters[p[0]], clusters[p[1]])])
            pairs = [(i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters))]
            i, j = min(pairs, key=linkage)
            if linkage((i, j)) > threshold:
                break
            merged = clusters[i] + clusters[j]
            clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [merged]
        return pd.DataFrame([(pdf[group].iloc[0], items[i], items[min(c)]) for c in clusters for i in c], columns=[group, "item", "cluster"])

    return distances.groupBy(group).applyInPandas(run, f"{group} {kind}, item string, cluster string")
