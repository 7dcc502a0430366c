"""Operators 11 to 13 against brute force and the tokenizers library, on odd tables too."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from segmill.llm import byte_bpe, hard_negatives, merkle, queries
from segmill.llm.common import shared_table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def take(frame):
    return [r.asDict() for r in frame.collect()]


# 11


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_by_hand(nodes, fanout=8):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha(*found[-1][i : i + fanout]) for i in range(0, len(found[-1]), fanout)])
    return found


def postorder(levels, fanout):
    """(level, index) of all nodes, children first."""
    out = []

    def visit(level, index):
        if level:
            for child in range(index * fanout, min((index + 1) * fanout, len(levels[level - 1]))):
                visit(level - 1, child)
        out.append((level, index))

    visit(len(levels) - 1, 0)
    return out


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_log_positions(fanout):
    for n in [*range(1, 40), 64, 65, 200, 513]:
        levels = levels_by_hand([sha(str(i)) for i in range(n)], fanout)
        order = postorder(levels, fanout)
        assert merkle.height(n, fanout) == len(levels) - 1
        assert [merkle.position(level, index, n, len(levels) - 1, fanout) for level, index in order] == list(range(len(order)))
        log = merkle.append_log(levels[0], len(levels) - 1, fanout)
        assert log == [levels[level][index] for level, index in order]
        for k, path in enumerate(zip(*[[part[i // fanout**level] for i in range(n)] for level, part in enumerate(merkle.siblings(log, n, len(levels) - 1, fanout))], strict=True)):
            assert merkle.fold(levels[0][k], path) == levels[-1][0]


def leaf_by_hand(doc_id, text, lang, source, n_chars):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def proofs_by_hand(rows, fanout=8):
    trees = defaultdict(list)
    for d, text, lang, source, n_chars, *_ in rows:
        leaf = leaf_by_hand(d, text, lang, source, n_chars)
        low = None if text is None else "".join(c.lower() if c in merkle.UPPER else c for c in text)
        claim = leaf_by_hand(d, low, lang, source, n_chars) if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else leaf
        trees[lang].append((d is not None, d or 0, leaf, claim, d))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels_by_hand([leaf for _, _, leaf, _, _ in sorted(trees[x])], fanout) for x in names}
    top = levels_by_hand([built[x][-1][0] for x in names], fanout)
    found = Counter()
    for t, x in enumerate(names):
        for k, (_, _, leaf, claim, d) in enumerate(sorted(trees[x])):
            proof, folded = [], claim
            for levels, at in ((built[x], k), (top, t)):
                for nodes in levels[:-1]:
                    run = at - at % fanout
                    left, right = nodes[run:at], nodes[at + 1 : run + fanout]
                    proof += left + right
                    folded, at = sha(*left, folded, *right), at // fanout
            found[d, leaf, built[x][-1][0], top[-1][0], sha(*proof), folded, folded == top[-1][0]] += 1
    return found


PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("fanout", "levels"), [(8, 4), (2, 2), (3, 1)])
def test_proofs(spark, docs, rows, fanout, levels):
    """Small builders meet in several rounds."""
    rows = [(d, text and text.title(), *rest) for d, text, *rest in rows]
    found = take(merkle.document_proofs(spark.createDataFrame(rows, docs.schema).repartition(3), fanout, levels))
    assert Counter(tuple(r[c] for c in PROOF) for r in found) == proofs_by_hand(rows, fanout)
    assert {r["verified"] for r in found} == {True, False}


def test_many_groups_of_one(spark):
    rows = [(i, f"T{i}", f"l{i:03d}", "s", 1) for i in range(200)] + [(3, None, None, None, None)]
    found = take(merkle.document_proofs(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")))
    assert Counter(tuple(r[c] for c in PROOF) for r in found) == proofs_by_hand(rows)


def test_logs_are_one_postorder_log(spark):
    """The builders' logs hold every node once, at the places that the whole tree's log has."""
    leaves = spark.createDataFrame([("", i, sha(str(i))) for i in range(61)], "tree string, id long, digest string")
    logs, _, _ = merkle.manifest(leaves, order=("id",), fanout=2, levels=2)
    assert len(logs) == 3
    levels = levels_by_hand([sha(str(i)) for i in range(61)], 2)
    want = [(k, level, index, levels[level][index]) for k, (level, index) in enumerate(postorder(levels, 2))]
    assert sorted((r["position"], r["level"], r["index"], r["digest"]) for r in take(merkle.log_nodes(logs, 2, 2))) == want


def test_no_documents_have_no_proofs(empty):
    assert take(merkle.document_proofs(empty)) == []


# 12


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe.tokenizer_path())


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(byte_bpe.tokenizer_path())


PARTS = ["a", "b", "e", "the", "ing", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "1", "23", "!", "==", "-", "é", "ß", "日本", "語", "🙂", "́", " ", "　", "x", "don't", "<|endoftext|>", "<|endof", "ſ", "क्", "\r\n"]


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 20])
def test_halves_join_to_the_librarys_ids(bpe, library, monkeypatch, leaf):
    monkeypatch.setattr(byte_bpe, "LEAF", leaf)
    rng = random.Random(leaf)
    for _ in range(600):
        text = "".join(rng.choices(PARTS, [rng.random() ** rng.choice([1, 4, 12]) for _ in PARTS], k=rng.randint(1, 80)))
        text = text if rng.random() < 0.7 else text.replace(" ", "")
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text).tolist() == ids
        assert bpe.decode(np.array(ids, "<u2")) == library.decode(ids, skip_special_tokens=False)
        size = rng.randint(1, 30)
        ends = bpe.cuts(text, size)
        assert bpe.joined([bpe.encode(text[a:b]) for a, b in zip([0, *ends], ends, strict=False)]).tolist() == ids


@pytest.mark.parametrize("text", ["a" * 5001, "ab" * 3000, "=" * 4001 + "x" + "-" * 3333, " " * 4000 + "x" + " " * 3001, "日本語" * 2000, "🙂" * 1500, "AAAA+/ab3" * 500, "'" * 3001, "!'s" * 2000])
def test_long_unsplit_texts(bpe, library, monkeypatch, text):
    monkeypatch.setattr(byte_bpe, "LEAF", 64)
    assert bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_broken_bytes_decode_as_in_the_library(bpe, library):
    rng = random.Random(9)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(1, 9))]
        assert bpe.decode(np.array(ids, "<u2")) == library.decode(ids, skip_special_tokens=False)


def coded_by_hand(library, rows):
    found = Counter()
    for d, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        found[d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    return found


def test_op12(spark, docs, rows, library, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = take(queries.QUERIES["op12_bpe_coding"](spark, str(tmp_path)))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == coded_by_hand(library, rows)


def test_blocks_of_a_text_meet_in_rounds(docs, rows, library, empty):
    """Blocks of 50 characters: some texts take three rounds."""
    found = take(byte_bpe.encode(docs, finish=byte_bpe.DIGESTS, block=50))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == coded_by_hand(library, rows)
    coded = byte_bpe.encode(docs)
    assert Counter((r["doc_id"], r["text"]) for r in take(byte_bpe.decode(coded))) == Counter((r[0], r[1] or "") for r in rows)
    assert take(byte_bpe.encode(empty)) == []


# 13


def negatives_by_hand(rows, anchor_every=100):
    held = []
    for vec_id, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            held.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    found = Counter()
    for a, (anchor, label, v) in enumerate(held):
        if anchor is None or anchor % anchor_every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for b, (i, other, w) in enumerate(held) if b != a and len(w) == len(v)]
        for score, positive, _ in sorted([s for s in scored if s[2]], key=order)[:5]:
            hard = sorted([s for s in scored if not s[2] and 30 * score <= 100 * s[0] <= 90 * score], key=order)[:10]
            for rank, (negative, i, _) in enumerate(hard, 1):
                found[anchor, positive, rank, i, score, negative] += 1
    return found


VECTORS = "vec_id long, embedding array<double>, label int, block string, score long, id long"


def odd_vectors(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(420):
        centre = [3, -1, 2][i % 3]
        vector = [round(rng.gauss(centre if k == i % 3 else 0, 0.4), 2) for k in range(6)]
        rows.append((i, vector if i % 5 else [0.5, 0.25, 0.0, 1.0, -0.5, 0.125], rng.choice([0, 1, 2, None] if i % 40 == 1 else [0, 1, 2])))
    rows += [rows[100], rows[100], rows[105], rows[7], (None, rows[8][1], 1), (None, rows[9][1], 2), (500, None, 1), (600, [float("nan")] * 6, 1), (700, [float("inf")] + [0.0] * 5, 1), (800, [None] * 6, 1), (900, [], 1), (901, [], 2), (902, [], 1), (1000, [1.0, 2.0], 1), (1001, [1.0, 1.5], 1), (1002, [1.0, 0.5], 2), (1100, [0.0] * 6, 0), (-100, rows[30][1], 2)]
    return rows


NEGATIVE = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize(("anchor_every", "block_rows"), [(100, 4096), (5, 40)])
def test_hard_negatives(spark, anchor_every, block_rows):
    rows = odd_vectors()
    table = spark.createDataFrame([(*r, "b", 1, 2) for r in rows], VECTORS).repartition(3)
    found = take(hard_negatives.hard_negatives(table, anchor_every=anchor_every, block_rows=block_rows))
    want = negatives_by_hand(rows, anchor_every)
    assert Counter(tuple(r[c] for c in NEGATIVE) for r in found) == want and len(want) > 100


def test_wide_numbers_stay_exact(spark):
    rows = [(i, [(-1) ** i * 3e6 + i, 2e6 * (i % 4)], i % 2) for i in range(120)]
    found = take(hard_negatives.hard_negatives(spark.createDataFrame([(*r, "b", 1, 2) for r in rows], VECTORS), anchor_every=10, block_rows=30))
    assert Counter(tuple(r[c] for c in NEGATIVE) for r in found) == negatives_by_hand(rows, 10)


def test_no_vectors_have_no_negatives(spark):
    assert take(hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS))) == []


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_cover_trees_cover(kind):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(900, 5))
    if kind == "clusters":
        points = rng.normal(size=(30, 5))[rng.integers(30, size=900)] * 9 + points * 0.1
    if kind == "copies":
        points[:600] = points[0]
    points = hard_negatives.augmented(points, float((points**2).sum(1).max()))
    order, nodes = hard_negatives.cover_tree(points)
    assert sorted(order.tolist()) == list(range(900))
    placed = points[order]
    leaves = np.flatnonzero(nodes["leaf"])
    assert sum((nodes["end"] - nodes["start"])[leaves]) == 900 and len(leaves) > 3
    for k in range(len(nodes["start"])):
        part, centre = placed[nodes["start"][k] : nodes["end"][k]], placed[nodes["centre"][k]]
        assert nodes["start"][k] <= nodes["centre"][k] < nodes["end"][k]
        assert np.sqrt(((part - centre) ** 2).sum(1)).max() <= nodes["radius"][k] + 1e-9
        below = np.flatnonzero(nodes["parent"] == k)
        if len(below):
            assert sorted(nodes["start"][below])[0] == nodes["start"][k] and max(nodes["end"][below]) == nodes["end"][k]
            assert nodes["radius"][below].max() < nodes["radius"][k] or nodes["radius"][k] == 0
    queries = rng.normal(size=(20, 5))
    low, high = hard_negatives.bounds(queries @ placed[nodes["centre"], :5].T, nodes["radius"], np.sqrt((queries**2).sum(1)), float((placed[0] ** 2).sum()))
    for k in range(len(nodes["start"])):
        inner = queries @ placed[nodes["start"][k] : nodes["end"][k], :5].T
        assert (inner.min(1) >= low[:, k]).all() and (inner.max(1) <= high[:, k]).all()


def test_clusters_are_skipped(spark):
    """Where vectors lie in clusters, blocks outside an anchor's windows are never searched."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 4)) * 5
    rows = [(i, (centres[i % 8] + rng.normal(size=4) * 0.05).tolist(), i // 8 % 2, "b", 1, 2) for i in range(800)]
    table = hard_negatives.prepared(spark.createDataFrame(rows, VECTORS)).withColumn("row", hard_negatives.F.monotonically_increasing_id())
    blocks = hard_negatives.blocks_of(shared_table(table, "rows"), 10, 100)
    chunks = hard_negatives.chunks_of(blocks)
    near = hard_negatives.first(hard_negatives.search(chunks, blocks, chunks.selectExpr("chunk", "chunk AS block"), True, 5), 5)
    pairs = hard_negatives.pairs_of(hard_negatives.with_windows(chunks, near, None, 5), blocks)
    assert pairs.count() <= 0.75 * chunks.count() * blocks.count()
