"""The registered queries themselves, whole rows, against brute force; the pipeline's stages on odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from segmill.llm import licenses, packing, queries
from test_operators import components_by_hand, exact_by_hand, print_by_hand, repeats_by_hand, words


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, docs):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(str(path / "documents.parquet"))
    return str(path)


def rows_of(spark, sf_dir, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf_dir).collect()]


def test_op2(spark, sf_dir, rows):
    found = rows_of(spark, sf_dir, "op2_sharding")
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes", None) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in found) == want
    slots, homes = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        homes[r["size"], r["text_crc32"]].add(r["shard"])
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())


def test_op4(spark, sf_dir, rows):
    want = Counter((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in repeats_by_hand([(r[0], words(r[1])) for r in rows]))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(spark, sf_dir, "op4_substring_dedup")) == want


def test_op6(spark, sf_dir, rows):
    hand = {(r[0], r[1]): print_by_hand(r[1]) for r in rows}
    root, least = components_by_hand(set(hand.values())), {}
    for (d, _), p in hand.items():
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    want = Counter((r[0], f"{hand[r[0], r[1]]:016x}", least.get(root[hand[r[0], r[1]]])) for r in rows)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(spark, sf_dir, "op6_simhash_near_dedup")) == want


def test_op7(spark, sf_dir, rows):
    found = rows_of(spark, sf_dir, "op7_exact_dedup")
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found) == exact_by_hand(rows)


def test_op9(spark, sf_dir, rows):
    encoder = packing.WordEncoder(packing.tokenizer_path())
    ids = {(r[0], len(x)): x for r in rows for x in [encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]]}
    covered, sequences = defaultdict(list), defaultdict(list)
    for p in rows_of(spark, sf_dir, "op9_packing"):
        part = np.array(ids[p["doc_id"], p["doc_tokens"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"]
        covered[p["doc_id"], p["doc_tokens"]] += range(p["start"], p["start"] + p["length"])
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    repeats = Counter(r[0] for r in rows)
    assert {k: sorted(v) for k, v in covered.items()} == {k: sorted([*range(k[1])] * repeats[k[0]]) for k in ids}
    for held in sequences.values():
        assert [o for o, _ in sorted(held)] == [0, *np.cumsum([n for _, n in sorted(held)])[:-1].tolist()]
        assert sum(n for _, n in held) == 2048 or sum(n for _, n in held).bit_count() == 1


def test_op10(spark, sf_dir, rows):
    want = Counter()
    for d, text, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = lambda table: [(k, label) for phrase, label in table.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]  # noqa: B023, E731
        base, more = at(licenses.BASE), at(licenses.NOTICES)
        labels = ",".join(sorted({x for _, x in base + more}))
        want[d, len(w), len(base), min((k for k, _ in base), default=None), max((k for k, _ in base), default=None), ",".join(sorted({x for _, x in base})), labels, round(1 - 0.5 ** len(base + more), 9)] += 1
    found = rows_of(spark, sf_dir, "op10_license_scans")
    assert Counter((*[r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")], round(r["score"], 9)) for r in found) == want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, docs, empty, name):
    """Nulls, empty and long texts, ties, repeated rows, clashing names, and no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "")
    if name != "packing":
        assert out.columns == docs.columns
    assert out.count() > 0 and stage(spark, empty, "").count() == 0
