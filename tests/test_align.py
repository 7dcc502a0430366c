"""Aligning against a merge of sorted streams."""

import random
from collections import Counter

import pytest

from segmill.operators.align import align_n, align_rows

SCHEMA = "text_id string, ref int, segment array<string>, sentence_start boolean, in_range boolean, range_start boolean, content_type string"


def merged(sides, every):
    """What align_n says of unique refs, one text at a time."""
    n, out = len(sides), []
    ids = [{r[0] for r in s} for s in sides]
    texts = set.intersection(*ids).union(*[i for i, e in zip(ids, every) if e])
    for text in sorted(texts):
        rows = [{r[1]: r for r in s if r[0] == text} for s in sides]
        held = [[] for _ in range(n)]

        def flush():
            if any(held):
                first = lambda h: next((r for r in h if r[2]), h[-1] if h else None)
                out.append((text, tuple(tuple(r[1] for r in h) for h in held), tuple(" ".join(w for r in h for w in r[2]) for h in held), tuple(bool(first(h) and first(h)[3]) for h in held)))
                for h in held:
                    h.clear()

        for ref in sorted(set().union(*rows)):
            here = [r.get(ref) for r in rows]
            whole = all(here)
            if whole:
                merge = any(here[i][4] and not any(every[j] for j in range(n) if j != i) for i in range(n))
            else:
                merge = any(r and r[4] for r in here) and any(r is None and not every[i] for i, r in enumerate(here))
            if merge:
                if whole and all(r[5] or not r[4] for r in here):
                    flush()
                for i, r in enumerate(here):
                    if r:
                        held[i].append(r)
                continue
            shown = [r if r and (whole or every[i]) else None for i, r in enumerate(here)]
            if any(shown):
                flush()
                out.append((text, ((ref,),) * n, tuple(" ".join(r[2]) if r else "" for r in shown), tuple(bool(r and r[3]) for r in shown)))
        flush()
    return Counter(out)


def corpus(rng, ranges):
    rows = []
    for text in ("a", "b", "c"):
        if rng.random() < 0.2:
            continue
        inside = 0
        for ref in range(1, 15):
            if rng.random() < 0.25:
                continue
            start = ranges and inside == 0 and rng.random() < 0.3
            if start:
                inside = rng.randint(1, 3)
            rows.append((text, ref, [] if rng.random() < 0.15 else [f"w{rng.randrange(50)}"] * rng.randint(1, 2), rng.random() < 0.7, inside > 0, bool(start), "segment"))
            inside = max(0, inside - 1)
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_align_against_merge(spark, seed):
    rng = random.Random(seed)
    n = 2 if seed < 4 else 3
    sides = [corpus(rng, ranges=seed % 3 != 0) for _ in range(n)]
    every = [rng.random() < 0.4 for _ in range(n)]
    frames = [spark.createDataFrame(s, SCHEMA) for s in sides]
    found = Counter((r.text_id, tuple(tuple(x) for x in r.refs), tuple(" ".join(x) for x in r.segments), tuple(r.sentence_starts)) for r in align_n(frames, every).collect())
    assert found == merged(sides, every)


def test_repeated_refs_give_all_combinations(spark):
    row = lambda ref, word: ("t", ref, [word], True, False, False, "segment")
    source, target = spark.createDataFrame([row(1, "a"), row(2, "b"), row(2, "c")], SCHEMA), spark.createDataFrame([row(2, "x"), row(2, "y"), row(3, "z")], SCHEMA)
    found = sorted((r.source_segment[0], r.target_segment[0]) for r in align_rows(source, target).collect())
    assert found == [("b", "x"), ("b", "y"), ("c", "x"), ("c", "y")]
    assert align_rows(source, target, all_source_rows=True, all_target_rows=True).count() == 6


def test_pairs_are_looked_up_where_both_sides_have_tokens(spark):
    row = lambda ref, words: ("t", ref, words, True, False, False, "segment")
    source, target = spark.createDataFrame([row(1, ["a"]), row(2, []), row(3, ["b"])], SCHEMA), spark.createDataFrame([row(i, ["x"]) for i in (1, 2, 3)], SCHEMA)
    pairs = spark.createDataFrame([("t", i, [(0, 0)]) for i in (1, 2)], "text_id string, ref int, pairs array<struct<source_index:int,target_index:int>>")
    assert {r.ref: r.pairs is not None for r in align_rows(source, target, pairs).collect()} == {1: True, 2: False, 3: False}
