"""The pipeline, stage by stage, against brute force."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from segmill.llm import packing
from segmill.llm.common import shared_table

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(40):
        w = [word() for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(w))
        if rng.random() < 0.3:
            texts.append(" ".join(w))
        if rng.random() < 0.4:
            near = list(w)
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    texts += ["too short", "", None, "again and again " * 60]
    rng.shuffle(texts)
    return [(i, t, "en", rng.choice(["a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    held = []
    for name, stage in corpus_pipeline.STAGES:
        docs = shared_table(stage(spark, docs, ""), f"test-{name}")
        held.append(docs.collect())
        if name != "packing":
            assert docs.columns == NAMES
    quality, exact, near, mixed, packed = held

    good = [r for r in rows if r[1] and len(r[1].split()) >= 20 and not r[1].startswith("again")]
    assert sorted(r.doc_id for r in quality) == sorted(r[0] for r in good)

    last = {}
    for r in good:
        last[r[1]] = max(r[0], last.get(r[1], -1))
    assert sorted(r.doc_id for r in exact) == sorted(last.values())

    group = {r.doc_id: r.doc_id for r in exact}
    find = lambda x: x if group[x] == x else find(group[x])
    sets = {r.doc_id: shingles(r.text) for r in exact}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[find(b)] = find(a)
    assert sorted(r.doc_id for r in near) == sorted({find(x) for x in group})

    copies, taken, sizes = Counter(r.doc_id for r in mixed), Counter(), Counter()
    assert set(copies) <= {r.doc_id for r in near} and max(copies.values()) <= 2
    for r in near:
        sizes[r.source] += len(r.text.split())
        taken[r.source] += copies[r.doc_id] * len(r.text.split())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 3 * 200

    encoder = packing.WordEncoder(packing.tokenizer_path())
    tokens = {r.doc_id: len(encoder.tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in near}
    counted = defaultdict(int)
    for p in packed:
        counted[p.doc_id] += p.length
    assert dict(counted) == {d: n * tokens[d] for d, n in copies.items()}


def test_run_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in __spark_entry__.oracle_sql()
