"""Every dealt operator against brute force, on nulls, ties, repeats, long texts, clashing columns and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from segmill.llm import exact_dedup, language_id, licenses, mixing, packing, quality, secrets, sharding, simhash, substring_dedup
from segmill.llm.common import n_words_of, text_of


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def take(frame):
    return [r.asDict() for r in frame.collect()]


# 1


def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        got = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if got[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {**{s: cap * sizes[s] for s in capped}, **got}
        capped |= over


def test_mixing_near_targets_with_giants(spark):
    """Few documents hold most of a source's words, some of them alike; every source still comes near its target."""
    rng = random.Random(8)
    rows = [(i, f"s{i % 6}", int(rng.paretovariate(1.1) * 20)) for i in range(900)] + [(1000 + i % 2, "t", 5000) for i in range(90)] + [(2000 + i, "t", 40) for i in range(300)]
    found = take(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")))
    taken, sizes, most = Counter(), Counter(), {}
    for r in found:
        assert r["copies"] in (0, 1, 2)
        taken[r["source"]] += r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        most[r["source"]] = r["target"]
    assert {s: abs(taken[s] - most[s]) <= 0.03 * most[s] for s in sizes if s != "t"} == {f"s{k}": True for k in range(6)}
    assert abs(taken["t"] - most["t"]) <= 5000


def test_mixing(docs, rows):
    sized = docs.select("doc_id", "source", "target", "copies", n_words_of(text_of()).alias("size"))  # two names clash
    assert mixing.mix(sized).columns == ["doc_id", "source", "size", "source_size", "target", "copies"]
    found = take(mixing.mix(sized))
    assert sorted(map(str, found)) == sorted(map(str, take(mixing.mix(sized))))
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], len(words(r[1]))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = targets_by_hand(sizes)
    taken = Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(r["size"] for r in found if r["source"] == s)


def test_mixing_many_sources(spark):
    rng = random.Random(2)
    rows = [(i, f"s{i % 7}" if i % 9 else None, rng.randint(0, 50) * (1 + 20 * (i % 7 == 0))) for i in range(800)]
    found = take(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")))
    sizes, taken = Counter(), Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = targets_by_hand(sizes)
    for r in found:
        taken[r["source"]] += r["copies"] * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] for s in sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mixed_rows(docs, empty):
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in take(mixed))
    assert max(copies.values()) <= 4 and mixing.mixed_rows(empty).count() == 0


# 2


def test_sharding(docs, rows):
    found = take(sharding.assign_shards(docs, shards=5))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots, homes, held = defaultdict(list), defaultdict(set), Counter()
    for r in found:
        slots[r["shard"]].append(r["slot"])
        homes[r["size"], r["text_crc32"]].add(r["shard"])
        held[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values()) and set(held) <= set(range(5))


def test_shards_are_near_equal_beside_a_hot_text(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "hot " * 60 if i % 3 == 0 else " ".join(str(rng.random()) for _ in range(rng.randint(1, 9)))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = Counter()
    for r in take(sharding.assign_shards(docs, shards=6)):
        held[r["shard"]] += r["size"]
    rest = sorted(held.values())[:-1]
    assert len(held) == 6 and max(held.values()) == 1000 * 248 and max(rest) - min(rest) < 600
    sharding.write_shards(docs, str(tmp_path / "out"), shards=6, files=2)
    assert sorted(r["doc_id"] for r in take(spark.read.parquet(str(tmp_path / "out")))) == list(range(3000))


# 3

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark, docs, rows):
    rng = random.Random(4)
    pieces = ["password=", "Token : ", "api_key='", "AKIA", "ABCD0123456789ABCDEF", "abcdef0123456789abcdef01", "é", "𝄞 ", "secret=token:abcdefgh ", "apikey==x", "\n", "deadbeef", "word ", '"', "secret\":  \"a.b/c+d=="]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(300)] + [r[1] for r in rows]
    found = take(secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert len(found) == len(texts)
    for r in found:
        assert [(b["start"], b["kind"], b["end"]) for b in r["base"]] == base_spans(texts[r["doc_id"]])


def battery_by_hand(token):
    """kind, n, chi2, z_runs, z_serial, p of a token; None for too few symbols."""
    x = token.lower() if re.fullmatch("[0-9A-F]+", token) else token
    x = x.replace("-", "+").replace("_", "/").replace("=", "")
    n = len(x)
    if n < 16:
        return None
    kind = 0 if re.fullmatch("[0-9a-f]+", x) else 1 if re.fullmatch("[A-Z2-7]+", x) else 2
    alphabet = list(secrets.ENCODINGS.values())[kind][0]
    k, v = len(alphabet), np.array([alphabet.index(c) + 1 for c in x], float)
    chi2 = sum((v == i + 1).sum() ** 2 for i in range(k)) * k / n - n
    high = v > k / 2
    turns, mean = 2 * high.sum() * (n - high.sum()) / n, v.mean()
    z_runs = 99.0 if turns <= 1 else ((high[1:] != high[:-1]).sum() - turns) / math.sqrt(turns * (turns - 1) / (n - 1))
    spread = ((v - mean) ** 2).sum()
    z_serial = 99.0 if spread < 1e-9 else (((v[1:] - mean) * (v[:-1] - mean)).sum() / spread + 1 / n) * math.sqrt(n)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    least = min(tail((chi2 - k + 1) / math.sqrt(2 * (k - 1) * (n - 1) / n)), 2 * tail(abs(z_runs)), 2 * tail(abs(z_serial)))
    return kind, n, chi2, z_runs, z_serial, 1 - (1 - least) ** 3


def blanked(text):
    for pattern, enough in ((ASSIGN, lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]{16,}"), bool), (re.compile("[0-9a-f]{24,}"), bool)):
        text = pattern.sub(lambda m: " " * len(m[0]) if enough(m) else m[0], text)  # noqa: B023
    return text


def bins_by_hand(spark, docs):
    """(doc_id, start, end): (class, bin) from the nominal p of tested(), the edges of its cells and the hash of ties."""
    found = secrets.tested(docs)
    edges = take(found.select(secrets.edges_of(found).alias("e")).limit(1))[0]["e"]
    lengths, out = secrets.lengths_of_cells(), {}
    for r in take(found):
        for x in r["tests"]:
            h = 42
            for v, width in ((r["doc_id"], 8), (x["start"], 4), (x["end"], 4)):
                h = xxhash.xxh64_intdigest(v.to_bytes(width, "little"), h)
            at = round(x["p"], 9) + h % (1 << 20) * (1e-9 / (1 << 20))
            cell = x["kind"] * len(lengths) + max(i for i, n in enumerate(lengths) if n <= x["n"])
            out[r["doc_id"], x["start"], x["end"]] = (x["kind"], sum(x["n"] >= n for n in secrets.LENGTHS[1:])), sum(e < at for e in edges[cell])
    return out


def random_spans_by_hand(spark, docs, rate=secrets.RATE):
    """The bound of each class, and what passes it."""
    found = bins_by_hand(spark, docs)
    bound = {}
    for c in {c for c, _ in found.values()}:
        own = [b for k, b in found.values() if k == c]
        random_ones = 2 * sum(b >= secrets.BINS // 2 for b in own)
        for b in sorted(set(own), reverse=True):
            above = sum(x >= b for x in own)
            if random_ones and above - random_ones * (1 - b / secrets.BINS) <= rate * above:
                bound[c] = b
    return {at for at, (c, b) in found.items() if b >= bound.get(c, secrets.BINS)}


@pytest.mark.parametrize(("kind", "n"), [(0, 20), (0, 24), (0, 40), (1, 20), (1, 33), (2, 20), (2, 24), (2, 40), (2, 100), (1, 300), (0, 700)])
def test_ranks_of_random_tokens_are_even(spark, kind, n):
    """Drawn by another generator, so that the hash's draws are tested, too."""
    alphabet, many = list(secrets.ENCODINGS.values())[kind][0], 3000
    draws = np.random.default_rng([kind, n]).integers(0, len(alphabet), (many, n))
    texts = ["".join(alphabet[c] for c in row) for row in draws]
    tokens = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").select("doc_id", secrets.battery(F.array(F.struct(F.lit(0).alias("start"), F.lit(n).alias("end"), F.col("t").alias("found")))).alias("tests"))
    bins = np.array([r["bin"] for r in take(secrets.ranked(tokens).select(F.col("tests")[0]["bin"].alias("bin")))])
    for share in (0.02, 0.1, 0.25, 0.5, 0.75, 0.9):
        off = abs((bins < share * secrets.BINS).mean() - share) / math.sqrt(share * (1 - share) * (1 / many + 1 / secrets.DRAWS))
        assert off < 3.7, (share, off)


# Others that rank above a half (27 of 3,600 here) are taken for random ones; where those are few, that shows.
@pytest.mark.parametrize("share", [pytest.param(0.1, marks=pytest.mark.xfail(reason="37 of 238 reported are others", strict=True)), 0.5, 0.9])
def test_share_of_others_among_reported(spark, share):
    """Words joined to tokens beside random ones, at several shares: the reported others stay within the rate."""
    rng, many = random.Random(int(share * 10)), 4000
    alphabet, syllables = secrets.ENCODINGS["base64"][0], ["get", "User", "Name", "By", "Id", "order", "Table", "sum", "Of", "all", "The", "index", "2024", "Key", "list", "Value", "is", "Not", "Null", "Map"]
    made = [(True, "".join(rng.choice(alphabet) for _ in range(24))) if rng.random() < share else (False, "".join(rng.choice(syllables) for _ in range(12))[:24]) for _ in range(many)]
    found = take(secrets.find_secrets(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(made)], "doc_id long, text string")))
    hits = [made[r["doc_id"]][0] for r in found if r["random"]]
    assert hits.count(False) <= secrets.RATE * len(hits) + 3 * math.sqrt(secrets.RATE * max(len(hits), 1))
    if share >= 0.5:
        assert hits.count(True) >= 0.8 * sum(r for r, _ in made)


def token_texts(rng):
    alphabets = ["0123456789abcdef"[:16].upper(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz"]
    keys = ["key " + "".join(rng.choice(a) for _ in range(n)) + " end" for a in alphabets[:3] for n in (20, 24, 32, 40, 64, 100) for _ in range(40)]
    plain = [f"see user_name_id_{i}_of_table_orders_{i * 3} there" for i in range(60)] + ["the-quick-brown-fox-jumps-2024-over", "é ThisIsACamelCaseIdentifierOfSomeKind", "internationalization/of/all/the/documents"] * 20
    return keys, plain + ["1" * 50, "abababababababababab1212121212", "ab12" * 9, "x" * 25 + "==", "=" * 30, "AKIA" + "Q7" * 9 + " token=" + "Zq3" * 9]


def test_random_spans_equal_brute_force(spark):
    rng = random.Random(3)
    keys, plain = token_texts(rng)
    texts = keys + plain + [None, "", " ".join(rng.sample(keys + plain, 300)) + " \U0001d11e " + " ".join(rng.sample(keys, 100))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tests = [(i, m.start(), m.end(), found) for i, t in enumerate(texts) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", blanked(t or "")) if (found := battery_by_hand(m[0]))]
    want = random_spans_by_hand(spark, docs)
    got = {(r["doc_id"], x["start"], x["end"]): tuple(x)[2:] for r in take(secrets.tested(docs)) for x in r["tests"]}
    assert set(got) == {t[:3] for t in tests}
    for i, a, z, f in tests:
        assert got[i, a, z] == pytest.approx(f, rel=1e-6, abs=1e-5)
    assert {(r["doc_id"], x["start"], x["end"]) for r in take(secrets.find_secrets(docs)) for x in r["random"]} == want


def test_random_tokens_are_told_from_words(spark):
    keys, plain = token_texts(random.Random(5))
    found = take(secrets.find_secrets(spark.createDataFrame(list(enumerate(keys + plain)), "doc_id long, text string")))
    hits = {r["doc_id"] for r in found if r["random"]}
    per_length = [len(hits & set(range(i, i + 40))) for i in range(0, len(keys), 40)]
    assert min(per_length) >= 20 and sum(per_length) >= 0.85 * len(keys)
    assert len([i for i in hits if i >= len(keys)]) <= 0.05 * len(hits)


def test_one_long_word_and_many_matches(spark):
    long_ones = ["z" * 500_000, "xY9" * 150_000, "token=abcdef " * 20_000]
    found = {r["doc_id"]: r for r in take(secrets.find_secrets(spark.createDataFrame(list(enumerate(long_ones)), "doc_id long, text string")))}
    assert not found[0]["base"] and not found[0]["random"] and not found[1]["random"]
    assert [(b["start"], b["end"]) for b in found[2]["base"]] == [(13 * i, 13 * i + 12) for i in range(20_000)]


def test_the_query_writes_spans(spark, tmp_path):
    rng = random.Random(6)
    keys, plain = token_texts(rng)
    texts = keys + plain + ["secret: abcdefgh, 0123456789abcdef01234567", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    random_ones = random_spans_by_hand(spark, docs)
    for r in take(secrets.op3_secret_scans(spark, str(tmp_path))):
        base = base_spans(texts[r["doc_id"]])
        write = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert r["base_sha256"] == hashlib.sha256(write(base).encode()).hexdigest()
        assert r["spans"] == write(base + [(a, 3, z) for i, a, z in random_ones if i == r["doc_id"]])


# 4


def repeats_by_hand(rows, window=20):
    order = lambda d: (d is not None, d or 0)
    first = {}
    for d, w in rows:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, ((2, 0), 0)), (order(d), i))
    found = []
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (order(d), i):
                gone[i : i + window] = [True] * window
        found.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return found


def repeats(docs, **options):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in take(substring_dedup.without_repeats(docs, **options)))


#: Plain; every group with its prefix lengthened and searched in pieces; and with hashes of few bits, which only words can tell apart.
TREES = [{}, {"group": 2}, {"key_bits": 7}, {"key_bits": 5, "group": 3}]


@pytest.mark.parametrize("options", TREES)
def test_substring_dedup(docs, rows, options):
    assert repeats(docs, **options) == Counter(repeats_by_hand([(r[0], words(r[1])) for r in rows]))


@pytest.mark.parametrize("options", TREES)
def test_substring_dedup_random(spark, options):
    rng = random.Random(9)
    base = [rng.choice("abcdefgh") for _ in range(400)]
    rows = []
    for i in range(80):
        a = rng.randint(0, 340)
        w = base[a : a + rng.randint(5, 60)] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        if i % 7 == 0:
            w = ["z"] * rng.randint(10, 90) + w
        rows.append((i, w))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(5)
    assert repeats(docs, **options) == Counter(repeats_by_hand(rows))


def test_frequent_phrases_with_other_neighbours(spark):
    """One anchor in every document, more often than OFTEN in a chunk, and some whole passages."""
    rng = random.Random(10)
    word = lambda: f"v{rng.randrange(10**6)}"
    phrase, passages = "in the event of any such".split(), [[word() for _ in range(30)] for _ in range(3)]
    rows = []
    for i in range(300):
        w = [word() for _ in range(rng.randint(5, 25))] + phrase + [word() for _ in range(rng.randint(5, 25))]
        rows.append((i, w + rng.choice(passages) if i % 4 == 0 else w))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3)
    assert repeats(docs) == Counter(repeats_by_hand(rows))


def test_tree_nodes_are_classes_of_equal_prefixes():
    rng = np.random.default_rng(3)
    for depth in (1, 2, 3, 5, 7, 20):
        flat = rng.integers(0, 2, 300)
        nodes = substring_dedup.tree_nodes(flat, depth).tolist()
        own = [tuple(flat[i : i + depth]) for i in range(len(flat) - depth + 1)]
        assert len(nodes) == len(own) and len(set(zip(nodes, own))) == len(set(nodes)) == len(set(own))


# 5


def phrases_by_hand(trained, codes):
    n = i = 0
    while i < len(codes):
        j = i + 1
        while j < len(codes) and codes[i : j + 1] in trained:
            j += 1
        n, i = n + 1, j
    return n


def test_cross_parsing_counts_longest_matches(monkeypatch):
    texts = {"a": b"the cat sat on the mat and the hat", "b": "der hund und die kätze auf dem dach".encode()}
    model = language_id.Model(texts)
    rng = random.Random(1)
    tries = ["".join(rng.choice("thecadru nxyzä7 ") for _ in range(rng.choice([0, 5, 60, 3000]))) for _ in range(200)]
    for few in (2, language_id.FEW, 1000):  # walks together, both ways, one by one
        monkeypatch.setattr(language_id, "FEW", few)
        counts, strange = model.phrases(tries)
        for t, c, odd in zip(tries, counts.tolist(), strange.tolist(), strict=True):
            assert c == [phrases_by_hand(texts[k], language_id.plain(t)) for k in "ab"]
            assert odd == [sum(b not in texts[k] for b in language_id.plain(t)) for k in "ab"]


def test_scripts_and_rare_labels(spark):
    """Every script counts, and a label with next to no text takes nothing from the others."""
    rng = random.Random(2)
    letters = {"el": "αβγδεζηθικλμνξοπ", "ru": "абвгдежзиклмнопр", "zh": "".join(map(chr, range(0x4E00, 0x4F40))), "xx": "".join(map(chr, range(0x30000, 0x30040))), "en": "etaoinshrdlu", "fi": "aitneslokuäm"}
    vocabulary = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(150)] for k, a in letters.items()}
    make = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    rows = [(i, make(k, 80), k) for i, k in enumerate(sorted(letters) * 12)] + [(900, "eta", "rare"), (901, "x", "xx"), (902, "", "rare")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted([*letters, "rare"])
    asked = [(i, make(k, n), k) for i, (k, n) in enumerate((k, n) for k in letters for n in (3, 10, 40) for _ in range(10))]
    found = {r["doc_id"]: r for r in take(language_id.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model))}
    right = [found[i]["lang_pred"] == k for i, _, k in asked]
    assert np.mean(right) > 0.97 and all(ok for ok, (_, t, _) in zip(right, asked, strict=True) if len(t) > 200)


def test_ties_go_to_the_first_language(spark):
    model = language_id.Model({"b": b"same text", "a": b"same text"})
    (row,) = take(language_id.identify(spark.createDataFrame([(1, "same same")], "doc_id long, text string"), model))
    assert (row["lang_pred"], row["score"]) == ("a", 0.0)


def test_language_query(spark, tmp_path):
    """Held-out accuracy of the query itself; labels of the held-out fold are never learned."""
    rng = random.Random(7)
    vocabulary = {k: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(200)] for k in ("aa", "bb", "cc")}
    rows = [(i, " ".join(rng.choice(vocabulary[k]) for _ in range(rng.randint(5, 60))), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)] + [(999, None, "aa"), (1000, "12 34", None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [(i, t, "wrong" if held(i) and i % 2 else k) for i, t, k in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in take(language_id.op5_language_id(spark, str(tmp_path)))}
    assert {i: r["held_out"] for i, r in found.items()} == {i: held(i) for i, *_ in rows}
    assert "wrong" not in {r["lang_pred"] for r in found.values()}
    assert found[999]["lang_pred"] == found[1000]["lang_pred"] == "und" and found[999]["score"] == 0
    truth = {i: ["aa", "bb", "cc"][i % 3] for i in range(180)}
    assert np.mean([found[i]["lang_pred"] == truth[i] for i in truth if held(i)]) > 0.98


def test_language_id(spark, docs, rows, empty):
    model = language_id.train(docs)
    found = take(language_id.identify(docs, model))
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    by_id = {r[0]: r for r in rows}
    for r in found:
        text = by_id[r["doc_id"]][1]
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    scored = [r["lang_pred"] == by_id[r["doc_id"]][2] for r in found if by_id[r["doc_id"]][2] and len(words(by_id[r["doc_id"]][1])) >= 15]
    assert np.mean(scored) > 0.9
    assert language_id.train(empty) is None and take(language_id.identify(docs.limit(1), None))[0]["lang_pred"] == "und"
    assert take(language_id.identify(empty, model)) == []


# 6


def print_by_hand(text, size=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints):
    group = {p: p for p in prints}

    def root(p):
        while group[p] != p:
            p = group[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                group[root(a)] = root(b)
    return {p: root(p) for p in prints}


def test_simhash(docs, rows):
    found = take(simhash.near_duplicates(docs))
    hand = {(r[0], r[1]): print_by_hand(r[1]) for r in rows}
    root = components_by_hand(set(hand.values()))
    least = {}
    for (d, _), p in hand.items():
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    want = Counter((r[0], f"{hand[r[0], r[1]]:016x}", least.get(root[hand[r[0], r[1]]])) for r in rows)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == want


@pytest.mark.parametrize("options", [{}, {"crowd": 1}, {"crowd": 2, "max_bits": 1}, {"crowd": 1, "max_bits": 3}, {"max_bits": 3}])
def test_print_links_are_all_pairs(spark, options):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for _ in range(4):
            q = p
            for _ in range(rng.randint(1, 3)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = {(r["a"] % 2**64, r["b"] % 2**64) for r in take(simhash.print_links(spark.createDataFrame([(p,) for p in signed], "print long"), **options))}
    assert {tuple(sorted(x)) for x in links} == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= options.get("max_bits", 2)}


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103)]
    random.Random(1).shuffle(chain)
    found = {r["node"]: r["root"] for r in take(simhash.components(spark.createDataFrame(chain, "a long, b long")))}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}


def test_near_copies_are_dropped(spark, docs, empty):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(12)]
    rows = []
    for k, w in enumerate(base):
        for c in range(4 if k < 6 else 1):
            v = list(w)
            for at in rng.sample(range(300), 2 * c):
                v[at] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(v), "en", "s", 0))
    kept = take(simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")))
    assert sorted(r["doc_id"] for r in kept) == [0, 4, 8, 12, 16, 20, 24, 25, 26, 27, 28, 29]
    assert simhash.drop_near_copies(docs).columns == docs.columns and simhash.drop_near_copies(empty).count() == 0


def test_near_copies_are_found_for_every_kind_of_edit(spark):
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for k in range(90):
        w = [word() for _ in range(rng.randint(40, 200))]
        n = round(len(w) * rng.uniform(0.08, 0.24))
        edited = [w + [word() for _ in range(n)], w[: len(w) - n], w[:9] + [word() for _ in range(n // 2)] + w[9 + n // 2 :]][k % 3]
        texts += [" ".join(w), " ".join(edited)]
    passage = [word() for _ in range(100)]
    for _ in range(40):  # one crowded passage, at and below the threshold
        texts.append(" ".join(passage + [word() for _ in range(rng.randint(8, 16))]))
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in map(str.split, texts)]
    group = list(range(len(texts)))
    find = lambda x: x if group[x] == x else find(group[x])
    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                pairs += 1
                group[max(find(i), find(j))] = min(find(i), find(j))
    assert pairs > 60
    kept = take(simhash.drop_near_copies(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")))
    assert sorted(r["doc_id"] for r in kept) == sorted({find(i) for i in range(len(texts))})


def test_parity_maps_differ_in_no_more_bits_than_sets(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 900, 5000):
        one, two = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for _ in range(2))
        two = np.unique(np.concatenate([one[: n // 2], two[n // 2 :]]))
        maps = simhash.parity_map(one), simhash.parity_map(two)
        assert len(maps[0]) * 64 == simhash.MAP_BITS
        assert sum((int(x) ^ int(y)).bit_count() for x, y in zip(*(m.view(np.uint64) for m in maps), strict=True)) <= len(np.setxor1d(one, two))


def test_pairs_of_a_hot_group_are_few_and_none_is_lost(spark, monkeypatch):
    rng = random.Random(17)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(240):  # copies of one text, most of them similar to a part of the others only
        w = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4, 5, 6, 7])):
            w[at] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in map(str.split, texts)]
    group = list(range(len(texts)))
    find = lambda x: x if group[x] == x else find(group[x])
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                group[max(find(i), find(j))] = min(find(i), find(j))
    stay = sorted({find(i) for i in range(len(texts))})
    assert len(stay) > 20
    counts, table = {}, simhash.shared_table

    def counted(df, name, *args):
        made = table(df, name, *args)
        if name.startswith(("similar-pairs", "similar-links")):
            counts[name] = made.count()
        return made

    monkeypatch.setattr(simhash, "shared_table", counted)
    kept = take(simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert sorted(r["doc_id"] for r in kept) == stay
    assert sum(n for name, n in counts.items() if "pairs" in name) < 8 * len(texts) and sum(n for name, n in counts.items() if "links" in name) < 2 * len(texts), counts


# 7


def exact_by_hand(rows):
    groups = defaultdict(list)
    for d, text, *_ in rows:
        groups[text or ""].append(d)
    want = Counter()
    for text, ids in groups.items():
        keep, first = max((i for i in ids if i is not None), default=None), True
        for d in ids:
            kept = d == keep and first
            first = first and not kept
            want[d, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()] += 1
    return want


def exact_rows(frame):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in take(frame))


@pytest.mark.parametrize("options", [{}, {"capacity": 2000}, {"capacity": 300, "key_bits": 2}, {"key_bits": 9}])
def test_exact_dedup(docs, rows, options):
    """Small capacities make pages, few key bits make chains of different texts under one key."""
    assert exact_rows(exact_dedup.exact_groups(docs, **options)) == exact_by_hand(rows)
    left = take(exact_dedup.drop_copies(docs, **options))
    assert sorted((r["text"] or "") for r in left) == sorted({r[1] or "" for r in rows})


def test_exact_dedup_of_hot_texts_and_tied_nulls(spark):
    rows = [(i, "hot " * 20 if i % 3 else f"own {i}") for i in range(3000)] + [(5, None), (5, ""), (7, "own 0"), (7, "own 0"), (None, "own 3"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert exact_rows(exact_dedup.exact_groups(docs, capacity=4000)) == exact_by_hand(rows)
    assert Counter(r["text"] or "" for r in take(exact_dedup.drop_copies(docs, capacity=4000))) == Counter({t or "" for _, t in rows})


def test_results_come_from_the_directory(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(200)], "doc_id long, text string")
    whole = exact_dedup.build_directory
    monkeypatch.setattr(exact_dedup, "build_directory", lambda *a: whole(*a).filter("prefix % 2 = 0"))
    assert 0 < exact_dedup.exact_groups(docs).count() < 200


def test_directory_covers_all_keys_once(spark):
    entries = spark.range(20_000).selectExpr("xxhash64(id) AS __key", "100L AS __bytes").unionAll(spark.range(900).selectExpr("77L AS __key", "100L AS __bytes"))
    directory = take(exact_dedup.build_directory(entries, 4_000))
    assert sum(r["n_bytes"] for r in directory) == 2_090_000
    for r in directory:
        assert r["n_bytes"] <= 4_000 or r["n_bytes"] >= 90_000
        assert r["pages"] == max(1, math.ceil(r["n_bytes"] / 4_000))
    assert sum(2.0 ** -r["depth"] for r in directory) <= 1


# 8


def test_quality(spark, docs, rows):
    found = take(quality.judge(docs))
    assert len(found) == len(rows)
    by_id = {r[0]: r for r in rows}
    for r in found:
        text = by_id[r["doc_id"]][1] or ""
        w = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert sorted(str(r["doc_id"]) for r in take(quality.passing(docs))) == sorted(str(r["doc_id"]) for r in found if r["kept"])


def test_common_lines_deplete(spark):
    rng = random.Random(2)
    line = "subscribe to our newsletter and accept all cookies before you go on reading here today"
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(n))
    rows = [(i, f"{line.upper() if i % 2 else line}\n{own(40)}", "h") for i in range(40)] + [(100, f"{line}!\n{own(8)}", "h"), (101, f"{line}\n{own(30)}", "other")]
    rows += [(200 + i, own(30), "h") for i in range(100)] + [(400 + i, "copy\n" + " ".join(chr(97 + k % 26) * 3 for k in range(30)), "h") for i in range(60)] + [(600, "copy\n" * 30 + own(40), "h"), (601, "copy\n" * 30 + own(40), "third")]
    found = {r["doc_id"]: r for r in take(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")))}
    assert found[0]["n_boilerplate_words"] == found[1]["n_boilerplate_words"] == 15 and found[0]["kept"]
    assert not found[100]["kept"] and not found[100]["base_failed"]
    assert found[101]["n_boilerplate_words"] == 0 and found[601]["n_boilerplate_words"] == 0
    assert found[600]["n_boilerplate_words"] == 30  # copies are documents of their own
    assert found[400]["n_boilerplate_words"] == 31 and not found[400]["kept"]


def test_lines_repeated_in_a_document_lose_all_their_words(spark):
    own = lambda i, n: "\n".join(f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 2}{chr(97 + k % 26)}{chr(97 + k // 26)} own" for k in range(n))
    often = own(60, 120).replace("\n", "\nReply Share Report\n") + "\nReply Share Report"
    rows = [(i, own(i, 30) + "\n\nReply, share report", "h", 0) for i in range(40)] + [(100, often, "h", 0), (101, often, "other", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    found = {r["doc_id"]: r for r in take(quality.judge(docs))}
    assert found[100]["n_words"] == 600 and found[100]["n_boilerplate_words"] == 360
    assert not found[100]["base_failed"] and not found[100]["kept"] and found[101]["kept"]
    left = {r["doc_id"]: r for r in take(quality.passing(docs))}
    assert sorted(left) == [*range(40), 101] and left[101]["text"] == often
    assert all(left[i]["text"] == own(i, 30) + "\n" and left[i]["n_chars"] == len(left[i]["text"]) for i in range(40))


# 9


def test_hilbert_keys_visit_neighbours():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = packing.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert set(np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1).tolist()) == {1}


def test_word_encoder_equals_the_tokenizer(monkeypatch):
    encoder = packing.WordEncoder(packing.tokenizer_path())
    texts = ["a<|endoftext|>b", "ΑΣ ΑΣ. don't It's  ..x,y \"q\" 3a5b é́ É", "　 x y", "İstanbul ǅ ﬁ ﬁ.", "<|ENDOFTEXT|>", "Å Å. á. x̸ ≮", "ß. ẞ!", "word, word. Word!? 12a", ""]
    texts += [f"w{k}x, word{chr(97 + k % 26)}{chr(97 + k // 26)}. ({k}) .,; ..." for k in range(300)]
    for cap in (50, packing.CACHE_WORDS):
        monkeypatch.setattr(packing, "CACHE_WORDS", cap)
        for t, found in zip(texts * 2, encoder.encode_all(texts * 2), strict=True):
            assert np.frombuffer(found, "<u2").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(docs, rows):
    found = take(packing.pack(docs))
    encoder = packing.WordEncoder(packing.tokenizer_path())
    ids = {(r[0], len(x)): x for r in rows for x in [encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]]}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in found:
        pieces[p["doc_id"], p["doc_tokens"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        part = np.array(ids[p["doc_id"], p["doc_tokens"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == p["ids_crc32"]
    repeats = Counter((r[0]) for r in rows)
    for (d, n), own in pieces.items():
        assert sorted(k for p in own for k in range(p["start"], p["start"] + p["length"])) == sorted(list(range(n)) * repeats[d])
    assert set(pieces) == set(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_ranges_hold_equal_bytes(spark):
    """However the rows lie on the curve: a third on one point, and some very long ones."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(i, bytes(2 * n), n, 7 if i % 3 == 0 else rng.randrange(1 << 40)) for i in range(6000) for n in [2000 if i % 500 == 0 else rng.randint(1, 100)]]
    laid = packing.ranged(spark.createDataFrame(rows, "doc_id long, ids binary, n long, curve long"), 20_000)
    found = laid.withColumn("p", F.spark_partition_id()).collect()
    held, spans = Counter(), defaultdict(list)
    for r in found:
        held[r["p"]] += 2 * r["n"]
        spans[r["p"]].append(r["curve"])
    assert sorted(r["doc_id"] for r in found) == list(range(6000))
    assert max(held.values()) < 20_000 + 12_000 and len(held) > 25
    assert all(s == sorted(s) for s in spans.values())
    assert all(max(spans[p]) <= min(spans[p + 1]) + (1 << 25) for p in sorted(held)[:-1] if p + 1 in held)  # a cell may be shared


# 10


def test_licences(docs, rows):
    found = take(licenses.scan(docs))
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)


def test_licence_phrases_and_expressions(spark):
    rng = random.Random(5)
    pieces = ["MIT", "license", " ", "-", "apache", "Apache License", "the gnu general public", " license ", "é", "mit license ", "all rights reserved. "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    found = {r["doc_id"]: r for r in take(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}


@pytest.mark.parametrize(
    ("text", "labels", "permissive", "whole"),
    [
        ("MIT", "mit", True, True),
        ("MIT OR GPL-2.0-only", "gpl,mit", True, True),
        ("MIT AND GPL-2.0+ ", "gpl,mit", False, True),
        ("(GPL-3.0-or-later WITH Classpath-exception-2.0 OR MIT) AND Apache-2.0", "apache,gpl,mit", True, True),
        ("GPL-2.0 or MIT and Apache-2.0", "apache,gpl,mit", True, True),
        ("MIT AND (GPL-2.0", "gpl,mit", False, False),
        ("MIT OR", "mit", True, False),
    ],
)
def test_expressions(text, labels, permissive, whole):
    postfix, complete = licenses.parse(text)
    named, ok = licenses.evaluate(postfix)
    assert (",".join(sorted(named)), ok, complete) == (labels, permissive, whole)


def test_tagged_expression():
    found = licenses.scan_text("// SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode", licenses.automaton())
    assert found[5] == "apache,mit" and found[8] is True and math.isclose(found[6], 1 - 0.5**4)


# all


@pytest.mark.parametrize(
    "operator",
    [
        sharding.assign_shards, secrets.find_secrets, substring_dedup.without_repeats, simhash.near_duplicates, exact_dedup.exact_groups, exact_dedup.drop_copies, quality.judge, quality.passing, packing.pack, licenses.scan,
    ],
)
def test_empty_tables(operator, empty):
    assert operator(empty).count() == 0


def test_mix_of_nothing(empty):
    assert mixing.mix(empty.select("doc_id", "source", n_words_of(text_of()).alias("size"))).count() == 0
