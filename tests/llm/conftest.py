import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept boolean, `key` int, shard string, copies string, target string"


def make_docs(seed: int = 5, n: int = 60) -> list[tuple]:
    """Random documents with copies, near copies, ties, nulls, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = {"en": "the of and to house river stone walk under over light".split(), "de": "der die und nicht haus fluss stein gehen unter über licht".split()}
    texts: list[tuple] = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(vocabulary[lang]) + rng.choice(["", "", "s", "ed", "."]) for _ in range(rng.choice([1, 3, 15, 30, 120]))]
        texts.append((" ".join(words), lang))
    texts += [texts[3], texts[3], texts[7]]
    long_one = " ".join(rng.choice(vocabulary["en"]) for _ in range(5000))
    passage = " ".join(f"w{k}" for k in range(40))
    texts += [(long_one, "en"), (long_one + " tail", "en"), ("a " + passage + " b", "en"), ("c\n" + passage + "\td", "en"), ("x y " * 40, None)]
    texts += [(None, None), ("", "en"), (" \t\n", "en"), ("123 !?", None), ("Ünïcode　straße ß 日本語", "de"), ("same line here with words\n" * 30, "en")]
    rows = []
    for i, (text, lang) in enumerate(texts):
        rows.append((i, text, lang, rng.choice(["hot", "hot", "b", None]), None if text is None else len(text), "x", True, 1, "s", "c", "t"))
    rows.append(rows[5])  # a repeated row
    rows.append((None, "no id at all", "en", "b", 12, "x", True, 1, "s", "c", "t"))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
