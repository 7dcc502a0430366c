import pytest
from pyspark.sql import functions as F

from segmill.functions import text as tx
from segmill.functions import tokens as tk


def latin(text, **options):
    return [text[a:b] for a, b in tk.latin_ranges(text, **options)]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("", []),
        (" \t", []),
        ("We left early, too.", "We|left|early|,|too|."),
        ("Is it so? (no)", "Is|it|so|?|(|no|)"),
        ("It isn't 7,500.", "It|isn't|7,500|."),
        ("He paid $50.", "He|paid|$|50|."),
        ("Write to jane@site.org, now", "Write|to|jane@site.org|,|now"),
        ("See https://site.org/a.html?b=1, then", "See|https://site.org/a.html?b=1|,|then"),
        ("either/or <<here>>", "either|/|or|<<|here|>>"),
        ("the dogs' 'cause", "the|dogs'|'cause"),
        ("a.-b", "a|.|-b"),
        ("wait...", "wait|.|.."),
        ("don't ''", "don't|''"),
    ],
)
def test_latin_words(text, tokens):
    assert latin(text) == (tokens.split("|") if tokens else [])


def test_latin_options():
    assert latin("Dr. Who left.", abbreviations=frozenset({"dr"})) == ["Dr.", "Who", "left", "."]
    assert latin("'Tom's' 'x'", apostrophe_is_quote=True) == ["'", "Tom's", "'", "'", "x", "'"]


def test_sentences():
    text = "One here. Two (is it?) goes on. Three!\nfour stays"
    assert [text[a:b] for a, b in tk.sentence_ranges(text)] == ["One here.", "Two (is it?) goes on.", "Three!", "four stays"]


def test_detokenizers():
    assert tk.latin_join(["He", ",", "said", '"', "Hi", '"', "$", "5", "(", "a", ")", "and", "/", "or", "."]) == 'He, said "Hi" $5 (a) and/or.'
    assert tk.zwsp_join(["a", "b", " ", "c"]) == "a​b c"
    assert [t for t in tk.zwsp_join(["a", "(", "b", ")", "c"])] == list("a (b) c")


def test_native_tokenizers(spark):
    df = spark.createDataFrame([("a  b​c　d",), ("",), ("x\r\ny\n\nz\r",)], "s string")
    found = df.select(tk.whitespace(F.col("s")).alias("w"), tk.lines(F.col("s")).alias("l"), tk.null_tokens(F.col("s")).alias("n")).collect()
    assert found[0].w == ["a", "b", "c", "d"] and found[1].w == [] and found[1].l == [] and found[1].n == []
    assert found[2].l == ["x", "y", "", "z"]
    ranges = spark.createDataFrame([("aab b", ["aa", "b", "b"]), ("ab", ["b", "a"])], "s string, t array<string>").select(tk.token_ranges(F.col("s"), F.col("t")).alias("r")).collect()
    assert [(x.start, x.end) for x in ranges[0].r] == [(0, 2), (2, 3), (4, 5)] and ranges[1].r is None


def test_predicates(spark):
    df = spark.createDataFrame([("Yes.”)",), ("No",), ("?!",), ("",), (" 1_000 ",), ("1.5e3",)], "s string")
    s = F.col("s")
    found = df.select(tx.has_sentence_ending(s), tx.is_sentence_terminal(s), tx.parse_integer(s), tx.parse_float(s)).collect()
    assert [tuple(r) for r in found] == [(True, False, None, None), (False, False, None, None), (True, True, None, None), (False, False, None, None), (False, False, 1000, 1000.0), (False, False, None, 1500.0)]


def test_log_space(spark):
    a, b = F.lit(0.5), F.lit(0.25)
    row = spark.range(1).select(tx.from_log(tx.log_add(tx.to_log(a), tx.to_log(b))), tx.from_log(tx.log_add(tx.to_log(F.lit(0.0)), tx.to_log(b))), tx.from_log(tx.log_multiply(tx.to_log(a), tx.to_log(F.lit(0.0))))).first()
    assert row[0] == pytest.approx(0.75) and row[1] == pytest.approx(0.25) and row[2] == 0


def test_plain_texts_are_cut_as_others_are(spark):
    """The JVM's cut of plain texts equals the scanner's, which all others get."""
    import random

    rng = random.Random(4)
    pieces = ["word", "Über", "3", "3.14", ".", ",", "!", "?", ";", ":", " ", " ", " ", "\t", "\u200b", "'", "\"", "(", "-", "www.", "http://a.b/c", "don't", "...", "\n", "ß", "\u00d7", "日本"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(600)] + [" ".join(rng.choice(["word", "Über", "x1"]) + rng.choice(["", ".", ",", "!"]) for _ in range(8)) for _ in range(100)]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", "text", tk.latin()(F.col("text")).alias("tokens")).collect()
    for r in found:
        assert r.tokens == [r.text[a:b] for a, b in tk.latin_ranges(r.text)], r.text


def test_ranges_of_long_texts_and_odd_tokens(spark):
    words = [f"w{k % 7}\u00e9\U0001f600" for k in range(60_000)]
    rows = [(" ".join(words), words), ("ab", ["a", "", "b"]), (None, ["a"]), ("a", None), ("a", []), ("ab", ["b", "a"])]
    df = spark.createDataFrame(rows, "s string, t array<string>").withColumn("r", tk.token_ranges(F.col("s"), F.col("t")))
    long, *odd = df.select("r", tk.split_by_ranges(F.col("s"), F.col("r")).alias("p")).collect()
    assert long.p == words and long.r[-1].end == len(rows[0][0])
    assert [x.p for x in odd] == [["a", "", "b"], None, None, [], None]
