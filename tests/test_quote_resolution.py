"""Resolving quotation marks, chapter by chapter."""

import random

import pytest

from segmill.operators import quote_resolution as qr
from segmill.operators import quotes as qu

SEGMENTS = "chapter int, ord long, verse string, paragraph boolean, embedded boolean, text string"


def table(spark, chapters):
    """Chapters are lists of (text, starts a paragraph), each a verse."""
    return spark.createDataFrame([(c, i, str(i + 1), p, True, t) for c, rows in enumerate(chapters) for i, (t, p) in enumerate(rows)], SEGMENTS)


def resolved(spark, texts, names, paragraphs=True, singly=False):
    rows, own = table(spark, texts), qr.Conventions(names)
    marks = qr.placed_marks(rows, own, "chapter")
    found = qr.resolve_singly(marks, own, "chapter") if singly else qr.resolve(marks, own, "chapter", paragraphs=paragraphs)
    return {r["chapter"]: (" ".join(f"{m['mark']}{m['depth']}{m['direction'][0]}" for m in r["found"]), r["issues"]) for r in found.collect()}


def test_depths_and_issues(spark):
    chapters = [
        [("He said, “Go ‘now and “see ‘all’”’.”", True)],
        [("“It is Moses’ staff, don’t touch”", True)],
        [("“One begins", True), ("“and goes on” here", True)],
        [("“One ‘two begins", True), ("“‘and goes on’ here”", True)],
        [("“never ends", True)],
        [("no start” here", True)],
        [("“a ‘b “c ‘d “e", True)],
        [("‘wrong level’ “right”", True)],
        [("word“word", True)],
    ]
    got = resolved(spark, chapters, ["standard_english"])
    assert got[0] == ("“1o ‘2o “3o ‘4o ’4c ”3c ’2c ”1c", [])
    assert got[1] == ("“1o ”1c", [])
    assert got[2] == ("“1o “1o ”1c", [])
    assert got[3] == ("“1o ‘2o “1o ‘2o ’2c ”1c", [])
    assert got[4] == ("“1o", ["unpaired"]) and got[5] == ("", ["unpaired"])
    assert got[6][1] == ["too_deep", "unpaired"]
    assert got[7][1] == ["incompatible"] and got[8] == ("“1o", ["unpaired"])


def test_marks_that_open_and_close(spark):
    chapters = [[('He said, "Go \'now\'." Then "stop"', True)], [('a " b', True), ('"x"', True)], [('word"word', True)]]
    got = resolved(spark, chapters, ["typewriter_english"])
    assert got[0] == ("\"1o '2o '2c \"1c \"1o \"1c", [])
    assert got[2] == ("", ["ambiguous"])


def test_spanish_continuers(spark):
    chapters = [[("«Uno empieza", True), ("»y sigue» fin", True)]]
    assert resolved(spark, chapters, ["standard_french"])[0] == ("«1o »1o »1c", [])
    assert resolved(spark, [[("«Uno", True), ("»no sigue", False)]], ["standard_french"])[0][0] == "«1o »1c"


def test_single_marks(spark):
    chapters = [[('"a" b "c', True)], [("“a ‘b’ c”", True)], [('x"y"z', True)]]
    got = resolved(spark, chapters, ["typewriter_english"], singly=True)
    assert got[0] == ('"1o "1c "1o', []) and got[2][1] == ["ambiguous"]
    assert resolved(spark, chapters, ["standard_english"], singly=True)[1] == ("“1o ‘2o ’2c ”1c", [])


def test_compatible_conventions(spark):
    rng = random.Random(1)
    quoted = lambda o, c, a, b: f"and they said, {o}go to {a}the hill{b} of number {rng.randrange(100)}{c} to all"
    chapters = [[(quoted(*marks), True) for _ in range(30)] for marks in ("“”‘’", "«»‹›", "\"\"''")]
    rows, every = table(spark, chapters), qr.Conventions()
    marks = qr.placed_marks(rows, every, "chapter")
    found = qr.compatible_conventions(qr.mark_statistics(rows, marks, every, "chapter", "chapter"), every, "chapter").collect()
    names = {c: {r["name"] for r in found if r["chapter"] == c} for c in range(3)}
    assert "standard_english" in names[0] and "standard_french" in names[1] and "typewriter_english" in names[2]
    for c, marks in enumerate(("“”‘’", "«»‹›", "\"\"''")):
        for name in names[c]:
            assert {m for pair in qu.levels(qu.CONVENTIONS[name]) for m in pair} >= set(marks)


def test_apostrophes_are_no_quotation_marks(spark):
    rows = table(spark, [[(f"it isn't {i} and they don't say, “go there” now", True) for i in range(40)]])
    every = qr.Conventions()
    stats = qr.mark_statistics(rows, qr.placed_marks(rows, every, "chapter"), every, "chapter", "chapter")
    names = {r["name"] for r in qr.compatible_conventions(stats, every, "chapter").collect()}
    assert "standard_english" in names and "hybrid_typewriter_english" in names and "british_typewriter_english" not in names


@pytest.mark.parametrize(
    ("source", "target", "text", "want", "how"),
    [
        ("standard_english", "british_english", "“Go ‘now’ and don’t wait.”", "‘Go “now” and don’t wait.’", "full"),
        ("standard_english", "standard_french", "He said, “Go ‘now’.” End", "He said, «Go ‹now›.» End", "full"),
        ("standard_english", "typewriter_french", "“Go ‘now’”", "<<Go <now>>>", "full"),
        ("standard_english", "standard_french", "“never ends ‘x’", "«never ends ‹x›", "singly"),
        ("standard_swedish", "standard_english", "”Go”", "“Go”", "full"),
        ("typewriter_english", "standard_english", 'a"b', 'a"b', "skip"),
        ("standard_english", "standard_french", "plain", "plain", "full"),
    ],
)
def test_rewriting(spark, source, target, text, want, how):
    (row,) = qr.rewritten(table(spark, [[(text, True)]]), source, target, "chapter").collect()
    assert (row["text"], row["strategy"]) == (want, how)


def test_segments_of_books(spark):
    from segmill.sources import usfm as tokens_of
    from segmill.sources.usfm_events import placed, text_rows

    usfm = "\\id MAT\r\n\\c 1\r\n\\s Head “x\r\n\\p\r\n\\v 1 He said, “Go\r\n\\v 2 and stay.”\r\n\\p\r\n\\v 3 “New”\r\n"
    books = text_rows(placed(tokens_of.tokenized(spark.createDataFrame([("x", usfm)], "path string, content string")))).where("kind = 'verse'")
    rows = qr.segments(books)
    assert [(r["verse"], r["text"]) for r in rows.orderBy("ord").collect()] == [("1", "He said, “Go"), ("2", "and stay.”"), ("3", "“New”")]
    own = qr.Conventions(["standard_english"])
    (r,) = qr.resolve(qr.placed_marks(rows, own, "book", "chapter"), own, "book", "chapter").collect()
    assert [(m["depth"], m["direction"]) for m in r["found"]] == [(1, "opening"), (1, "closing")] * 2 and r["issues"] == []


def test_one_pass_over_many_long_chapters(spark):
    texts = {k: " ".join(["“a ‘b’ c”"] * (k * 300)) + (" “d" if k % 2 else "") for k in range(1, 6)}
    rows = spark.createDataFrame([(k, 0, "1", True, False, t) for k, t in texts.items()], "chapter int, ord long, verse string, paragraph boolean, embedded boolean, text string")
    own = qr.Conventions(["standard_english"])
    df = qr.resolve(qr.placed_marks(rows, own, "chapter"), own, "chapter").coalesce(1)
    assert "ArrowEvalPython" in df._jdf.queryExecution().toString()
    for r in df.collect():
        four = [("“", 1, "opening"), ("‘", 2, "opening"), ("’", 2, "closing"), ("”", 1, "closing")]
        assert [(m.mark, m.depth, m.direction) for m in r.found] == four * (r.chapter * 300) + four[: r.chapter % 2]
        assert all(texts[r.chapter][m.start : m.end] == m.mark for m in r.found) and r.issues == ["unpaired"] * (r.chapter % 2)
