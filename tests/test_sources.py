import io
import zipfile

import pytest
from pyspark.sql import functions as F

from segmill.operators import rows as ro
from segmill.operators import scripture as sc
from segmill.operators import sequences as sq
from segmill.operators import statistics as st
from segmill.operators import word_alignment as wa
from segmill.sources import files, markup
from segmill.sources import books as books_of

USFM = r"""\id MAT a test
\h Matthew
\mt1 Matthew
\c 1
\s A heading
\p
\v 1 First verse, \f + \ft a note\f* with a \nd style\nd*.
\v 2-3 A bridge
\q1 goes on
\v 2-3 again
\c 2
\p
\v 1 Next chapter
\v 2
"""


def test_text_files(spark, tmp_path):
    (tmp_path / "a-x.txt").write_text("\ufeffone\n\n three \n", encoding="utf-8")
    (tmp_path / "b-y.txt").write_text("k_1\ttext\tir,rs\r\nk_2\t\tin_range\r\nk_3\tlast\t\r\n", encoding="utf-8")
    rows = sorted(files.read_text(spark, f"{tmp_path}/*-*.txt").df.collect(), key=lambda r: (r.text_id, r.row_ord))
    assert [(r.text_id, r.segment, r.sentence_start, r.in_range, r.range_start) for r in rows] == [
        ("a-x", ["one"], True, False, False), ("a-x", [], True, False, False), ("a-x", ["three"], True, False, False), ("b-y", ["text"], False, True, True), ("b-y", [], False, True, False), ("b-y", ["last"], False, False, False),
    ]
    assert rows[0].ref[0].num == 1 and (rows[3].ref[0].str, rows[3].ref[1].num) == ("k", 1)
    assert {r.text_id for r in files.read_text(spark, f"{tmp_path}/a-x.txt").df.collect()} == {"*all*"}
    files.write_text(files.read_text(spark, f"{tmp_path}/*-*.txt"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 6


def test_alignment_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0-1:0.5:0.25 NULL-2\n\n", encoding="utf-8")
    rows = files.read_alignments(spark, str(tmp_path / "a.txt")).df.select(ro.pairs_to_string(F.col("pairs"), scores=True).alias("p")).collect()
    assert sorted(r.p for r in rows) == ["", "0-1:0.5:0.25 NULL-2"]


def test_records(spark, tmp_path):
    df = spark.createDataFrame([("c", "t", ["1"], ["1"], "x", ["x"], ["x"], "0-0", 0.123456789012)], files.PRETRANSLATION)
    files.write_records(df, str(tmp_path / "r"))
    assert files.read_records(spark, str(tmp_path / "r")).first().sequenceConfidence == 0.12345679


def test_usfm_usx_and_zip(spark, tmp_path):
    (tmp_path / "41MAT.SFM").write_text(USFM, encoding="utf-8")
    corpus = markup.verse_corpus(books_of.read_books(spark, str(tmp_path)))
    rows = sorted(corpus.df.collect(), key=lambda r: r.row_ord)
    assert [(r.ref, r.segment, r.in_range, r.range_start) for r in rows] == [
        (40001001, ["First verse, with a style."], False, False), (40001002, ["A bridge goes on"], True, True), (40001003, [], True, False), (40002001, ["Next chapter"], False, False), (40002002, [], False, False),
    ]
    assert [r.sentence_start for r in rows] == [True, True, False, False, False]
    usx = b'<usx version="3.0"><book code="MRK" style="id"/><chapter number="1" style="c"/><para style="s">Head</para><para style="p"><verse number="1" style="v"/>One <note><char>n</char></note>two<verse eid="x"/><verse number="2" style="v"/>Three</para></usx>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("USX/MRK.usx", usx)
        z.writestr("metadata.xml", "<x/>")
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips" / "b.zip").write_bytes(held.getvalue())
    found = markup.verse_corpus(books_of.read_books(spark, str(tmp_path / "zips"))).df.orderBy("ref").collect()
    assert [(r.ref, r.segment) for r in found] == [(41001001, ["One two"]), (41001002, ["Three"])]


def test_rewrite_and_write_usfm(spark, tmp_path):
    (tmp_path / "41MAT.SFM").write_text(USFM, encoding="utf-8")
    books = books_of.read_books(spark, str(tmp_path)).cache()
    updates = spark.createDataFrame([("MAT", 1, "1", "New one."), ("MAT", 2, "2", "Filled.")], "book string, chapter int, verse string, text string")
    text = markup.to_usfm(markup.rewrite_verses(books, updates)).first().usfm
    assert text == "\\id MAT\r\n\\c 1\r\n\\p\r\n\\v 1 New one.\r\n\\v 2-3 A bridge goes on\r\n\\c 2\r\n\\p\r\n\\v 1 Next chapter\r\n\\v 2 Filled.\r\n"
    kept = {(r.chapter, r.verse): r.text for r in markup.rewrite_verses(books, updates, "existing").collect()}
    assert kept[1, "1"] == "First verse, with a style." and kept[2, "2"] == "Filled."


VRS = """# Versification "Test"
GEN 1:31 2:25
EXO 1:22
MAT 1:25 END
GEN 1:31 = GEN 2:1
&EXO 1:1-2 = EXO 1:1
-GEN 2:5
*GEN 1:3,-,a,b
#! MRK 1:45
"""


def test_versification(spark):
    vrs = sc.parse_versification(VRS)
    assert vrs.name == "Test" and vrs.chapters[1, 2] == 25 and vrs.chapters[41, 1] == 45 and vrs.excluded == {1002005}
    assert vrs.segments == [(1001003, "-"), (1001003, "a"), (1001003, "b")]
    assert sc.verse_rows(spark, vrs).count() == 31 + 24 + 22 + 25 + 45
    other = sc.parse_versification("GEN 1:30 2:26\nEXO 1:22\n", "Other")
    df = spark.createDataFrame([(1001031,), (1001001,), (2001002,), (1002001,)], "number long")
    assert {r.number: r.new_number for r in sc.change_versification(df, vrs, other).collect()} == {1001031: 1002001, 1001001: 1001001, 2001002: 2001001, 1002001: 1002001}
    assert {r.number: r.new_number for r in sc.change_versification(df, other, vrs).collect()}[1002001] == 1002001  # the target has that verse
    with pytest.raises(ValueError):
        sc.parse_versification("XYZ 1:1")


def test_references(spark):
    df = spark.createDataFrame([("GEN 1:3-5,7a",), ("gen 12:1/LEB",), ("nonsense",), ("ABC 1:1",)], "r string")
    rows = df.select(sc.parse(F.col("r")).alias("p")).collect()
    assert (rows[0].p.book_num, rows[0].p.chapter, rows[0].p.verse, rows[0].p.verse_num) == (1, 1, "3-5,7a", 3)
    assert rows[1].p.chapter == 12 and rows[2].p is None and rows[3].p is None
    pairs = spark.createDataFrame([("3-5,7a", "5"), ("1a", "1b"), ("1", "2-3")], "a string, b string")
    found = pairs.select(sc.all_verses(F.col("a")).alias("v"), sc.overlapping(F.col("a"), F.col("b")).alias("o"), sc.merged_verses(F.col("a"), F.col("b")).alias("m")).collect()
    assert [(r.v, r.o, r.m) for r in found] == [([3, 4, 5, 7], True, "3-5,7"), ([1], False, "1"), ([1], False, "1-3")]
    assert sc.parse_selection("OT;-LUK-GEN"[:2] + ";MAT 1-3,5;-EXO")[40] == [1, 2, 3, 5]
    lines = sc.verse_lines(spark.createDataFrame([(1,), (2,), (3,)], "number long"), spark.createDataFrame([(1, 0, "a", True, True), (2, 1, "", True, False)], "number long, row_ord int, text string, in_range boolean, range_start boolean"))
    assert {r.number: r.line for r in lines.collect()} == {1: "a", 2: "<range>", 3: ""}
    runs = sc.diagnose(spark.createDataFrame([(1,), (2,), (3,), (5,)], "number long"), spark.createDataFrame([(1,), (9,)], "number long"))
    assert {tuple(r) for r in runs.collect()} == {("missing", 2, 3), ("missing", 5, 5), ("extra", 9, 9)}


def test_sequences(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("ab", "abcd"), ("", "x")], "a string, b string")
    rows = df.select(sq.edit_operations(F.col("a"), F.col("b")).alias("e"), sq.edit_operations(F.col("a"), F.col("b"), prefix=True).alias("p")).collect()
    assert [(r.e.cost, r.e.operations) for r in rows] == [(3.0, "SHHHSHI"), (2.0, "HHII"), (1.0, "I")]
    assert (rows[1].p.cost, rows[1].p.operations) == (0.0, "HHPP")
    seqs = spark.createDataFrame([(list("abcd"), list("bc"))], "a array<string>, b array<string>")
    best = {m: seqs.select(sq.aligned(F.col("a"), F.col("b"), m).alias("x")).first().x for m in sq.MODES}
    assert (best["global"].score, best["semi_global"].score, best["local"].score) == (0, 200, 200)
    assert [(c.a, c.b) for c in best["local"].columns] == [("b", "b"), ("c", "c")] and best["global"].normalized == 0.0


def test_clusters(spark):
    d = {"ab": 2, "ac": 6, "ad": 10, "bc": 6, "bd": 10, "cd": 10}
    rows = [(g, k[0], k[1], float(v)) for g in (1, 2) for k, v in d.items()]
    df = spark.createDataFrame(rows, "g int, a string, b string, distance double")
    edges = {(r.parent, r.child): r.length for r in sq.cluster_trees(df, "g").where("g = 1").collect()}
    assert edges == {("#0", "a"): 1, ("#0", "b"): 1, ("#1", "c"): 3, ("#1", "#0"): 2, ("#2", "d"): 5, ("#2", "#1"): 2}
    joined = sq.cluster_trees(df, "g", "neighbor_joining").where("g = 2").collect()
    assert sum(r.length for r in joined) == pytest.approx(1 + 1 + 2 + 3 + 7)
    flat = {r.item: r.cluster for r in sq.flat_clusters(df, "g", 7.0).where("g = 1").collect()}
    assert flat == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_symmetrization():
    f, b = {(0, 0), (1, 1), (2, 1)}, {(0, 0), (1, 1), (1, 2), (3, 3)}
    assert wa.symmetrized(f, b, "grow_diag") == {(0, 0), (1, 1), (2, 1), (1, 2)}
    assert wa.symmetrized(f, b, "grow_diag_final") == f | b
    assert wa.symmetrized(f, b, "och") == f | b
    assert wa.symmetrized({(0, 0)}, {(0, 1), (1, 1)}, "priority") >= {(0, 0), (0, 1)}


def test_ibm1_finds_the_words(spark):
    pairs = [("das haus", "the house"), ("das buch", "the book"), ("ein buch", "a book")]
    df = spark.createDataFrame([(i, s.split(), t.split()) for i, (s, t) in enumerate(pairs)], "row_ord int, source_segment array<string>, target_segment array<string>")
    best = {}
    for r in wa.ibm1(df, iterations=12).collect():
        if r.source != "NULL" and r.probability > best.get(r.source, ("", 0))[1]:
            best[r.source] = (r.target, r.probability)
    assert {s: t for s, (t, _) in best.items()} == {"das": "the", "haus": "house", "buch": "book", "ein": "a"}


def test_truecase(spark):
    rows = [(0, ["The", "dog", "met", "Anna", "."]), (1, ["Anna", "saw", "The", "dog", "."]), (2, ["so", "the", "dog", "ran", ".", "the", "end"])]
    df = spark.createDataFrame(rows, "row_ord int, segment array<string>")
    model = {r.token_lower: r.token for r in st.truecase_model(st.truecase_counts(df)).collect()}
    assert model["the"] == "the" and model["anna"] == "Anna" and "." not in model


def test_quality_of_known_scores(spark):
    df = spark.createDataFrame([(1, 0.8), (2, 0.5)], "id int, confidence double")
    rows = {r.id: r for r in st.segment_quality(df, 30.0, 30.0).collect()}
    assert rows[1].projected_chrf3 == pytest.approx(54.0) and 0 < rows[2].usability < rows[1].usability < 1
