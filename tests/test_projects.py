from pyspark.sql import functions as F

from segmill.corpus import from_table
from segmill.operators import translation as tr
from segmill.sources import projects as pr

SETTINGS = '<ScriptureText><Name>Abc</Name><FullName>A project</FullName><Encoding>1252</Encoding><Versification>3</Versification><LanguageIsoCode>en:::</LanguageIsoCode><Naming PrePart="" PostPart="Abc.SFM" BookNameForm="41MAT" /></ScriptureText>'
RENDERINGS = """<TermRenderingsList>
<TermRendering Id="t1" Guess="false"><Renderings>Ann* (a name)||Anna</Renderings></TermRendering>
<TermRendering Id="t2" Guess="true"><Renderings>guess</Renderings></TermRendering>
<TermRendering Id="t3"><Renderings></Renderings></TermRendering>
</TermRenderingsList>"""
TERMS = "<L><Term Id='t1'><Category>PN</Category></Term><Term Id='t3'><Category>RI</Category></Term></L>"
GLOSSES = "<L><Localization Id='t3' Gloss='law; custom (of people)' /><Localization Id='t1' Gloss='Ann' /></L>"


def test_settings(spark, tmp_path):
    (tmp_path / "Settings.xml").write_text(SETTINGS, encoding="utf-8")
    found = pr.read_settings(spark, str(tmp_path / "Settings.xml"))
    assert (found["name"], found["encoding"], found["versification"], found["language"]) == ("Abc", "cp1252", "Vulgate", "en")
    assert pr.book_file_name(found, "MAT", 40) == "41MATAbc.SFM" and pr.book_file_name(found, "GEN", 1) == "01GENAbc.SFM"


def test_terms(spark, tmp_path):
    for name, text in (("r.xml", RENDERINGS), ("t.xml", TERMS), ("g.xml", GLOSSES)):
        (tmp_path / name).write_text(text, encoding="utf-8")
    at = lambda n: str(tmp_path / n)
    rows = {r.id: r for r in pr.read_terms(spark, at("r.xml"), at("t.xml"), at("g.xml")).collect()}
    assert set(rows) == {"t1", "t3"}
    assert (rows["t1"].renderings, rows["t1"].patterns, rows["t1"].category) == (["Ann", "Anna"], ["Ann*", "Anna"], "PN")
    assert rows["t3"].renderings == ["custom", "law"]
    only = pr.term_corpus(pr.read_terms(spark, at("r.xml"), at("t.xml"), at("g.xml"), ("PN",))).df.collect()
    assert sorted((r.ref, r.segment[0], r.content_type) for r in only) == [("t1", "Ann", "word"), ("t1", "Anna", "word")]


def test_engine_graphs_and_suggestions(spark):
    corpus = from_table(spark.createDataFrame([(1, "a b", "x"), (2, "", "y")], "ref int, source string, target string"))
    made = tr.translate(corpus, lambda: lambda rows: [[w.upper() for w in r] for r in rows])
    assert {r.ref: r.target_segment for r in made.df.collect()} == {1: ["A B"], 2: []}
    graph = spark.createDataFrame([([(0, 1, -1.0), (0, 2, -0.5), (1, 3, -1.0), (2, 3, -2.0)], [3])], f"arcs {tr.ARCS}, finals array<int>")
    row = graph.select(tr.best_path(F.col("arcs"), F.col("finals")).alias("p"), tr.rest_scores(F.col("arcs"), F.col("finals")).alias("r")).first()
    assert row.p == [0, 2] and row.r == [-2.0, -1.0, -2.0, 0.0]
    words = spark.createDataFrame([("in the big house .".split(), [0.9, 0.8, 0.7, 0.1, 0.9])], "t array<string>, c array<double>")
    assert words.select(tr.suggestion(F.col("t"), F.col("c"), F.lit(1)).alias("s")).first().s == ["the", "big"]
