from pyspark.sql import functions as F

from segmill.operators import quotes as qu


def test_marks_and_detection(spark):
    rows = [(1, "She said, “He told me, ‘Don't go!’ and left.” Then “Yes.”"), (2, "Il dit: «Elle a dit ‹oui›.»"), (3, "no marks")]
    df = spark.createDataFrame(rows, "text_id int, text string")
    marks = qu.find_marks(df, F.col("text"), "text_id")
    for r in marks.collect():
        text = dict(rows)[r.text_id]
        assert text[r.position : r.position + len(r.mark)] == r.mark and text[r.position - 1 : r.position] == r.before
    context = qu.marked_context(marks)
    assert [r.position for r in context.where("apostrophe").collect()] == [dict(rows)[1].index("'")]
    placed = [(r.mark, r.direction, r.depth) for r in qu.nested(context, "text_id").where("text_id = 1").orderBy("nth").collect()]
    assert placed == [("“", "opening", 1), ("‘", "opening", 2), ("’", "closing", 2), ("”", "closing", 1), ("“", "opening", 1), ("”", "closing", 1)]
    scores = qu.similarities(qu.tabulate(qu.nested(context, "text_id"), "text_id"), "text_id")
    assert {r.text_id: r.name for r in qu.detect(scores, "text_id").collect()}.keys() == {1, 2}
    best = {r.text_id: r.score for r in qu.detect(scores, "text_id").collect()}
    assert best == {1: 1.0, 2: 1.0}


def test_convert(spark):
    df = spark.createDataFrame([("“a ‘b’ c”",)], "s string")
    found = df.select(qu.convert(F.col("s"), "standard_english", "standard_french").alias("f"), qu.convert(F.col("s"), "standard_english", "british_english").alias("b")).first()
    assert (found.f, found.b) == ("«a ‹b› c»", "‘a “b” c’")
