import json

import pytest

from segmill.operators import scripture as sc
from segmill.plans import jobs
from segmill.plans import scripture_plans as pl

ROW = "text_id string, row_ord long, ref long, segment array<string>, sentence_start boolean, in_range boolean, range_start boolean, content_type string"


def corpus(spark, rows):
    from segmill.corpus import TextCorpus

    return TextCorpus(spark.createDataFrame([("GEN", r[0], r[0], r[1], True, False, False, "segment") for r in rows], ROW))


def test_versified_alignment_and_extraction(spark):
    source_vrs, target_vrs = sc.parse_versification("GEN 1:3 2:3\nGEN 1:3 = GEN 2:1\n", "s"), sc.parse_versification("GEN 1:2 2:3\n", "t")
    source = corpus(spark, [(1001001, ["a"]), (1001003, ["b"])])
    target = corpus(spark, [(1001001, ["x"]), (1002001, ["y"])])
    moved = pl.align_versified(source, target, source_vrs, target_vrs)
    found = {r.source_segment[0]: (r.target_segment, r.target_refs) for r in moved.df.collect()}
    assert found["a"] == (["x"], [1001001])
    lines = {r.number: r.line for r in pl.extract(source, source_vrs).collect()}
    assert lines[1001001] == "a" and lines[1001002] == "" and len(lines) == 6
    assert pl.verse_list(spark, target_vrs).count() == 5 and pl.verse_list(spark, target_vrs).count(include_empty=False) == 0


def test_alignment_job(spark, tmp_path):
    pairs = [("das haus", "the house"), ("das buch", "the book"), ("ein buch", "a book"), ("ein haus", "a house")]
    (tmp_path / "s.txt").write_text("\n".join(s for s, _ in pairs) + "\n", encoding="utf-8")
    (tmp_path / "t.txt").write_text("\n".join(t for _, t in pairs) + "\n", encoding="utf-8")
    jobs.align_files(spark, str(tmp_path / "s.txt"), str(tmp_path / "t.txt"), str(tmp_path / "out"), {"iterations": 6, "tokenizer": "whitespace"})
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(rows) == 4 and all(r["alignment"] == "0-0 1-1" for r in rows)
    with pytest.raises(ValueError):
        jobs.AlignmentOptions.of({"unknown": 1})
