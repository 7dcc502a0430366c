"""Diagnostics of verses, a book for each kind."""

from segmill.operators import scripture as sc
from segmill.sources import usfm, usfm_analysis

VRS = "MAT 1:5 2:3\nMRK 1:2\n-MAT 1:3\n*MAT 2:2,-,a,b\nMAT 2:3 = MAT 3:1\n"
HEAD = "\\id MAT\n\\c 1\n"
WHOLE = HEAD + "\\v 1 a\n\\v 2 a\n\\v 4 a\n\\v 5 a\n\\c 2\n\\v 1 a\n\\v 2a a\n\\v 2b a\n\\v 3 a\n"
CASES = {
    WHOLE: [],
    HEAD + "\\v 1 a\n\\v 5 a\n\\c 2\n\\v 1 a\n\\v 2a a\n": [("missing", "MAT 1:2", [3], 1), ("missing", "MAT 1:4", [3], 1), ("missing", "MAT 2:3", [7], 1)],
    HEAD + "\\v 1-2 a\n\\c 2\n\\v 1 a\n\\v 2a a\n\\v 3 a\n": [("missing", "MAT 1:4-5", [3], 2)],
    WHOLE + "\\v 4 a\n\\v 5 a\n\\c 3\n\\v 1 a\n": [("extra", "MAT 2:4-5", [12, 13], 2), ("extra", "MAT 3:1", [15], 1)],
    WHOLE.replace("\\v 4 a", "\\v x a\n\\v 4 a"): [("invalid", "MAT 1:x", [5], 1)],
    WHOLE.replace("\\v 1 a\n\\v 2 a\n\\v 4", "\\v 2-1 a\n\\v 1-2 a\n\\v 4"): [("invalid", "MAT 1:2-1", [3], 1)],
    WHOLE.replace("\\v 2 a", "\\v 2c a"): [("incorrect_segment", "MAT 1:2c", [4], 1)],
    WHOLE.replace("\\v 2a a\n\\v 2b a", "\\v 2 a"): [("incorrect_segment", "MAT 2:2", [9], 1)],
    WHOLE.replace("\\v 2b a\n\\v 3 a", "\\v 2b-3 a"): [("unsupported_range", "MAT 2:2b-3", [10], 2)],
    "\\id XXA\n\\c 1\n\\v 9 a\n": [],
    "\\id MRK\n\\c x\n\\c 1\n\\v 1 a\n\\v 2 a\n": [("invalid", "MRK x", [2], 1)],
}


def test_kinds(spark):
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    tokens = usfm.tokenized(spark.createDataFrame([(str(k), text) for k, text in enumerate(CASES)], "path string, content string")).cache()
    vrs, original = sc.parse_versification(VRS, "x"), sc.parse_versification("MAT 1:5 2:2 3:1\nMRK 1:2\n", "o")
    found: dict[int, list] = {k: [] for k in range(len(CASES))}
    for r in usfm_analysis.analyse(tokens, vrs, original).collect():
        found[int(r.path)].append((r.kind, r.reference, r.lines, r.affected))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in enumerate(CASES.values())}
    some = usfm_analysis.analyse(tokens, vrs, None, {40: [2]}).where("path = '1'").collect()
    spark.conf.unset("spark.sql.codegen.wholeStage")
    assert [(r.kind, r.reference) for r in some] == [("missing", "MAT 2:3")]


def test_chapters_of_over_a_thousand_verses(spark):
    vrs = sc.parse_versification("GEN 1:5\n-GEN 1:3\n*GEN 1:2,-,a,b\n", "made")
    verses = "".join(f"\\v {n} a\n" for n in range(1, 1006))
    tokens = usfm.tokenized(spark.createDataFrame([("x", f"\\id GEN\n\\c 1\n{verses}")], "path string, content string"))
    found = {(r.kind, r.reference): (r.lines, r.affected) for r in usfm_analysis.analyse(tokens, vrs).collect()}
    assert found == {("incorrect_segment", "GEN 1:2"): ([4], 1), ("extra", "GEN 1:3"): ([5], 1), ("extra", "GEN 1:6-1005"): (list(range(8, 1008)), 1000)}
