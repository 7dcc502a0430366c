"""Secret scans: fixed patterns, and a battery of randomness tests on other tokens.

Base spans come from three patterns.  The method looks at every other token
that could be encoded bytes: its alphabet is inferred (hex, base32, base64),
and its symbols are tested against what random bytes would give: chi-squared
for uniform use of the alphabet, runs above and below its middle, and serial
correlation.  The least of the three nominal p-values is the token's score.  In
short tokens it is far from evenly spread, as counts are whole numbers and the
three depend on each other, so it is ranked among the scores of random tokens of
the same encoding and length, which are drawn from a hash for each length met.
Random tokens have every rank alike often, structured ones small ones.

Short tokens tell less, so a bound for all would let words through or lose keys.
Tokens are therefore judged among those of their encoding and class of lengths,
over all documents: ranks are counted in fixed bins, those above a half give
the number of random tokens in a class, and the bound is the least that keeps
the share of others among the reported within the rate.

All of it is built from SQL functions, each linear in the text; texts are read
once and only spans and test results go on.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.llm.common import documents, shared_table, text_of

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the battery looks at.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

#: Share of other tokens allowed among those reported, in a class.
RATE = 0.05
#: Classes of lengths start here.
LENGTHS = (20, 32, 64)
#: Ranks are counted in so many bins; from the middle one on they are taken for random tokens.
BINS = 100
#: Random tokens drawn for each encoding and length met; shares near a half then err by 0.005.
DRAWS = 10_000
#: Lengths are told apart one by one from SHORTEST to EACH_LENGTH, then in eighths of a doubling to LAST_LENGTH, beyond
#: which scores hardly change any more.
SHORTEST, EACH_LENGTH, LAST_LENGTH = 16, 64, 256
#: Alphabet and pattern of each encoding, the first that fits is inferred.  Hex in capitals is lower-cased first.
ENCODINGS = {
    "hex": ("0123456789abcdef", r"^([0-9a-f]+|[0-9A-F]+)$"),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+$"),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r""),
}
#: Matches whose places are summed at once.
BLOCK = 256


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<gap, whole, part>>: each match, what lies before it, and one of its groups; at last what lies behind (whole is null)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(F.size(whole) > 0, F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), part.alias("part")))


SPAN = "array<struct<start:int,end:int,found:string>>"


def _spans(matches: Column) -> Column:
    """array<struct<start, end, found>> of the matches in an array column, in code points.

    Places are running sums of lengths.  They are summed in blocks, first over
    blocks and then inside each, so that no long array is copied for each match.
    """
    length = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["whole"]), F.lit(0))
    block = lambda i: F.slice(matches, i * BLOCK + 1, F.lit(BLOCK))
    blocks = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
    ahead = F.aggregate(
        F.transform(blocks, lambda i: F.aggregate(block(i), F.lit(0), lambda a, x: a + length(x))),
        F.array(F.lit(0)),
        lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)),
    )

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["part"].alias("found")))).alias("spans"))

    inside = F.zip_with(blocks, F.slice(ahead, F.lit(1), F.size(blocks)), lambda i, at: F.aggregate(block(i), F.struct(at.alias("at"), F.expr(f"CAST(array() AS {SPAN})").alias("spans")), step)["spans"])
    return F.coalesce(F.when(matches.isNotNull(), F.filter(F.flatten(inside), lambda x: x["found"].isNotNull())), F.expr(f"CAST(array() AS {SPAN})"))


def _blanked(text: Column, matches: Column, counts) -> Column:
    """The text with the matches that count replaced by as many spaces."""
    piece = lambda x: F.concat(x["gap"], F.coalesce(F.when(counts(x), F.repeat(F.lit(" "), F.length(x["whole"]))).otherwise(x["whole"]), F.lit("")))
    return F.when(matches.isNull(), text).otherwise(F.array_join(F.transform(matches, piece), ""))


def _tail(z: Column) -> Column:
    """Chance that a standard normal is over |z|: a rational approximation of erfc."""
    x = F.abs(z) / F.lit(2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * poly * F.exp(-x * x)


def battery(tokens: Column) -> Column:
    """Adds the tests' results to an array of struct<start, end, found>.

    Gives struct<start, end, kind (number of the encoding), n, chi2, z_runs,
    z_serial, p (nominal: of the least of three normal tails)>.  Padding (=) is no symbol; - and _ stand for + and /.  Means and
    variances are those of n symbols drawn alike: of chi-squared k - 1 and
    2 (k - 1) (n - 1) / n, of the runs given how many symbols are high, of the
    serial correlation -1 / n and 1 / n.  Chi-squared counts where it is too
    large, the others on both sides.  Steps are nested so that each is computed
    once a token.
    """
    def by_kind(kind: Column, value) -> Column:
        return F.when(kind == 0, F.lit(value("hex"))).when(kind == 1, F.lit(value("base32"))).otherwise(F.lit(value("base64")))

    size = lambda k: float(len(ENCODINGS[k][0]))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda a, y: a + y)
    kind = lambda x: F.when(x.rlike(ENCODINGS["hex"][1]), 0).when(x.rlike(ENCODINGS["base32"][1]), 1).otherwise(2)
    plain = lambda x: F.translate(F.when(x.rlike("^[0-9A-F]+$"), F.lower(x)).otherwise(x), "-_=", "+/")
    first = F.transform(tokens, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), plain(x["found"]).alias("found")))
    first = F.transform(F.filter(first, lambda x: F.length(x["found"]) >= SHORTEST), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), kind(x["found"]).alias("kind")))
    second = F.transform(
        first,
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"),
            F.length(x["found"]).cast("double").alias("n"),
            by_kind(x["kind"], size).alias("k"),
            # of each symbol, how often it stands there
            F.transform(F.split(by_kind(x["kind"], lambda k: ENCODINGS[k][0]), ""), lambda c: (F.length(x["found"]) - F.length(F.replace(x["found"], c, F.lit("")))).cast("double")).alias("counts"),
            F.when(x["kind"] == 0, F.translate(x["found"], ENCODINGS["hex"][0], "l" * 8 + "h" * 8)).when(x["kind"] == 1, F.translate(x["found"], ENCODINGS["base32"][0], "l" * 16 + "h" * 16)).otherwise(F.translate(x["found"], ENCODINGS["base64"][0], "l" * 32 + "h" * 32)).alias("halves"),
            F.transform(F.split(x["found"], ""), lambda c: F.instr(by_kind(x["kind"], lambda k: ENCODINGS[k][0]), c).cast("double")).alias("v"),
        ),
    )
    third = F.transform(
        second,
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["n"].alias("n"), x["k"].alias("k"),
            (add(F.transform(x["counts"], lambda c: c * c)) * x["k"] / x["n"] - x["n"]).alias("chi2"),
            F.length(F.replace(x["halves"], F.lit("l"), F.lit(""))).cast("double").alias("high"),
            F.regexp_count(x["halves"], F.lit("h+|l+")).cast("double").alias("runs"),
            (add(x["v"]) / x["n"]).alias("mean"),
            add(F.transform(x["v"], lambda y: y * y)).alias("squares"),
            add(F.zip_with(F.slice(x["v"], F.lit(2), F.size(x["v"]) - 1), F.slice(x["v"], F.lit(1), F.size(x["v"]) - 1), lambda a, b: a * b)).alias("lagged"),
            (F.get(x["v"], 0) + F.element_at(x["v"], -1)).alias("ends"),
        ),
    )
    spread = lambda x: x["squares"] - x["n"] * x["mean"] * x["mean"]
    lagged = lambda x: x["lagged"] - x["mean"] * (2 * x["n"] * x["mean"] - x["ends"]) + (x["n"] - 1) * x["mean"] * x["mean"]
    turns = lambda x: 2 * x["high"] * (x["n"] - x["high"]) / x["n"]
    fourth = F.transform(
        third,
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["n"].alias("n"), x["chi2"].alias("chi2"),
            ((x["chi2"] - x["k"] + 1) / F.sqrt(2 * (x["k"] - 1) * (x["n"] - 1) / x["n"])).alias("z_chi2"),
            F.when(turns(x) <= 1, 99.0).otherwise((x["runs"] - 1 - turns(x)) / F.sqrt(turns(x) * (turns(x) - 1) / (x["n"] - 1))).alias("z_runs"),
            F.when(spread(x) <= 1e-9, 99.0).otherwise((lagged(x) / spread(x) + 1 / x["n"]) * F.sqrt(x["n"])).alias("z_serial"),
        ),
    )
    upper = lambda z: F.when(z >= 0, _tail(z)).otherwise(1 - _tail(z))
    least = lambda x: F.least(upper(x["z_chi2"]), 2 * _tail(x["z_runs"]), 2 * _tail(x["z_serial"]))
    return F.transform(
        fourth,
        lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "kind", "n", "chi2", "z_runs", "z_serial")], (1 - F.pow(1 - least(x), F.lit(3.0))).alias("p")),
    )


def _class(x: Column) -> Column:
    """The number of encoding and length."""
    return x["kind"] * len(LENGTHS) + sum((F.when(x["n"] >= at, 1).otherwise(0) for at in LENGTHS[1:]), F.lit(0))


def cell_of(kind: Column, n: Column) -> Column:
    """The number of an encoding and a length; n is a count of symbols from SHORTEST on."""
    length = F.when(n <= EACH_LENGTH, n - SHORTEST)
    at, cells = EACH_LENGTH, EACH_LENGTH - SHORTEST
    while at < LAST_LENGTH:
        length = length.when(n < 2 * at, cells + F.floor((n - at) * 8 / at))
        at, cells = 2 * at, cells + 8
    return (kind * (cells + 1) + length.otherwise(cells)).cast("int")


def lengths_of_cells() -> list[int]:
    """The length that random tokens of each cell are drawn with, the same for all encodings."""
    found, at = list(range(SHORTEST, EACH_LENGTH)), EACH_LENGTH
    while at < LAST_LENGTH:
        found += [at + i * at // 8 for i in range(8)]
        at *= 2
    return [*found, LAST_LENGTH]


def level(p: Column, *ties: Column) -> Column:
    """A nominal p, told apart from equal ones by a hash: a test of few outcomes then has even ranks, too."""
    return F.round(p, 9) + F.pmod(F.xxhash64(*ties), F.lit(1 << 20)) * (1e-9 / (1 << 20))


def null_edges(cells: DataFrame, draws: int = DRAWS) -> DataFrame:
    """cell, edges: of random tokens of each of the given cells (cell, distinct), the levels between bins.

    A hash of the draw's number gives 64 even symbols at a time; as alphabets have
    a power of two of them, folding 64 into fewer keeps them even.
    """
    lengths, wide = lengths_of_cells(), ENCODINGS["base64"][0]
    part = 100
    spread = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // part) - 1))).alias("part")).repartition(cells.sparkSession.sparkContext.defaultParallelism, "cell", "part")
    each = spread.select("cell", F.explode(F.sequence(F.col("part") * part, F.least(F.lit(draws), (F.col("part") + 1) * part) - 1)).alias("draw"))
    symbols = F.concat(*[F.base64(F.unhex(F.sha2(F.concat_ws(" ", "cell", "draw", F.lit(i)), 384))) for i in range(LAST_LENGTH // 64)])
    kind = F.floor(F.col("cell") / len(lengths))
    narrow = F.lit(wide)
    for i, (alphabet, _) in enumerate(ENCODINGS.values()):
        narrow = F.when(kind == i, F.lit(alphabet * (len(wide) // len(alphabet)))).otherwise(narrow)
    length = F.element_at(F.array(*map(F.lit, lengths)), F.pmod("cell", F.lit(len(lengths))).cast("int") + 1)
    drawn = each.withColumn("token", F.left(F.call_function("translate", symbols, F.lit(wide), narrow), length))
    one = F.get(battery(F.array(F.struct(F.lit(0).alias("start"), length.alias("end"), F.col("token").alias("found")))), 0)
    # A token may by chance look like one of a smaller alphabet; it is then no token of this cell.
    scored = drawn.withColumn("t", one).where(cell_of(F.col("t.kind"), F.col("t.n")) == F.col("cell")).select("cell", level(F.col("t.p"), F.col("cell"), F.col("draw")).alias("level"))
    return scored.groupBy("cell").agg(F.percentile("level", [i / BINS for i in range(1, BINS)]).alias("edges"))


def edges_of(found: DataFrame) -> Column:
    """array by cell of the edges of bins, a constant: cells are less than 200."""
    cells = found.select(F.explode("tests").alias("t")).select(cell_of(F.col("t.kind"), F.col("t.n")).alias("cell")).distinct()
    got = {r["cell"]: r["edges"] for r in null_edges(cells).collect()}  # a row a cell
    return F.from_json(F.lit(json.dumps([got.get(i, []) for i in range(len(ENCODINGS) * len(lengths_of_cells()))])), "array<array<double>>")


def ranked(found: DataFrame) -> DataFrame:
    """tested() with class and bin of each token in place of its tests' results."""
    edges = edges_of(found)
    own = lambda x: level(x["p"], F.col("doc_id"), x["start"], x["end"])
    place = lambda x: F.aggregate(F.get(edges, cell_of(x["kind"], x["n"])), F.struct(F.lit(0).alias("bin"), own(x).alias("at")), lambda s, e: F.struct((s["bin"] + (e < s["at"]).cast("int")).alias("bin"), s["at"].alias("at")))["bin"]
    return found.withColumn("tests", F.transform("tests", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _class(x).alias("class"), place(x).alias("bin"))))


def thresholds(tests: DataFrame, rate: float = RATE) -> dict[int, int]:
    """The least bin of each class from which on tokens are reported; none for a class without tokens above a half.

    tests: class, bin.  Random tokens fill bins evenly, so twice those above a
    half are random; what else stands above a bound should be within the rate.
    That holds for expected numbers: the fewer tokens, the wider chance strays.  And
    others that rank above a half count as random ones, so where random tokens are
    a small part of their class the share of others can be over the rate.
    """
    above = Window.partitionBy("class").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = tests.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"))  # classes times bins rows at most
    passed = (
        counted.withColumn("so_far", F.sum("n").over(above))
        .withColumn("random", 2 * F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).over(Window.partitionBy("class")))
        .filter((F.col("random") > 0) & (F.col("so_far") - F.col("random") * (1 - F.col("bin") / BINS) <= rate * F.col("so_far")))
    )
    return {r["class"]: r["bin"] for r in passed.groupBy("class").agg(F.min("bin").alias("bin")).collect()}  # a row a class


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per row of docs: doc_id, base array and random array of spans (start, end, and kind for base).

    Places are code points of the whole text, ends exclusive; a null text is an
    empty one and has none.  Random spans are found in what is left when base
    spans are blanked out, kind by kind.  Repeated rows are searched alike, and
    each of their tokens counts as a test.  An empty table gives an empty one.
    Other columns of docs are not looked at.
    """
    found = ranked(tested(docs))
    passed = thresholds(found.select(F.explode("tests").alias("t")).select("t.class", "t.bin"), rate)
    chosen = F.filter("tests", lambda x: x["bin"] >= _limit(x["class"], passed))
    return found.select("doc_id", "base", chosen.alias("random"))


def tested(docs: DataFrame) -> DataFrame:
    """doc_id, base and tests (battery() of all tokens) of every row, as a table."""
    text, left = F.col("__text"), F.col("__left")
    kind = lambda name, k: F.transform(_spans(F.col(name)), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["found"].alias("found")))
    long_enough = lambda x: F.length(x["part"]) >= 6
    any_ = lambda x: F.lit(True)
    found = (
        docs.select("doc_id", text_of().alias("__text"))
        .withColumns({"assign": _matches(text, ASSIGN, 2), "access": _matches(text, ACCESS), "hex": _matches(text, HEX)})
        .withColumn("base", F.sort_array(F.concat(F.filter(kind("assign", 0), lambda x: F.length(x["found"]) >= 6), kind("access", 1), kind("hex", 2))))
        .withColumn("__left", _blanked(text, F.col("assign"), long_enough))
        .drop("__text", "assign")
        .withColumn("__left", F.when(F.col("access").isNull(), left).otherwise(_blanked(left, _matches(left, ACCESS), any_)))
        .withColumn("__left", F.when(F.col("hex").isNull(), left).otherwise(_blanked(left, _matches(left, HEX), any_)))
        .select("doc_id", F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("base"), _matches(left, TOKEN).alias("token"))
        .withColumn("token", _spans(F.col("token")))
        .select("doc_id", "base", battery(F.col("token")).alias("tests"))
    )
    return shared_table(found, "secret-spans")


def _limit(cls: Column, passed: dict[int, int]) -> Column:
    found = F.lit(BINS)
    for c, b in passed.items():
        found = F.when(cls == c, b).otherwise(found)
    return found


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    random = F.transform("random", lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.sort_array(F.concat("base", random))).alias("spans")
    )
