"""The registered queries over the reference operators, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.corpus import AlignmentCorpus, flatten, from_table
from segmill.functions import characters as ch
from segmill.functions import text as tx
from segmill.functions import tokens as tk
from segmill.operators import align as al
from segmill.operators import boundaries
from segmill.operators import quote_resolution as qr
from segmill.operators import quotes as qu
from segmill.operators import rows as ro
from segmill.operators import scripture as sc
from segmill.operators import sequences as sq
from segmill.operators import statistics as st
from segmill.operators import word_alignment as wa
from segmill.operators import word_graphs as wg
from segmill.plans.views import LINES_SQL, TURNS, TURNS_SQL, lines, table, turns
from segmill.sources import usfm, usfm_analysis, usfm_events, usfm_update
from segmill.sources import usfm_markers as markers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: RE2 class of word separators, for the SQL.
SEP = ch.separators()


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SEP}+'), lambda x: x <> '')"


def escaped_sql(token: str) -> str:
    return f"CASE WHEN {token} = '|||' THEN '<3bars>' ELSE {token} END"


def joined(column):
    return F.array_join(column, " ")


def parallel_columns(rows: DataFrame) -> DataFrame:
    """Flat columns of parallel rows, the same in both engines."""
    refs = lambda c: F.array_join(F.transform(c, lambda r: r.cast("string")), ",")
    return rows.select(
        "text_id", refs("source_refs").alias("source_refs"), refs("target_refs").alias("target_refs"), joined("source_segment").alias("source"), joined("target_segment").alias("target"), "source_sentence_start", "target_sentence_start"
    )


# --- aligning ------------------------------------------------------------------------


def _align(spark, sf_dir, **flags):
    return turns(spark, sf_dir, "user").align_rows(turns(spark, sf_dir, "assistant"), **flags)


def _align_sql(kind: str) -> str:
    return f"""
WITH {TURNS_SQL},
ids AS (SELECT text_id FROM src INTERSECT SELECT text_id FROM trg)
SELECT coalesce(s.text_id, t.text_id) AS text_id, CAST(coalesce(s.ref, t.ref) AS VARCHAR) AS source_refs, CAST(coalesce(s.ref, t.ref) AS VARCHAR) AS target_refs,
       coalesce(s.text, '') AS source, coalesce(t.text, '') AS target, s.ref IS NOT NULL AS source_sentence_start, t.ref IS NOT NULL AS target_sentence_start
FROM src s {kind} JOIN trg t ON s.text_id = t.text_id AND s.ref = t.ref
"""


@query("align_inner", _align_sql("INNER"))
def align_inner(spark, sf_dir):
    return parallel_columns(_align(spark, sf_dir).df)


@query("align_left", _align_sql("LEFT"))
def align_left(spark, sf_dir):
    return parallel_columns(_align(spark, sf_dir, all_source_rows=True).df)


@query("align_right", _align_sql("RIGHT"))
def align_right(spark, sf_dir):
    return parallel_columns(_align(spark, sf_dir, all_target_rows=True).df)


@query("align_full", _align_sql("FULL"))
def align_full(spark, sf_dir):
    return parallel_columns(_align(spark, sf_dir, all_source_rows=True, all_target_rows=True).df)


def _by_half(corpus):
    """Refs cut by half, so that they repeat."""
    return corpus.transform({"ref": F.floor(F.col("ref") / 2)})


@query(
    "align_duplicate_refs",
    f"""
WITH {TURNS_SQL}
SELECT s.text_id, CAST(s.ref // 2 AS VARCHAR) AS source_refs, CAST(s.ref // 2 AS VARCHAR) AS target_refs, s.text AS source, t.text AS target, true AS source_sentence_start, true AS target_sentence_start
FROM src s JOIN trg t ON s.text_id = t.text_id AND s.ref // 2 = t.ref // 2
""",
)
def align_duplicate_refs(spark, sf_dir):
    return parallel_columns(_by_half(turns(spark, sf_dir, "user")).align_rows(_by_half(turns(spark, sf_dir, "assistant"))).df)


def _ranged(corpus, start: int, width: int):
    """Lines whose number within their document, over five, falls into a run are a range; its first line has all text."""
    place = F.pmod(F.col("line"), F.lit(5))
    inside, first = (place >= start) & (place < start + width), place == start
    return corpus.transform({"in_range": inside, "range_start": first, "segment": F.when(inside & ~first, F.expr("CAST(array() AS array<string>)")).otherwise(F.col("segment"))})


@query(
    "align_ranges",
    f"""
WITH {LINES_SQL},
s AS (SELECT text_id, row_ord, line % 5 >= 1 AND line % 5 < 3 AS rng, line % 5 = 1 AS beg, CASE WHEN line % 5 = 2 THEN '' ELSE line_text END AS txt FROM lines WHERE lang <> 'de'),
t AS (SELECT text_id, row_ord, line % 5 >= 2 AND line % 5 < 5 AS rng, line % 5 = 2 AS beg, CASE WHEN line % 5 IN (3, 4) THEN '' ELSE line_text END AS txt FROM lines WHERE line_text <> ''),
j AS (
  SELECT coalesce(s.text_id, t.text_id) AS text_id, coalesce(s.row_ord, t.row_ord) AS ref, s.row_ord IS NOT NULL AS hs, t.row_ord IS NOT NULL AS ht,
         coalesce(s.rng, false) AS rs, coalesce(t.rng, false) AS rt, coalesce(s.beg, false) AS bs, coalesce(t.beg, false) AS bt, coalesce(s.txt, '') AS xs, coalesce(t.txt, '') AS xt
  FROM s FULL JOIN t ON s.text_id = t.text_id AND s.row_ord = t.row_ord),
k AS (
  SELECT *, CASE WHEN rs OR rt THEN 'm' WHEN hs AND ht THEN 'r' ELSE 'd' END AS kind, hs AND ht AND (bs OR NOT rs) AND (bt OR NOT rt) AS fresh FROM j),
o AS (SELECT *, coalesce(lag(kind) OVER w = 'r', true) AS after_row FROM k WHERE kind <> 'd' WINDOW w AS (PARTITION BY text_id ORDER BY ref)),
i AS (SELECT *, sum(CASE WHEN kind = 'r' OR fresh OR after_row THEN 1 ELSE 0 END) OVER (PARTITION BY text_id ORDER BY ref ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (
  SELECT text_id, string_agg(ref::VARCHAR, ',' ORDER BY ref) FILTER (hs) AS source_refs, string_agg(ref::VARCHAR, ',' ORDER BY ref) FILTER (ht) AS target_refs,
         string_agg(xs, ' ' ORDER BY ref) FILTER (hs AND xs <> '') AS source, string_agg(xt, ' ' ORDER BY ref) FILTER (ht AND xt <> '') AS target, bool_or(hs) AS sb, bool_or(ht) AS tb
  FROM i WHERE kind = 'm' GROUP BY text_id, island)
SELECT text_id, coalesce(source_refs, '') AS source_refs, coalesce(target_refs, '') AS target_refs, coalesce(source, '') AS source, coalesce(target, '') AS target, sb AS source_sentence_start, tb AS target_sentence_start FROM m
UNION ALL
SELECT text_id, ref::VARCHAR, ref::VARCHAR, xs, xt, true, true FROM k WHERE kind = 'r'
""",
)
def align_ranges(spark, sf_dir):
    rows = lines(spark, sf_dir)
    source = _ranged(rows.filter("lang <> 'de'"), 1, 2)
    return parallel_columns(source.align_rows(_ranged(rows.filter_nonempty(), 2, 3)).df)


@query(
    "align_three_way",
    f"""
WITH {LINES_SQL},
a AS (SELECT * FROM lines WHERE line_text <> ''), b AS (SELECT * FROM lines WHERE lang <> 'de'), c AS (SELECT * FROM lines)
SELECT c.text_id, c.row_ord AS ref, CASE WHEN a.row_ord IS NOT NULL AND b.row_ord IS NOT NULL THEN a.line_text ELSE '' END AS a, CASE WHEN a.row_ord IS NOT NULL AND b.row_ord IS NOT NULL THEN b.line_text ELSE '' END AS b, c.line_text AS c
FROM c LEFT JOIN a USING (text_id, row_ord) LEFT JOIN b USING (text_id, row_ord)
""",
)
def align_three_way(spark, sf_dir):
    rows = lines(spark, sf_dir)
    found = al.align_n([rows.filter_nonempty().df, rows.filter("lang <> 'de'").df, rows.df], [False, False, True])
    at = lambda i, name: joined(F.get("segments", F.lit(i))).alias(name)
    return found.select("text_id", "ref", at(0, "a"), at(1, "b"), at(2, "c"))


def diagonal(corpus):
    """One pair for each of the first five words."""
    n = F.least(F.lit(5), F.size("segment"))
    pair = lambda i: F.struct(i.alias("source_index"), (i + 1).alias("target_index"), F.lit(True).alias("is_sure"), (i / 4).alias("translation_score"), F.lit(-1.0).alias("alignment_score"))
    return AlignmentCorpus(corpus.tokenize().filter_nonempty().df.withColumn("pairs", F.transform(F.sequence(F.lit(0), n - 1), pair)))


DIAGONAL_SQL = "array_to_string(list_transform(range(0, least(5, len({w}))), lambda i: i::VARCHAR || '-' || (i + 1)::VARCHAR), ' ')"


@query(
    "align_with_pairs",
    f"""
WITH {TURNS_SQL}
SELECT s.text_id, s.ref, CASE WHEN s.text <> '' AND t.text <> '' THEN {DIAGONAL_SQL.format(w=words_sql("s.text"))} END AS pairs
FROM src s JOIN trg t ON s.text_id = t.text_id AND s.ref = t.ref
""",
)
def align_with_pairs(spark, sf_dir):
    source = turns(spark, sf_dir, "user")
    found = source.align_rows(turns(spark, sf_dir, "assistant"), diagonal(source))
    return found.df.select("text_id", "ref", ro.pairs_to_string(F.col("pairs")).alias("pairs"))


@query(
    "text_universe",
    f"WITH {TURNS_SQL} SELECT text_id FROM src WHERE ref > 1 INTERSECT SELECT text_id FROM trg UNION SELECT text_id FROM trg WHERE ref > 2",
)
def text_universe(spark, sf_dir):
    user, reply = turns(spark, sf_dir, "user").filter("ref > 1").df, turns(spark, sf_dir, "assistant")
    return al.text_universe([user, reply.df], [False, False]).union(al.text_universe([reply.filter("ref > 2").df], [True])).distinct()


# --- corpus algebra --------------------------------------------------------------------


def line_columns(corpus):
    return corpus.df.select("text_id", "row_ord", joined("segment").alias("segment"))


def lines_sql(where: str = "true", tail: str = "") -> str:
    return f"WITH {LINES_SQL} SELECT text_id, row_ord, line_text AS segment FROM lines WHERE {where} {tail}"


@query("filter_texts", lines_sql("text_id IN ('src1', 'src12') OR text_id LIKE '%7'"))
def filter_texts(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return line_columns(flatten([rows.filter_texts(["src1", "src12"]), rows.filter_texts(F.col("text_id").like("%7"))]))


@query("filter_rows", lines_sql("lang = 'de' AND line > 1"))
def filter_rows(spark, sf_dir):
    return line_columns(lines(spark, sf_dir).filter("lang = 'de' AND line > 1"))


@query("filter_nonempty", lines_sql("line_text <> ''"))
def filter_nonempty(spark, sf_dir):
    return line_columns(lines(spark, sf_dir).filter_nonempty())


INDEX_SQL = f"WITH {LINES_SQL}, idx AS (SELECT *, row_number() OVER (ORDER BY text_id, row_ord) - 1 AS i FROM lines)"


@query("filter_by_index", f"{INDEX_SQL} SELECT text_id, row_ord, line_text AS segment FROM idx WHERE i % 3 = 0")
def filter_by_index(spark, sf_dir):
    return line_columns(lines(spark, sf_dir).filter_by_index(lambda i: i % 3 == 0))


@query("map_by_index", f"{INDEX_SQL} SELECT i, text_id, length(line_text) AS n FROM idx")
def map_by_index(spark, sf_dir):
    return lines(spark, sf_dir).map_by_index(lambda i: [i.alias("i"), F.col("text_id"), F.length(joined("segment")).cast("long").alias("n")])


@query("take", lines_sql(tail="ORDER BY text_id, row_ord LIMIT 250"))
def take(spark, sf_dir):
    return line_columns(lines(spark, sf_dir).take(250))


@query("batch", f"{INDEX_SQL} SELECT i // 1024 AS batch, count(*) AS n, sum(length(line_text))::BIGINT AS chars FROM idx GROUP BY 1")
def batch(spark, sf_dir):
    return lines(spark, sf_dir).batch(1024).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(joined("segment"))).alias("chars"))


@query("count_rows", f"WITH {LINES_SQL} SELECT text_id, count(*) AS n, count(*) FILTER (line_text <> '') AS nonempty FROM lines GROUP BY text_id")
def count_rows(spark, sf_dir):
    return lines(spark, sf_dir).df.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("segment") > 0).alias("nonempty"))


SPLIT_SQL = f"""
WITH {LINES_SQL},
pool AS (SELECT *, line_text <> '' AS inside, md5('7:' || text_id || ':' || row_ord) AS h FROM lines),
ranked AS (SELECT *, row_number() OVER (PARTITION BY inside ORDER BY h, text_id, row_ord) AS k, floor(0.15 * count(*) OVER (PARTITION BY inside)) AS want FROM pool),
split AS (SELECT *, inside AND k <= least(want, 900) AS held_out FROM ranked)
"""


@query("interleaved_split", f"{SPLIT_SQL} SELECT text_id, row_ord, held_out FROM split")
def interleaved_split(spark, sf_dir):
    return lines(spark, sf_dir).interleaved_split(percent=0.15, size=900, include_empty=False, seed=7).select("text_id", "row_ord", "held_out")


@query("split_heldout", f"{SPLIT_SQL} SELECT CASE WHEN held_out THEN 'held_out' ELSE 'main' END AS part, text_id, row_ord FROM split WHERE inside")
def split_heldout(spark, sf_dir):
    main, held = lines(spark, sf_dir).split(percent=0.15, size=900, include_empty=False, seed=7)
    return main.df.select(F.lit("main").alias("part"), "text_id", "row_ord").union(held.df.select(F.lit("held_out"), "text_id", "row_ord"))


@query(
    "flatten",
    f"WITH {LINES_SQL} SELECT 0 AS corpus_ord, text_id, row_ord FROM lines WHERE lang = 'en' UNION ALL SELECT 1, text_id, row_ord FROM lines WHERE line = 0",
)
def flatten_corpora(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return flatten([rows.filter("lang = 'en'"), rows.filter("line = 0")]).df.select("corpus_ord", "text_id", "row_ord")


@query(
    "invert",
    f"""
WITH {TURNS_SQL}
SELECT s.text_id, s.ref, t.text AS source, s.text AS target, CASE WHEN s.text <> '' AND t.text <> '' THEN array_to_string(list_transform(range(0, least(5, len({words_sql("s.text")}))), lambda i: (i + 1)::VARCHAR || '-' || i::VARCHAR), ' ') END AS pairs
FROM src s JOIN trg t ON s.text_id = t.text_id AND s.ref = t.ref
""",
)
def invert(spark, sf_dir):
    source = turns(spark, sf_dir, "user")
    found = source.align_rows(turns(spark, sf_dir, "assistant"), diagonal(source)).invert()
    return found.df.select("text_id", "ref", joined("source_segment").alias("source"), joined("target_segment").alias("target"), ro.pairs_to_string(F.col("pairs")).alias("pairs"))


@query(
    "from_table",
    "SELECT '*all*' AS text_id, doc_id AS ref, coalesce(source, '') AS source, coalesce(lang, '') AS target, '0-0 1-NULL' AS pairs FROM documents",
)
def import_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), "source", F.col("lang").alias("target"), F.lit("0-0 1-NULL").alias("alignment"))
    return from_table(docs).to_table(text_id="text_id", alignment="pairs")


# --- tokens ----------------------------------------------------------------------------


def words(spark, sf_dir):
    return lines(spark, sf_dir).tokenize("whitespace")


@query("tokenize_whitespace", f"WITH {LINES_SQL} SELECT text_id, row_ord, array_to_string({words_sql('line_text')}, '|') AS tokens, len({words_sql('line_text')}) AS n FROM lines")
def tokenize_whitespace(spark, sf_dir):
    return words(spark, sf_dir).df.select("text_id", "row_ord", F.array_join("segment", "|").alias("tokens"), F.size("segment").cast("long").alias("n"))


@query(
    "tokenize_line",
    r"""
SELECT doc_id, CASE WHEN p[-1] = '' THEN len(p) - 1 ELSE len(p) END AS n, array_to_string(p, '|') AS joined
FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n') AS p FROM documents)
""",
)
def tokenize_line(spark, sf_dir):
    found = tk.lines(F.coalesce("text", F.lit("")))
    ended = F.coalesce("text", F.lit("")).rlike("[\r\n]$")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.concat(F.array_join(found, "|"), F.when(ended, "|").otherwise("")).alias("joined"))


@query("tokenize_latin")
def tokenize_latin(spark, sf_dir):
    return lines(spark, sf_dir).tokenize("latin").df.select("text_id", "row_ord", F.array_join("segment", " ").alias("tokens"))


@query("tokenize_sentence")
def tokenize_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tk.tokenizer("latin_sentence")(F.coalesce("text", F.lit("")))).alias("position", "sentence"))


@query("tokenize_zwsp")
def tokenize_zwsp(spark, sf_dir):
    return lines(spark, sf_dir).transform({"segment": F.transform("segment", lambda s: F.regexp_replace(s, "([a-z]) ", "$1​"))}).tokenize("zwsp").df.select("text_id", "row_ord", F.array_join("segment", "|").alias("tokens"))


@query("detokenize_whitespace", f"WITH {LINES_SQL} SELECT text_id, row_ord, array_to_string({words_sql('line_text')}, ' ') AS segment FROM lines")
def detokenize_whitespace(spark, sf_dir):
    return line_columns(words(spark, sf_dir).detokenize("whitespace"))


@query("detokenize_latin")
def detokenize_latin(spark, sf_dir):
    return line_columns(lines(spark, sf_dir).tokenize("latin").detokenize("latin"))


@query("lowercase", lines_sql().replace("line_text AS segment", "lower(line_text) AS segment"))
def lowercase(spark, sf_dir):
    return line_columns(lines(spark, sf_dir).lowercase())


@query("normalize_nfc", lines_sql().replace("line_text AS segment", "nfc_normalize(line_text) AS segment"))
def normalize_nfc(spark, sf_dir):
    return line_columns(lines(spark, sf_dir).nfc_normalize())


@query(
    "escape_unescape",
    f"""
WITH {LINES_SQL}, w AS (SELECT text_id, row_ord, string_split(line_text, 'e') AS p FROM lines WHERE line_text <> '')
SELECT text_id, row_ord, array_to_string(list_transform(p, lambda x: CASE WHEN regexp_full_match(x, '{ch.white()}+') THEN '<space>' ELSE x END), '|') AS escaped,
       array_to_string(list_transform(p, lambda x: CASE WHEN regexp_full_match(x, '{ch.white()}+') THEN ' ' ELSE x END), '|') AS unescaped FROM w
""",
)
def escape_unescape(spark, sf_dir):
    parts = lines(spark, sf_dir).filter_nonempty().transform({"segment": F.split(F.get("segment", F.lit(0)), "e")})
    escaped = parts.escape_spaces()
    return escaped.df.select("text_id", "row_ord", F.array_join("segment", "|").alias("escaped"), F.array_join(tk.spaces_unescaped(F.col("segment")), "|").alias("unescaped"))


@query(
    "token_ranges",
    f"""
WITH {LINES_SQL}, w AS (SELECT text_id, row_ord, line_text, {words_sql('line_text')} AS p FROM lines WHERE line_text <> '')
SELECT text_id, row_ord, len(p) AS n, CAST(list_sum(list_transform(p, lambda x: length(x))) AS BIGINT) AS covered, p[1] AS first FROM w
""",
)
def token_ranges(spark, sf_dir):
    text = F.get("segment", F.lit(0))
    rows = lines(spark, sf_dir).filter_nonempty().df.withColumn("ranges", tk.token_ranges(text, tk.whitespace(text)))
    width = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return rows.select("text_id", "row_ord", F.size("ranges").cast("long").alias("n"), width.alias("covered"), F.get(tk.split_by_ranges(text, F.col("ranges")), F.lit(0)).alias("first"))


@query(
    "sentence_ending",
    f"""
WITH {LINES_SQL}
SELECT text_id, row_ord, regexp_matches(line_text, '{ch.of(ch.SENTENCE_TERMINALS)}{ch.of(ch.DELAYED_END).replace("'", "''")}*{ch.white()}*$') AS ending,
       regexp_matches(right(line_text, 1), '^{ch.of(ch.SENTENCE_TERMINALS)}+$') AS terminal FROM lines WHERE line_text <> ''
""",
)
def sentence_ending(spark, sf_dir):
    text = F.get("segment", F.lit(0))
    return lines(spark, sf_dir).filter_nonempty().df.select("text_id", "row_ord", tx.has_sentence_ending(text).alias("ending"), tx.is_sentence_terminal(F.right(text, F.lit(1))).alias("terminal"))


@query(
    "char_classes",
    rf"""
SELECT c AS character, regexp_matches(c, '^{ch.category("P")}$') AS punctuation, regexp_matches(c, '^{ch.category("S")}$') AS symbol, regexp_matches(c, '^{ch.category("Cc")}$') AS control, count(*) AS n
FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c
""",
)
def char_classes(spark, sf_dir):
    characters = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("character")).where("character <> ''")
    c = F.col("character")
    return characters.groupBy("character").agg(F.count(F.lit(1)).alias("n")).select("character", tx.in_category(c, "P").alias("punctuation"), tx.in_category(c, "S").alias("symbol"), tx.in_category(c, "Cc").alias("control"), "n")


@query(
    "parse_numbers",
    "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS whole, try_cast(value::VARCHAR AS DOUBLE) AS number FROM events",
)
def parse_numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.parse_integer(F.get_json_object("props", "$.k")).alias("whole"), tx.parse_float(F.col("value").cast("string")).alias("number"))


# --- statistics --------------------------------------------------------------------------

WORDS_SQL = f"WITH {LINES_SQL}, words AS (SELECT text_id, row_ord, unnest({words_sql('line_text')}) AS token, generate_subscripts({words_sql('line_text')}, 1) - 1 AS position FROM lines)"


@query("frequency", f"{WORDS_SQL} SELECT token, count(*) AS n FROM words GROUP BY token")
def frequency(spark, sf_dir):
    return st.frequency(st.tokens_of(words(spark, sf_dir).df))


@query("conditional_frequency", f"{WORDS_SQL} SELECT text_id, token, count(*) AS n FROM words GROUP BY text_id, token")
def conditional_frequency(spark, sf_dir):
    return st.frequency(st.tokens_of(words(spark, sf_dir).df, "text_id"), "text_id")


def _only_sql(token: str, points: str) -> str:
    quoted = ch.of(points).replace("'", "''")
    return f"regexp_matches({token}, '^{quoted}+$')"


#: What starts a sentence is told by a string of flags, one more than tokens: each says whether the next token is at a start.
TRUECASE_SQL = f"""
WITH {LINES_SQL},
held AS (SELECT text_id, row_ord, {words_sql('line_text')} AS p FROM lines),
flags AS (
  SELECT *, list_reduce(p, lambda s, t: s || CASE WHEN {_only_sql("t", ch.DELAYED_START)} THEN right(s, 1) WHEN right(s, 1) = 'f' AND {_only_sql("t", ch.SENTENCE_TERMINALS)} THEN 't' ELSE 'f' END, 't') AS f FROM held),
forms AS (SELECT text_id, row_ord, f, unnest(p) AS token, generate_subscripts(p, 1) AS k FROM flags),
counted AS (
  SELECT lower(token) AS token_lower, token, count(*) AS n, max((row_ord, k)) AS last_ord FROM forms
  WHERE regexp_matches(token, '[\\p{{Lu}}\\p{{Ll}}]') AND (substr(f, k, 1) = 'f' OR regexp_matches(token, '^\\p{{Ll}}')) GROUP BY 1, 2),
model AS (SELECT token_lower, token FROM counted QUALIFY row_number() OVER (PARTITION BY token_lower ORDER BY n DESC, last_ord, token) = 1)
"""


@query("truecase_train", f"{TRUECASE_SQL} SELECT token_lower, token FROM model")
def truecase_train(spark, sf_dir):
    return st.truecase_model(st.truecase_counts(words(spark, sf_dir).df))


@query(
    "truecase_apply",
    f"""{TRUECASE_SQL},
best AS (SELECT row_ord, string_agg(coalesce(m.token, forms.token), ' ' ORDER BY k) AS segment FROM forms LEFT JOIN model m ON m.token_lower = lower(forms.token) GROUP BY row_ord)
SELECT text_id, row_ord, coalesce(segment, '') AS segment FROM held LEFT JOIN best USING (row_ord)""",
)
def truecase_apply(spark, sf_dir):
    rows = words(spark, sf_dir).df
    return st.truecase(rows, st.truecase_model(st.truecase_counts(rows))).select("text_id", "row_ord", joined("segment").alias("segment"))


def _versions(spark, sf_dir):
    """Lines and what is left of them without every seventh word, as references and translations."""
    rows = words(spark, sf_dir).filter_nonempty().df
    return rows.select("row_ord", F.col("segment").alias("reference"), F.filter("segment", lambda t, i: (i + F.col("row_ord")) % 7 != 3).alias("translation"))


def _bleu_sql() -> str:
    parts = []
    for n in range(1, 5):
        grams = lambda c, n=n: f"(SELECT row_ord, array_to_string({c}[i:i + {n - 1}], ' ') AS g, count(*) AS k FROM (SELECT row_ord, {c}, unnest(range(1, len({c}) - {n - 2})) AS i FROM v WHERE len({c}) >= {n}) GROUP BY 1, 2)"
        parts.append(f"SELECT {n} AS n, coalesce(sum(least(a.k, coalesce(b.k, 0))), 0) AS m, coalesce(sum(a.k), 0) AS t FROM {grams('tr')} a LEFT JOIN {grams('rf')} b USING (row_ord, g)")
    return f"""
WITH {LINES_SQL},
v AS (
  SELECT row_ord, rf, list_transform(list_filter(list_zip(rf, range(0, len(rf))), lambda x: (x[2] + row_ord) % 7 <> 3), lambda x: x[1]) AS tr
  FROM (SELECT row_ord, {words_sql("line_text")} AS rf FROM lines WHERE line_text <> '')),
p AS ({" UNION ALL ".join(parts)}),
l AS (SELECT sum(len(tr)) AS c, sum(len(rf)) AS r FROM v)
SELECT round(100 * CASE WHEN c = 0 THEN 0 WHEN c < r THEN exp(1 - r / c) ELSE 1 END * exp((SELECT avg(CASE WHEN m > 0 THEN ln(m / t) ELSE -999999999 END) FROM p)), 6) AS bleu FROM l
"""


@query("bleu", _bleu_sql())
def bleu(spark, sf_dir):
    return st.bleu(_versions(spark, sf_dir)).select(F.round("bleu", 6).alias("bleu"))


SLOPE, INTERCEPT = 40.0, 20.0


def _confidences(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    pages = docs.join(labels, "doc_id").select("doc_id", F.col("source").alias("text_id"), ((F.col("quality") + 1) / (F.col("toxic") + 2) * (1 + F.col("doc_id") % 5) / 6).alias("confidence"))
    return st.segment_quality(pages, SLOPE, INTERCEPT)


QUALITY_SQL = """
WITH c AS (SELECT doc_id, source AS text_id, (quality + 1) / (toxic + 2) * (1 + doc_id % 5) / 6 AS confidence FROM documents JOIN labels USING (doc_id)),
p AS (SELECT *, 40.0::DOUBLE * confidence + 20.0::DOUBLE AS x FROM c),
q AS (
  SELECT *, exp(-((x - 51.4::DOUBLE) ** 2) / (2 * 95.19::DOUBLE)) * 263 AS good, exp(-((x - 45.85::DOUBLE) ** 2) / (2 * 99.91::DOUBLE)) * 97 AS bad FROM p),
s AS (SELECT doc_id, text_id, confidence, x AS projected_chrf3, good / (good + bad) AS usability FROM q)
"""
LABEL_SQL = "CASE WHEN usability >= 0.776 THEN 'green' WHEN usability >= 0.681 THEN 'yellow' ELSE 'red' END AS label"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("chrf3_segment", f"{QUALITY_SQL} SELECT doc_id, text_id, round(confidence, 6) AS confidence, round(projected_chrf3, 6) AS projected_chrf3, round(usability, 6) AS usability, {LABEL_SQL} FROM s")
def chrf3_segment(spark, sf_dir):
    return rounded(_confidences(spark, sf_dir), "confidence", "projected_chrf3", "usability")


@query(
    "chrf3_text",
    f"""{QUALITY_SQL}, g AS (
  SELECT text_id, CASE WHEN min(confidence) > 0 THEN exp(avg(ln(confidence))) ELSE 0 END AS confidence, avg(usability) AS usability FROM s GROUP BY text_id)
SELECT text_id, round(confidence, 6) AS confidence, round(usability, 6) AS usability, round(40.0 * confidence + 20.0, 6) AS projected_chrf3, {LABEL_SQL} FROM g""",
)
def chrf3_text(spark, sf_dir):
    return rounded(st.group_quality(_confidences(spark, sf_dir), ["text_id"], SLOPE, INTERCEPT), "confidence", "projected_chrf3", "usability")


LM_SQL = f"""{WORDS_SQL},
marked AS (SELECT row_ord, position, CASE WHEN row_number() OVER (PARTITION BY token ORDER BY row_ord, position) = 1 THEN '<unk>' ELSE token END AS token FROM words),
padded AS (SELECT row_ord, list_concat(list_concat(['<s>'], list(token ORDER BY position)), ['</s>']) AS p FROM marked GROUP BY row_ord),
grams AS (
  SELECT n, array_to_string(p[i:i + n - 1], ' ') AS gram, CASE WHEN n > 1 THEN array_to_string(p[i:i + n - 2], ' ') ELSE '' END AS prefix
  FROM (SELECT p, n, unnest(range(1, len(p) - n + 2)) AS i FROM padded, (VALUES (1), (2), (3)) AS o(n) WHERE len(p) >= n)),
counted AS (SELECT n, gram, prefix, count(*) AS count FROM grams GROUP BY 1, 2, 3)
SELECT CAST(c.n AS INT) AS n, c.gram, c.count, CAST(CASE WHEN c.n = 1 THEN (SELECT sum(count) FROM counted WHERE n = 1) ELSE d.count END AS BIGINT) AS prefix_count
FROM counted c LEFT JOIN counted d ON d.n = c.n - 1 AND d.gram = c.prefix
"""


@query("lm_ngrams", LM_SQL)
def lm_ngrams(spark, sf_dir):
    return st.ngram_counts(words(spark, sf_dir).df)


def _lexicon(spark, sf_dir):
    """Log counts of which word follows which."""
    pairs = words(spark, sf_dir).df.select(F.explode(st.ngrams(F.col("segment"), 2)).alias("gram"))
    ends = F.split("gram", " ")
    return pairs.groupBy(F.get(ends, F.lit(0)).alias("source"), F.get(ends, F.lit(1)).alias("target")).agg(F.log(F.count(F.lit(1))).alias("log_count"))


FOLLOW_SQL = f"{WORDS_SQL}, lex AS (SELECT a.token AS source, b.token AS target, ln(count(*)) AS log_count FROM words a JOIN words b ON a.row_ord = b.row_ord AND b.position = a.position + 1 GROUP BY 1, 2)"


@query(
    "lexicon_prune",
    f"""{FOLLOW_SQL}, kept AS (SELECT *, exp(log_count) / sum(exp(log_count)) OVER (PARTITION BY source) AS share FROM lex)
SELECT source, target, round(log_count, 6) AS log_count, round(ln(sum(exp(log_count)) OVER (PARTITION BY source)), 6) AS total FROM kept WHERE share >= 0.013""",
)
def lexicon_prune(spark, sf_dir):
    return rounded(st.prune_lexicon(_lexicon(spark, sf_dir), 0.013), "log_count", "total")


@query(
    "phrase_filter",
    f"""WITH {LINES_SQL}, {TURNS_SQL},
held AS (SELECT list_transform({words_sql("line_text")}, lambda x: {escaped_sql("x")}) AS p FROM lines WHERE text_id = 'src3'),
seen AS (SELECT DISTINCT array_to_string(p[i:j], ' ') AS g FROM (SELECT p, i, unnest(range(i, least(len(p), i + 11) + 1)) AS j FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM held))),
asked AS (
  SELECT array_to_string(list_transform(p[a:b], lambda x: {escaped_sql("x")}), ' ') AS phrase
  FROM (SELECT {words_sql("line_text")} AS p FROM lines), (VALUES (1, 1), (1, 3), (2, 8), (3, 14)) AS cut(a, b) WHERE len(p) >= b)
SELECT phrase, count(*) AS n FROM asked WHERE phrase IN (SELECT g FROM seen) GROUP BY phrase""",
)
def phrase_filter(spark, sf_dir):
    """Of phrases of 1, 3, 7 and 12 words in all lines, those that one source has."""
    rows = words(spark, sf_dir)
    cuts = ((1, 1), (1, 3), (2, 7), (3, 12))
    found = F.array(*[F.when(F.size("segment") >= at + n - 1, F.array_join(F.transform(F.slice("segment", at, n), tx.escape_token), " ")) for at, n in cuts])
    phrases = rows.df.select(F.explode(found).alias("phrase")).where("phrase IS NOT NULL")
    return st.seen_phrases(phrases, rows.filter_texts(["src3"]).df, "phrase").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


@query(
    "missing_characters",
    "SELECT DISTINCT c AS character FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE lang <> 'en') WHERE c <> '' AND c NOT IN (SELECT c2 FROM (SELECT unnest(string_split(text, '')) AS c2 FROM documents WHERE lang = 'en'))",
)
def missing_characters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = docs.where("lang = 'en'").select(F.explode(F.split("text", "")).alias("character")).distinct()
    return st.missing_characters(docs.where("lang <> 'en'"), known)


# --- word alignment ----------------------------------------------------------------------


def _bitext(spark, sf_dir):
    """User and assistant turns, tokenized, with a row number."""
    rows = _align(spark, sf_dir).tokenize().lowercase().filter_nonempty().df
    return rows.withColumn("row_ord", F.col("text_id") * TURNS + F.col("ref"))


def _two_ways(spark, sf_dir):
    """Two alignments of each row, by rules on the words' lengths."""
    rows = _bitext(spark, sf_dir)
    ones = rows.select("text_id", "ref", "target_segment", F.posexplode("source_segment").alias("i", "s"))
    both = ones.select("text_id", "ref", "i", "s", F.posexplode("target_segment").alias("j", "t")).where(F.abs(F.col("i") - F.col("j")) <= 3)
    apart, cell = F.length("s") - F.length("t"), F.struct(F.col("i").alias("source_index"), F.col("j").alias("target_index"))
    chosen = lambda test: F.sort_array(F.collect_list(F.when(test, cell)))
    found = both.groupBy("text_id", "ref").agg(chosen(F.pmod(apart, F.lit(3)) == 0).alias("forward"), chosen(F.pmod(apart, F.lit(4)) < 2).alias("backward"))
    none = F.expr(f"CAST(array() AS {wa.CELL})")
    return rows.join(found, ["text_id", "ref"], "left").withColumns({c: F.coalesce(c, none) for c in ("forward", "backward")})


TWO_WAYS_SQL = f"""
WITH {TURNS_SQL},
bi AS (
  SELECT s.text_id, s.ref, {words_sql("lower(s.text)")} AS sw, {words_sql("lower(t.text)")} AS tw FROM src s JOIN trg t ON s.text_id = t.text_id AND s.ref = t.ref WHERE s.text <> '' AND t.text <> ''),
ij AS (
  SELECT text_id, ref, i, j, length(sw[i + 1]) - length(tw[j + 1]) AS d
  FROM (SELECT *, unnest(range(greatest(0, i - 3), least(len(tw), i + 4))) AS j FROM (SELECT *, unnest(range(0, len(sw))) AS i FROM bi))),
fb AS (SELECT *, ((d % 3) + 3) % 3 = 0 AS f, ((d % 4) + 4) % 4 < 2 AS b FROM ij)
"""


def _two_ways_sql(condition: str) -> str:
    return f"{TWO_WAYS_SQL} SELECT bi.text_id, bi.ref, coalesce(string_agg(i || '-' || j, ' ' ORDER BY i, j) FILTER ({condition}), '') AS pairs FROM bi LEFT JOIN fb ON fb.text_id = bi.text_id AND fb.ref = bi.ref GROUP BY bi.text_id, bi.ref"


def _symmetrized(spark, sf_dir, heuristic):
    found = _two_ways(spark, sf_dir).withColumn("pairs", wa.symmetrize(F.col("forward"), F.col("backward"), heuristic))
    return found.select("text_id", "ref", ro.pairs_to_string(F.col("pairs")).alias("pairs"))


for _name in wa.HEURISTICS[1:]:
    query(f"symmetrize_{_name}", {"union": _two_ways_sql("f OR b"), "intersection": _two_ways_sql("f AND b")}.get(_name))(lambda spark, sf_dir, h=_name: _symmetrized(spark, sf_dir, h))


@query(
    "pairs_with_nulls",
    f"""{TWO_WAYS_SQL},
p AS (
  SELECT text_id, ref, i, j FROM fb WHERE f
  UNION ALL SELECT text_id, ref, i, -1 FROM (SELECT text_id, ref, unnest(range(0, len(sw))) AS i FROM bi) x WHERE NOT EXISTS (SELECT 1 FROM fb WHERE f AND fb.text_id = x.text_id AND fb.ref = x.ref AND fb.i = x.i)
  UNION ALL SELECT text_id, ref, -1, j FROM (SELECT text_id, ref, unnest(range(0, len(tw))) AS j FROM bi) x WHERE NOT EXISTS (SELECT 1 FROM fb WHERE f AND fb.text_id = x.text_id AND fb.ref = x.ref AND fb.j = x.j))
SELECT text_id, ref, string_agg(CASE WHEN i < 0 THEN 'NULL' ELSE i::VARCHAR END || '-' || CASE WHEN j < 0 THEN 'NULL' ELSE j::VARCHAR END, ' ' ORDER BY i, j) AS pairs FROM p GROUP BY text_id, ref""",
)
def pairs_with_nulls(spark, sf_dir):
    found = wa.with_nulls(F.col("forward"), F.size("source_segment"), F.size("target_segment"))
    return _two_ways(spark, sf_dir).select("text_id", "ref", ro.pairs_to_string(found).alias("pairs"))


@query(
    "giza_format",
    f"""{TWO_WAYS_SQL},
w AS (SELECT text_id, ref, unnest(list_concat(['NULL'], sw)) AS word, unnest(range(-1, len(sw))) AS i FROM bi),
free AS (SELECT text_id, ref, -1 AS i, j FROM (SELECT text_id, ref, unnest(range(0, len(tw))) AS j FROM bi) x WHERE NOT EXISTS (SELECT 1 FROM fb WHERE f AND fb.text_id = x.text_id AND fb.ref = x.ref AND fb.j = x.j)),
js AS (SELECT text_id, ref, i, string_agg((j + 1)::VARCHAR || ' ', '' ORDER BY j) AS held FROM (SELECT text_id, ref, i, j FROM fb WHERE f UNION ALL SELECT * FROM free) GROUP BY ALL),
items AS (SELECT text_id, ref, string_agg(word || ' ({{ ' || coalesce(held, '') || '}})', ' ' ORDER BY i) AS line FROM w LEFT JOIN js USING (text_id, ref, i) GROUP BY text_id, ref)
SELECT text_id, ref, array_to_string(tw, ' ') || chr(10) || line || chr(10) AS giza FROM bi JOIN items USING (text_id, ref)""",
)
def giza_format(spark, sf_dir):
    return _two_ways(spark, sf_dir).select("text_id", "ref", wa.to_giza(F.col("source_segment"), F.col("target_segment"), F.col("forward")).alias("giza"))


@query(
    "pairs_strings",
    f"""
WITH {LINES_SQL}, w AS (SELECT text_id, row_ord, {words_sql("line_text")} AS p FROM lines WHERE line_text <> '')
SELECT text_id, row_ord, {DIAGONAL_SQL.format(w="p")} AS pairs,
       array_to_string(list_transform(range(0, least(5, len(p))), lambda i: i::VARCHAR || '-' || (i + 1)::VARCHAR || ':' || (['0', '0.25', '0.5', '0.75', '1'])[i + 1]), ' ') AS scored FROM w
""",
)
def pairs_strings(spark, sf_dir):
    rows = diagonal(lines(spark, sf_dir)).df
    scored = ro.pairs_to_string(F.col("pairs"), scores=True)
    return rows.select("text_id", "row_ord", ro.pairs_to_string(ro.pairs_from_string(scored)).alias("pairs"), ro.pairs_to_string(ro.pairs_from_string(scored), scores=True).alias("scored"))


IBM1_SQL = f"""
WITH {TURNS_SQL},
bi AS (
  SELECT s.text_id * 1048576 + s.ref AS row, list_concat(['NULL'], {words_sql("lower(s.text)")}) AS sw, {words_sql("lower(t.text)")} AS tw
  FROM src s JOIN trg t ON s.text_id = t.text_id AND s.ref = t.ref WHERE s.text <> '' AND t.text <> ''),
co AS (SELECT row, j, tw[j] AS target, unnest(sw) AS source, len(sw) AS m FROM (SELECT *, unnest(range(1, len(tw) + 1)) AS j FROM bi)),
counts AS (SELECT source, target, sum(1.0::DOUBLE / m) AS c FROM co GROUP BY source, target)
"""


@query("ibm1_one_iteration", f"{IBM1_SQL} SELECT source, target, round(ln(c / sum(c) OVER (PARTITION BY source)), 6) AS log_probability FROM counts")
def ibm1_one_iteration(spark, sf_dir):
    return wa.ibm1(_bitext(spark, sf_dir), iterations=1).select("source", "target", F.round(F.log("probability"), 6).alias("log_probability"))


def _best(spark, sf_dir):
    """Rows and the best source word for each of their target words, after three rounds with a prior for the diagonal."""
    rows = _bitext(spark, sf_dir)
    return rows, wa.best_words(rows, iterations=3, diagonal=4.0)


def _trained_sql(rounds: int) -> str:
    """Three rounds of expectation maximization with a prior for the diagonal, as common table expressions."""
    parts = [f"""
WITH {TURNS_SQL},
bi AS (
  SELECT s.text_id * 1048576 + s.ref AS row, {words_sql("lower(s.text)")} AS sw, {words_sql("lower(t.text)")} AS tw
  FROM src s JOIN trg t ON s.text_id = t.text_id AND s.ref = t.ref WHERE s.text <> '' AND t.text <> ''),
co AS (
  SELECT row, j, i, tw[j + 1] AS target, CASE WHEN i < 0 THEN 'NULL' ELSE sw[i + 1] END AS source, exp(-4.0::DOUBLE * abs((i + 1)::DOUBLE / len(sw) - (j + 1)::DOUBLE / len(tw))) AS near
  FROM (SELECT *, unnest(range(-1, len(sw))) AS i FROM (SELECT *, unnest(range(0, len(tw))) AS j FROM bi))),
pri AS (SELECT row, j, target, source, CASE WHEN i < 0 THEN 0.08::DOUBLE ELSE 0.92::DOUBLE * near / sum(near) FILTER (i >= 0) OVER (PARTITION BY row, j) END AS prior FROM co),
pairs AS (SELECT row, j, target, source, sum(prior) AS prior FROM pri GROUP BY ALL)"""]
    for k in range(1, rounds + 1):
        share = "SELECT *, prior AS share FROM pairs" if k == 1 else f"SELECT pairs.*, prior * probability AS share FROM pairs JOIN lex{k - 1} USING (source, target)"
        parts.append(f"w{k} AS ({share}), c{k} AS (SELECT source, target, sum(part) AS c FROM (SELECT source, target, share / sum(share) OVER (PARTITION BY row, j) AS part FROM w{k}) GROUP BY ALL), lex{k} AS (SELECT source, target, c / sum(c) OVER (PARTITION BY source) AS probability FROM c{k})")
    return ",\n".join(parts)


@query("align_corpus")
def align_corpus(spark, sf_dir):
    return _best(spark, sf_dir)[1].select("row_ord", ro.pairs_to_string(wa.best_pairs(F.col("best"))).alias("pairs"))


@query("word_confidences", f"{_trained_sql(3)} SELECT row AS row_ord, CAST(j AS INT) AS j, target, round(max(probability), 6) AS confidence FROM pairs JOIN lex3 USING (source, target) GROUP BY row, j, target")
def word_confidences(spark, sf_dir):
    rows, best = _best(spark, sf_dir)
    each = rows.select("row_ord", "target_segment").join(best, "row_ord").select("row_ord", F.posexplode(F.arrays_zip("target_segment", "best")).alias("j", "x"))
    return rounded(each.select("row_ord", "j", F.col("x.target_segment").alias("target"), F.col("x.best.probability").alias("confidence")), "confidence")


@query("average_translation_score")
def average_translation_score(spark, sf_dir):
    pairs = _best(spark, sf_dir)[1].select("row_ord", F.explode(F.filter("best", lambda x: x["i"] >= 0)).alias("x"))
    return rounded(wa.average_score(pairs.select("row_ord", F.col("x.probability").alias("translation_score"))), "score")


@query("phrase_table")
def phrase_table(spark, sf_dir):
    return wa.extract_phrases(_two_ways(spark, sf_dir).withColumn("pairs", wa.symmetrize(F.col("forward"), F.col("backward"), "intersection")), longest=4)


# --- scripture ---------------------------------------------------------------------------

REFS_SQL = "refs AS (SELECT doc_id, source, doc_id % 66 + 1 AS b, n_chars % 150 + 1 AS c, doc_id % 176 + 1 AS v FROM documents)"


def _refs(spark, sf_dir):
    """References made of documents' numbers."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", (F.col("doc_id") % 66 + 1).alias("b"), (F.col("n_chars") % 150 + 1).alias("c"), (F.col("doc_id") % 176 + 1).alias("v"))


BOOKS_SQL = "[" + ", ".join(f"'{b}'" for b in sc.BOOKS) + "]"


@query(
    "verse_numbers",
    f"WITH {REFS_SQL} SELECT doc_id, b * 1000000 + c * 1000 + v AS number, {BOOKS_SQL}[b] || ' ' || c || ':' || v AS ref, b AS book_num, c AS chapter, v AS verse, b < 40 AS old FROM refs",
)
def verse_numbers(spark, sf_dir):
    rows = _refs(spark, sf_dir).withColumn("ref", F.concat(sc.book_id(F.col("b").cast("int")), F.lit(" "), F.col("c"), F.lit(":"), F.col("v")))
    parsed = rows.withColumn("p", sc.parse(F.col("ref"))).withColumn("number", sc.pack(F.col("p.book_num"), F.col("p.chapter"), F.col("p.verse_num")).cast("long"))
    books = F.broadcast(sc.canon(spark).select(F.col("book_num").alias("n"), (F.col("testament") == "OT").alias("old")))
    place = sc.unpack(F.col("number"))
    return parsed.join(books, F.col("p.book_num") == F.col("n")).select("doc_id", "number", "ref", place["book_num"].cast("long").alias("book_num"), place["chapter"].cast("long").alias("chapter"), place["verse"].cast("long").alias("verse"), "old")


@query(
    "bridge_expand",
    f"WITH {REFS_SQL} SELECT doc_id, v || '-' || (v + 2) || 'a,' || (v + 5) AS verse, array_to_string(list_transform([v, v + 1, v + 2, v + 5], lambda x: x::VARCHAR), ' ') AS verses, v || '-' || (v + 3) || ',' || (v + 5) AS merged, true AS overlaps FROM refs",
)
def bridge_expand(spark, sf_dir):
    rows = _refs(spark, sf_dir).withColumn("verse", F.concat(F.col("v"), F.lit("-"), F.col("v") + 2, F.lit("a,"), F.col("v") + 5))
    other = F.concat(F.col("v") + 2, F.lit("-"), F.col("v") + 3)
    listed = F.array_join(F.transform(sc.all_verses(F.col("verse")), lambda x: x.cast("string")), " ")
    return rows.select("doc_id", "verse", listed.alias("verses"), sc.merged_verses(F.col("verse"), other).alias("merged"), sc.overlapping(F.col("verse"), other).alias("overlaps"))


@query(
    "vref_extract",
    f"""
WITH {LINES_SQL},
verses AS (SELECT DISTINCT row_ord AS number FROM lines),
held AS (SELECT row_ord, line % 4 IN (1, 2) AS rng, line % 4 = 1 AS beg, CASE WHEN line % 4 = 2 THEN '' ELSE line_text END AS txt FROM lines WHERE line_text <> '')
SELECT number, CASE WHEN rng AND NOT beg AND txt = '' THEN '<range>' ELSE coalesce(txt, '') END AS line FROM verses LEFT JOIN held ON number = row_ord
""",
)
def vref_extract(spark, sf_dir):
    rows = lines(spark, sf_dir).df.select(F.col("row_ord").alias("number"), "row_ord", "line", joined("segment").alias("text"))
    place = F.col("line") % 4
    held = rows.where("text <> ''").select("number", "row_ord", F.when(place == 2, "").otherwise(F.col("text")).alias("text"), place.isin(1, 2).alias("in_range"), (place == 1).alias("range_start"))
    return sc.verse_lines(rows.select("number").distinct(), held)


@query(
    "verse_diagnostics",
    f"""
WITH {LINES_SQL},
e AS (SELECT row_ord AS number FROM lines WHERE line_text <> ''), o AS (SELECT row_ord AS number FROM lines WHERE lang <> 'de'),
odd AS (SELECT coalesce(e.number, o.number) AS number, CASE WHEN o.number IS NULL THEN 'missing' ELSE 'extra' END AS kind FROM e FULL JOIN o ON e.number = o.number WHERE e.number IS NULL OR o.number IS NULL),
run AS (SELECT *, number - row_number() OVER (PARTITION BY kind, number // 1000 ORDER BY number) AS r FROM odd)
SELECT kind, min(number) AS first, max(number) AS last FROM run GROUP BY kind, number // 1000, r
""",
)
def verse_diagnostics(spark, sf_dir):
    rows = lines(spark, sf_dir)
    number = F.col("row_ord").alias("number")
    return sc.diagnose(rows.filter_nonempty().df.select(number), rows.filter("lang <> 'de'").df.select(number))


def _made_versification() -> sc.Versification:
    """Fifty chapters a book, of lengths that follow from their numbers; the fifth verse of each seventh chapter is not there."""
    chapters = {(b, c): (b + c) % 40 + 100 for b in range(1, 67) for c in range(1, 51)}
    return sc.Versification("made", chapters, [], frozenset(b * 1_000_000 + 7005 for b in range(1, 67)), [])


@query(
    "valid_status",
    f"""WITH {REFS_SQL}
SELECT doc_id, v || ',' || (v + doc_id % 3) AS verse,
       CASE WHEN c > 50 OR v > (b + c) % 40 + 100 OR (c = 7 AND v = 5) THEN 'out_of_range' WHEN doc_id % 3 > 0 AND (v + doc_id % 3 > (b + c) % 40 + 100 OR (c = 7 AND v + doc_id % 3 = 5)) THEN 'out_of_range'
            WHEN doc_id % 3 = 0 THEN 'verse_repeated' ELSE 'valid' END AS status FROM refs""",
)
def valid_status(spark, sf_dir):
    """Of two verses each, which may be one twice."""
    rows = _refs(spark, sf_dir).select("doc_id", F.col("b").cast("int").alias("book_num"), F.col("c").cast("int").alias("chapter"), F.concat("v", F.lit(","), F.col("v") + F.col("doc_id") % 3).alias("verse"))
    return sc.valid_status(rows, _made_versification()).select("doc_id", "verse", "status")


# --- books -------------------------------------------------------------------------------

CLEAN_SQL = "trim(regexp_replace(regexp_replace(line_text, '[^A-Za-z0-9., ]', '', 'g'), ' +', ' ', 'g'), ' ')"
BOOK_SQL = f"""
WITH {LINES_SQL}, v AS (SELECT doc_id, line + 1 AS n, {CLEAN_SQL} AS t FROM lines)
"""


def _books(spark, sf_dir):
    """Each document as a marked-up book: a chapter whose verses are the lines."""
    text = F.trim(F.regexp_replace(F.regexp_replace(joined("segment"), "[^A-Za-z0-9., ]", ""), " +", " "))
    verses = lines(spark, sf_dir).df.select("doc_id", F.struct(F.col("line").cast("int").alias("line"), F.concat(F.lit("\\v "), F.col("line") + 1, F.lit(" "), text).alias("t")).alias("v"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["t"]), "\r\n")
    return verses.groupBy("doc_id").agg(F.concat(F.lit("\\id GEN\r\n\\c 1\r\n\\p\r\n"), body, F.lit("\r\n")).alias("content")).select(F.col("doc_id").cast("string").alias("path"), "content")


@query("usfm_verses", f"{BOOK_SQL} SELECT doc_id::VARCHAR AS path, 'GEN' AS book, 1 AS chapter, n::VARCHAR AS verse, t AS text FROM v WHERE t <> ''")
def usfm_verses(spark, sf_dir):
    found = usfm.located(usfm.tokenized(_books(spark, sf_dir))).where("type = 'text' AND verse <> '0'")
    return found.select("path", "book", "chapter", "verse", F.trim("text").alias("text"))


@query(
    "usfm_rewrite",
    f"""{BOOK_SQL}
SELECT doc_id::VARCHAR AS path, '\\id GEN' || chr(13) || chr(10) || '\\c 1' || chr(13) || chr(10) || '\\p' || chr(13) || chr(10)
       || string_agg(rtrim('\\v ' || n || ' ' || CASE WHEN t <> '' THEN 'Verse ' || length(t) ELSE '' END), chr(13) || chr(10) ORDER BY n) || chr(13) || chr(10) AS content
FROM v GROUP BY doc_id""",
)
def usfm_rewrite(spark, sf_dir):
    """Books with a new text for each verse that has one."""
    tokens = usfm.tokenized(_books(spark, sf_dir))
    # Books of one code: each is rewritten by its own verses, so the path stands in for the code.
    own = tokens.withColumn("data", F.when(F.col("type") == "book", F.col("path")).otherwise(F.col("data")))
    texts = usfm.located(own).where("type = 'text' AND verse <> '0'").select("book", "chapter", "verse", F.concat(F.lit("Verse "), F.length(F.trim("text"))).alias("text"))
    rewritten = usfm_update.update_text(own, texts, text="new")
    named = rewritten.withColumn("data", F.when(F.col("type") == "book", F.lit("GEN")).otherwise(F.col("data")))
    return usfm.to_text(named)


def _headed_books(spark, sf_dir):
    """Each document as a book with a heading and a paragraph before every third line's verse, and a note in each; the path is the book's code."""
    text = F.trim(F.regexp_replace(F.regexp_replace(joined("segment"), "[^A-Za-z0-9., ]", ""), " +", " "))
    n = F.col("line") + 1
    line = F.concat(F.when(n % 3 == 1, F.concat(F.lit("\\s Part "), n, F.lit("\r\n\\p\r\n"))).otherwise(""), F.lit("\\v "), n, F.lit(" "), text, F.lit(" \\f + \\ft N "), n, F.lit("\\f*"))
    verses = lines(spark, sf_dir).df.select("doc_id", F.struct(F.col("line").cast("int").alias("line"), line.alias("t")).alias("v"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["t"]), "\r\n")
    code = F.col("doc_id").cast("string")
    return verses.groupBy("doc_id").agg(body.alias("body")).select(code.alias("path"), F.concat(F.lit("\\id "), code, F.lit("\r\n\\c 1\r\n"), "body", F.lit("\r\n")).alias("content"))


@query(
    "usfm_rows",
    f"""{BOOK_SQL}
SELECT doc_id::VARCHAR AS path, n::VARCHAR AS verse, '' AS part, 'verse' AS kind, t AS text FROM v
UNION ALL SELECT doc_id::VARCHAR, (n - 1)::VARCHAR, CASE WHEN n = 1 THEN '1:s' ELSE '2:s' END, 'other', 'Part ' || n FROM v WHERE n % 3 = 1
UNION ALL SELECT doc_id::VARCHAR, '0', '2:p', 'other', '' FROM v WHERE n = 1""",
)
def usfm_rows(spark, sf_dir):
    """Verses and headings of books, by the events of their marks; notes are in neither, but count as elements of a verse."""
    rows = usfm_events.text_rows(usfm_events.placed(usfm.tokenized(_headed_books(spark, sf_dir))))
    return rows.select("path", "verse", "part", "kind", "text")


@query(
    "usfm_blocks",
    f"""{BOOK_SQL}
SELECT doc_id::VARCHAR AS path, '\\id ' || doc_id || chr(13) || chr(10) || '\\c 1' || chr(13) || chr(10)
       || string_agg(CASE WHEN n % 3 = 1 THEN '\\s ' || CASE WHEN n % 6 = 1 THEN 'New part ' ELSE 'Part ' END || n || chr(13) || chr(10) || '\\p' || chr(13) || chr(10) ELSE '' END
                     || '\\v ' || n || ' ' || CASE WHEN n % 2 = 0 THEN 'New ' || n || ' ' WHEN t <> '' THEN t || ' ' ELSE '' END || '\\f + \\ft N ' || n || '\\f*', chr(13) || chr(10) ORDER BY n) || chr(13) || chr(10) AS content
FROM v GROUP BY doc_id""",
)
def usfm_blocks(spark, sf_dir):
    """Books with new texts in some verses and headings, block by block; notes stay."""
    tokens = usfm.tokenized(_headed_books(spark, sf_dir))
    n = F.col("line") + 1
    made = lines(spark, sf_dir).df.select(F.col("doc_id").cast("string").alias("book"), F.lit(1).alias("chapter"), n.alias("n"))
    verses = made.where("n % 2 = 0").select("book", "chapter", F.col("n").cast("string").alias("verse"), F.lit("").alias("part"), F.concat(F.lit("New "), "n").alias("text"))
    headings = made.where("n % 6 = 1").select("book", "chapter", (F.col("n") - 1).cast("string").alias("verse"), F.when(F.col("n") == 1, "1:s").otherwise("2:s").alias("part"), F.concat(F.lit("New part "), "n").alias("text"))
    return usfm.to_text(usfm_update.update_text(tokens, verses.unionByName(headings), text="new"))


@query(
    "usfm_markers",
    f"""{BOOK_SQL}, w AS (SELECT doc_id, n, list_filter(string_split(t, ' '), lambda x: x <> '') AS ws FROM v), k AS (SELECT *, (len(ws) + 1) // 2 AS h FROM w),
m AS (SELECT doc_id, n, rtrim('\\v ' || n || ' ' || array_to_string(list_transform(ws[:h], lambda x: 'w' || length(x)), ' ')
       || CASE WHEN len(ws) > h THEN ' \\nd ' || array_to_string(list_transform(ws[h + 1:], lambda x: 'w' || length(x)), ' ') || '\\nd*' ELSE '' END) AS verse FROM k)
SELECT doc_id::VARCHAR AS path, '\\id ' || doc_id || chr(13) || chr(10) || '\\c 1' || chr(13) || chr(10) || string_agg(verse, chr(13) || chr(10) ORDER BY n) || chr(13) || chr(10) AS content FROM m GROUP BY doc_id""",
)
def usfm_markers(spark, sf_dir):
    """Books of a verse for each line, whose second half has a style; each new text has a word for a word, and the style goes along."""
    text = F.trim(F.regexp_replace(F.regexp_replace(joined("segment"), "[^A-Za-z0-9., ]", ""), " +", " "))
    words = F.filter(F.split(text, " "), lambda x: x != "")
    made = lines(spark, sf_dir).df.select(F.col("doc_id").cast("string").alias("book"), (F.col("line") + 1).cast("int").alias("n"), words.alias("ws")).withColumn("h", F.floor((F.size("ws") + 1) / 2).cast("int"))
    rest = F.slice("ws", F.col("h") + 1, F.size("ws"))
    body = F.concat(F.lit("\\v "), "n", F.lit(" "), F.array_join(F.slice("ws", F.lit(1), F.col("h")), " "), F.when(F.size(rest) > 0, F.concat(F.lit(" \\nd "), F.array_join(rest, " "), F.lit("\\nd*"))).otherwise(""))
    verses = made.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", body.alias("t")))), lambda v: v["t"]), "\r\n").alias("body"))
    books = verses.select(F.col("book").alias("path"), F.concat(F.lit("\\id "), "book", F.lit("\r\n\\c 1\r\n"), "body", F.lit("\r\n")).alias("content"))
    new = F.transform("ws", lambda x: F.concat(F.lit("w"), F.length(x)))
    pairs = F.transform(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: F.struct(i.alias("source"), i.alias("target")))
    updates = made.where(F.size("ws") > 0).select("book", F.lit(1).alias("chapter"), F.col("n").cast("string").alias("verse"), F.array_join(new, " ").alias("text"), F.struct(F.col("ws").alias("source"), new.alias("target"), pairs.alias("pairs")).alias("info"))
    return usfm.to_text(usfm_update.update_text(usfm.tokenized(books), updates, text="new", characters="preserve", handlers=[markers.place_markers]))


@query(
    "segment_boundaries",
    f"""WITH RECURSIVE {LINES_SQL}, s AS (SELECT doc_id, list(lower(regexp_replace(line_text, '[^A-Za-z0-9., ]', '', 'g')) ORDER BY line) AS a FROM lines GROUP BY doc_id),
r AS (SELECT doc_id, a, 1 AS i, a[1] AS cur, []::VARCHAR[] AS done FROM s
      UNION ALL SELECT doc_id, a, i + 1,
          a[i + 1][length(regexp_extract(a[i + 1], '^[ ,.]*')) + length(regexp_extract(a[i + 1][length(regexp_extract(a[i + 1], '^[ ,.]*')) + 1:], '^[a-z][A-Za-z0-9_]+(\\s+[A-Za-z0-9_]+)?(\\s+[A-Za-z0-9_]+)?[.,]\\s*')) + 1:],
          list_append(done, cur || regexp_extract(a[i + 1], '^[ ,.]*') || regexp_extract(a[i + 1][length(regexp_extract(a[i + 1], '^[ ,.]*')) + 1:], '^[a-z][A-Za-z0-9_]+(\\s+[A-Za-z0-9_]+)?(\\s+[A-Za-z0-9_]+)?[.,]\\s*'))
      FROM r WHERE i < len(a))
SELECT doc_id, array_to_string(list_append(done, cur), '|') AS segments FROM r WHERE i = len(a)""",
)
def segment_boundaries(spark, sf_dir):
    """The lines of a document as segments in a row whose boundaries move to the end of a clause; capital letters are made small first."""
    text = F.lower(F.regexp_replace(joined("segment"), "[^A-Za-z0-9., ]", ""))
    held = lines(spark, sf_dir).df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("t")))), lambda x: x["t"]).alias("a"))
    return held.select("doc_id", F.array_join(boundaries.moved_all(F.col("a")), "|").alias("segments"))


@query(
    "prefix_completions",
    f"""WITH {LINES_SQL}, w AS (SELECT doc_id, line, list_filter(string_split(line_text, ' '), lambda x: x <> '') AS ws FROM lines),
p AS (SELECT *, least(len(ws), 8) AS k, list_transform(ws, lambda x, i: CASE WHEN i <= 8 AND i % 4 = 0 THEN 'x' || x ELSE x END) AS t FROM w)
SELECT doc_id, line, array_to_string(t, ' ') AS text, k AS n_both, round(-(len(ws) + k // 4) + k * ln(0.8), 3) AS score FROM p""",
)
def prefix_completions(spark, sf_dir):
    """Each line as a graph with a dearer word beside every one, completed behind a prefix that has every fourth of those."""
    words = F.filter(F.split("segment_text", " "), lambda x: x != "")
    made = lines(spark, sf_dir).df.select("doc_id", F.col("line").cast("int").alias("line"), joined("segment").alias("segment_text")).withColumn("ws", words)
    arc = lambda i, word, score: F.struct(i.cast("int").alias("prev"), (i + 1).cast("int").alias("next"), F.lit(score).alias("score"), F.array(word).alias("words"), F.array(F.lit(0.5)).alias("confidences"), i.cast("int").alias("source_start"), (i + 1).cast("int").alias("source_end"))
    arcs = F.flatten(F.transform("ws", lambda x, i: F.array(arc(i, x, -1.0), arc(i, F.concat(F.lit("x"), x), -2.0)))).cast(wg.ARCS)
    prefix = F.transform(F.slice("ws", 1, 8), lambda x, i: F.when(i % 4 == 3, F.concat(F.lit("x"), x)).otherwise(x))
    graphs = made.select("doc_id", "line", arcs.alias("arcs"), F.array(F.size("ws")).alias("finals"), prefix.alias("prefix"), F.lit(True).alias("complete"))
    best = wg.completions(graphs).select("doc_id", "line", F.get("completions", 0).alias("c"))
    both = F.size(F.filter("c.tokens", lambda t: t["origin"] == "both"))
    return best.select("doc_id", "line", F.array_join(F.transform("c.tokens", lambda t: t["token"]), " ").alias("text"), both.alias("n_both"), F.round("c.score", 3).alias("score"))


@query(
    "usfm_diagnostics",
    f"""{BOOK_SQL}, c AS (SELECT doc_id, max(n) AS n FROM v GROUP BY doc_id)
SELECT doc_id::VARCHAR AS path, 'missing' AS kind, CASE WHEN n < 4 THEN 'GEN 1:4-5' ELSE 'GEN 1:5' END AS reference, (n + 3)::VARCHAR AS lines, CASE WHEN n < 4 THEN 2 ELSE 1 END AS affected FROM c WHERE n < 5
UNION ALL SELECT doc_id::VARCHAR, 'missing', 'GEN 1:2', '4', 1 FROM c WHERE n < 2
UNION ALL SELECT doc_id::VARCHAR, 'extra', 'GEN 1:3', '6', 1 FROM c WHERE n >= 3
UNION ALL SELECT doc_id::VARCHAR, 'extra', CASE WHEN n = 6 THEN 'GEN 1:6' ELSE 'GEN 1:6-' || n END, array_to_string(range(9, n + 4), ','), (n - 5)::INTEGER FROM c WHERE n >= 6
UNION ALL SELECT doc_id::VARCHAR, 'incorrect_segment', 'GEN 1:2', '5', 1 FROM c WHERE n >= 2""",
)
def usfm_diagnostics(spark, sf_dir):
    """Books of a verse for each line, by a versification of five verses of which one is excluded and one has segments."""
    vrs = sc.parse_versification("GEN 1:5\n-GEN 1:3\n*GEN 1:2,-,a,b\n", "made")
    found = usfm_analysis.analyse(usfm.tokenized(_books(spark, sf_dir)), vrs)
    return found.withColumn("lines", F.array_join(F.transform("lines", lambda n: n.cast("string")), ","))


# --- quotation marks ---------------------------------------------------------------------


def _quoted(spark, sf_dir):
    """Documents with marks put around every third word, so that there is something to find."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"([a-z]+) ([a-z]+) ([a-z]+)", "$1 “$2” ‘$3’")
    return qu.find_marks(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), F.col("text"), "doc_id")


QUOTED_SQL = f"""
WITH q AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([a-z]+) ([a-z]+) ([a-z]+)', '\\1 “\\2” ‘\\3’', 'g') AS t FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(t, '{qu.PATTERN}')) AS mark FROM q)
"""


@query("quote_marks", f"{QUOTED_SQL} SELECT mark, count(*) AS n, count(DISTINCT doc_id) AS docs FROM m GROUP BY mark")
def quote_marks(spark, sf_dir):
    return _quoted(spark, sf_dir).groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("quote_conventions")
def quote_conventions(spark, sf_dir):
    placed = qu.nested(qu.marked_context(_quoted(spark, sf_dir)), "doc_id")
    return rounded(qu.detect(qu.similarities(qu.tabulate(placed, "doc_id"), "doc_id"), "doc_id"), "score")


def _segments(spark, sf_dir):
    """Lines as segments of their documents, with marks put around words of every three."""
    text = F.regexp_replace(joined("segment"), r"([a-z]+) ([a-z]+) ([a-z]+)", "“$1 ‘$2’” $3")
    return lines(spark, sf_dir).df.select("doc_id", F.col("line").cast("long").alias("ord"), F.col("line").cast("string").alias("verse"), F.lit(True).alias("paragraph"), F.lit(False).alias("embedded"), text.alias("text"))


@query(
    "quote_rewrite",
    f"""
WITH {LINES_SQL}, q AS (SELECT doc_id, line, regexp_replace(line_text, '([a-z]+) ([a-z]+) ([a-z]+)', '“\\1 ‘\\2’” \\3', 'g') AS t FROM lines)
SELECT doc_id, line AS ord, translate(t, '“”‘’', '«»‹›') AS text, 'full' AS strategy FROM q""",
)
def quote_rewrite(spark, sf_dir):
    return qr.rewritten(_segments(spark, sf_dir), "standard_english", "standard_french", "doc_id").drop("verse")


@query("quote_resolution")
def quote_resolution(spark, sf_dir):
    own = qr.Conventions(["standard_english"])
    found = qr.resolve(qr.placed_marks(_segments(spark, sf_dir), own, "doc_id"), own, "doc_id")
    return found.select("doc_id", F.size("found").alias("marks"), F.array_max(F.transform("found", lambda m: m["depth"])).alias("deepest"), F.array_join("issues", ",").alias("issues"))


@query("quote_candidates")
def quote_candidates(spark, sf_dir):
    """Conventions that the marks of each source fit."""
    every, rows = qr.Conventions(), _segments(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("text_id"))
    rows = rows.join(sources, "doc_id")
    marks = qr.placed_marks(rows.drop("text_id"), every, "doc_id").join(sources, "doc_id")
    return qr.compatible_conventions(qr.mark_statistics(rows, marks, every, "text_id", "doc_id"), every, "text_id")


# --- sequences -----------------------------------------------------------------------------


@query(
    "edit_distance",
    f"""WITH {TURNS_SQL}
SELECT s.text_id, s.ref, levenshtein(regexp_replace(lower(s.text), '[^a-z ]', '', 'g'), regexp_replace(lower(t.text), '[^a-z ]', '', 'g')) AS distance
FROM src s JOIN trg t ON s.text_id = t.text_id AND s.ref = t.ref""",
)
def edit_distance(spark, sf_dir):
    """Between the letters of a turn and of its answer."""
    letters = lambda c: F.regexp_replace(F.lower(joined(c)), "[^a-z ]", "")
    return _align(spark, sf_dir).df.select("text_id", "ref", sq.edit_distance(letters("source_segment"), letters("target_segment")).cast("long").alias("distance"))


@query("edit_operations")
def edit_operations(spark, sf_dir):
    """From the words of a turn to those of its answer."""
    found = _bitext(spark, sf_dir).withColumn("e", sq.edit_operations(F.col("source_segment"), F.col("target_segment")))
    return found.select("text_id", "ref", F.col("e.cost").alias("cost"), F.col("e.operations").alias("operations"))


@query("pairwise_alignment")
def pairwise_alignment(spark, sf_dir):
    found = _bitext(spark, sf_dir).withColumn("x", sq.aligned(F.col("source_segment"), F.col("target_segment"), "local", sq.Scores(mismatch=-50)))
    return found.select("text_id", "ref", F.col("x.score").alias("score"), F.col("x.normalized").alias("normalized"), F.size("x.columns").alias("columns"))


def _distances(spark, sf_dir):
    """Between the turns of each conversation, the edit distance over the longer length."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", F.concat("role", F.lit(" "), F.col("turn")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    other = talk.select("conv_id", F.col("name").alias("b"), F.col("text").alias("other"))
    apart = F.levenshtein("text", "other") / F.greatest(F.length("text"), F.length("other"), F.lit(1))
    return talk.withColumnRenamed("name", "a").join(other, "conv_id").where("a < b").select("conv_id", "a", "b", apart.alias("distance"))


@query("cluster_upgma")
def cluster_upgma(spark, sf_dir):
    return rounded(sq.cluster_trees(_distances(spark, sf_dir), "conv_id"), "length")


@query("cluster_neighbor_joining")
def cluster_neighbor_joining(spark, sf_dir):
    return rounded(sq.cluster_trees(_distances(spark, sf_dir), "conv_id", "neighbor_joining"), "length")


@query("cluster_flat")
def cluster_flat(spark, sf_dir):
    return sq.flat_clusters(_distances(spark, sf_dir), "conv_id", 0.5)


# --- flagship ----------------------------------------------------------------------------


@query(
    "dialog_words",
    f"""
WITH {TURNS_SQL}
SELECT s.text_id, count(*) AS n, CAST(sum(len({words_sql("lower(s.text)")})) AS BIGINT) AS source_words, CAST(sum(len({words_sql("lower(t.text)")})) AS BIGINT) AS target_words
FROM src s JOIN trg t ON s.text_id = t.text_id AND s.ref = t.ref WHERE s.text <> '' AND t.text <> '' GROUP BY s.text_id
""",
)
def dialog_words(spark, sf_dir):
    rows = _align(spark, sf_dir).tokenize("whitespace").lowercase().filter_nonempty()
    return rows.df.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("source_segment")).alias("source_words"), F.sum(F.size("target_segment")).alias("target_words"))
