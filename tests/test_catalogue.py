"""Every registered query with SQL against DuckDB on the smallest tables, and that the others run."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from segmill.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def same(frame, result):
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    order = [names.index(c) for c in frame.columns]
    flat = lambda v: round(v, 5) if isinstance(v, float) else v
    assert Counter(tuple(map(flat, r)) for r in frame.collect()) == Counter(tuple(flat(r[i]) for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    same(entry.queries()[name](spark, SF), duck.execute(entry.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from segmill.streaming.rows import tokenized_stream, windowed_frequency

    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", F.concat_ws(" ", "event_type", F.lit("X")).alias("text"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_frequency(tokenized_stream(stream), "ts", "1 hour").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 2 * events.count()
