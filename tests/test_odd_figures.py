"""Queries beside their SQL on small tables with odd figures."""

import math
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from heddle.functions.vectors import cosine
from heddle.operators import ann, chunking, lexical, search


def shown(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value) if isinstance(value, float) else str(value)


@pytest.fixture
def beside(spark, tmp_path):
    """Asserts that a query has its SQL's rows over tables that are given as SQL."""

    def check(name, **tables):
        con = duckdb.connect()
        for table, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet'")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        frame = entry.queries()[name](spark, str(tmp_path))
        cursor = con.execute(entry.oracle_sql()[name])
        at = [[d[0] for d in cursor.description].index(c) for c in frame.columns]
        want = Counter(tuple(shown(r[i]) for i in at) for r in cursor.fetchall())
        got = Counter(tuple(shown(v) for v in r) for r in frame.collect())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])

    return check


EVENTS = """SELECT id::BIGINT AS event_id, TIMESTAMP '2024-01-01' AS ts, id::BIGINT AS user_id, 'view' AS event_type, v::DOUBLE AS value, '{}' AS props
  FROM (VALUES (2794292, 1.43), (3594952, 42.91), (3799982, 0.01), (21488, 0), (600, 0), (0, 0), (7, 29.27)) e(id, v)"""


@pytest.mark.parametrize("name", ["metric_log", "model_calls"])
def test_throughput_of_no_time_and_of_large_counts(beside, name):
    beside(name, events=EVENTS)


def test_equal_distances_are_on_one_side_of_the_threshold(spark):
    """Parallel vectors are at no distance, whatever their lengths are."""
    rows = [(n, [float(n), float(2 * n), 3.0 * n], [7.0 * n, 14.0 * n, 21.0 * n]) for n in range(1, 200)]
    likeness = spark.createDataFrame(rows, "n int, a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")))
    assert {r[0] for r in likeness.collect()} == {1.0}


def test_sentences_are_split_once_however_many_there_are(spark):
    """A text of 4,000 sentences with blank pieces: work for each of them that splits the whole text anew takes minutes."""
    text = "\n\n" + "It is so. \n\n  \n\nAnd so it is! " * 2000
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string").select("text", chunking.sentences(F.col("text")).alias("p"))
    began = time.monotonic()
    row = docs.select("text", "p", chunking.locate_pieces(F.col("text"), F.col("p")).alias("at")).first()
    assert time.monotonic() - began < 20
    assert "".join(row.p) == text and len(row.p) == 4000
    assert all(text.startswith(p, at) for p, at in zip(row.p, row["at"], strict=True))


def test_index_of_many_copies_meets_in_slices(spark, monkeypatch):
    """Places of more points than a slice holds: the same answers as the exact scan, and no row for each pair."""
    monkeypatch.setattr(ann, "SLICE", 64)
    rows = [(n, [1.0, 2.0, 3.0, 4.0] if n % 2 else [float(n % 7) + 1, float(n % 11), -float(n % 5), 2.0]) for n in range(600)]
    points = spark.createDataFrame([*rows, (600, [0.0] * 4), (601, None)], "chunk_id long, embedding array<float>")
    asked = points.where("chunk_id % 4 = 1").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    planes = ann.Planes(4, tables=8, planes=3)
    found = ann.search(ann.index(points, planes), asked, planes, 5)
    exact = search.dense_search_batch(points, asked, 5)
    named = lambda df, i: {(r["query_id"], r["rank"], r[i]) for r in df.collect()}
    assert named(found, "id") == named(exact, "chunk_id")
    assert "CoGroup" in found._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_without_a_shuffle_of_their_rows(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "é É x"), (None, "a a")], "doc_id int, text string")
    rows = lexical.term_counts(docs)
    assert {tuple(r) for r in rows.collect()} == {(1, 3, "a", 1), (1, 3, "b", 2), (4, 3, "é", 2), (4, 3, "x", 1), (None, 2, "a", 2)}
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    twice = lexical.term_counts(docs.unionByName(docs))
    assert {(r.doc_id, r.term, r.tf) for r in twice.collect()} == {(1, "a", 2), (1, "b", 4), (4, "é", 4), (4, "x", 2), (None, "a", 4)}


@pytest.mark.parametrize("strategy", ["fixed", "recursive"])
def test_pieces_carry_their_place(spark, strategy):
    blocks = spark.createDataFrame([(1, 0, "heading", 1, "H"), (1, 1, "text", None, "a b c"), (1, 2, "text", None, "d")], "doc_id int, ord int, kind string, level int, text string")
    rows, _ = chunking.chunk(chunking.segment(blocks), strategy, 3)
    assert {h for r in rows.collect() for h in r.headings} == {"H"}
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
