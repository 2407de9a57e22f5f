"""The approximate index, JSON rows, readings, crops, stores, timings and the shell by small cases."""

import json
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle import __main__ as shell
from heddle.functions import text as X
from heddle.functions.jsonable import json_rows
from heddle.operators import ann, evaluate, examples, models, profile, search
from heddle.sources import files, parse, store


def test_the_index_finds_most_and_scores_exactly(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=16)).tolist()) for i in range(600)] + [(900, None)]
    points = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = points.where("chunk_id % 20 = 3").selectExpr("chunk_id AS query_id", "embedding AS vector")
    planes = ann.Planes(16, tables=16, planes=8)
    indexed = ann.index(points, planes)
    assert indexed.count() == 600 * 16 and (planes.matrix() == ann.Planes(16, 16, 8).matrix()).all()
    exact = search.dense_search_batch(points, asked, 5).withColumnRenamed("chunk_id", "id")
    found = ann.search(indexed, asked, planes, 5)
    assert ann.recall(found, exact) >= 0.9
    scores = {(r.query_id, r.id): r.score for r in exact.collect()}
    assert all(abs(scores[r.query_id, r.id] - r.score) < 1e-9 for r in found.collect() if (r.query_id, r.id) in scores)
    assert ann.recall(ann.search(indexed, asked, planes, 5, probes=False), exact) <= ann.recall(found, exact)
    assert ann.search(indexed, asked.where("query_id < 0"), planes, 5).count() == 0


def test_json_rows(spark):
    schema = "a double, b decimal(9,2), c timestamp_ntz, d binary, e map<string,double>, f struct<g:date,h:array<float>>, i interval day to second, j string"
    rows = [(float("nan"), Decimal("1.50"), datetime(2024, 1, 2, 3), bytearray(b"\xff\x00"), {"k": float("-inf")}, (date(2024, 1, 2), [float("inf"), 1.5]), None, 'Infinity:Infinity,"NaN"'), (None,) * 8]
    first, second = (json.loads(r.json) for r in json_rows(spark.createDataFrame(rows, schema)).collect())
    assert first == {"a": "NaN", "b": 1.5, "c": "2024-01-02 03:00:00", "d": "ff00", "e": {"k": "-Infinity"}, "f": {"g": "2024-01-02", "h": ["Infinity", 1.5]}, "i": None, "j": 'Infinity:Infinity,"NaN"'}
    assert second == dict.fromkeys("abcdefij")


def test_readings_fill_what_has_no_text(spark):
    class Model:
        def read(self, picture):
            return picture.decode()

    rows = [("d", 1, "there", bytearray(b"no")), ("d", 2, " ", bytearray(b"one\ntwo\none\nthree")), ("d", 3, None, bytearray(b"all\nof it")), ("d", 4, None, None), ("e", 1, None, bytearray(b"```"))]
    filled = parse.fill(spark.createDataFrame(rows, "doc_id string, ord int, text string, picture binary"), Model())
    assert [(r.text, r.outcome) for r in filled.orderBy("doc_id", "ord").collect()] == [("there", "kept"), ("one\ntwo", "cut"), ("all\nof it", "read"), (None, "kept"), ("", "empty")]
    assert {tuple(r) for r in parse.fill_counts(filled).collect()} == {("d", 4, 1, 1, 0), ("e", 1, 0, 0, 1)}
    pictures = spark.createDataFrame([("d", 7, 1, [0.0, 0.0, 60.0, 55.0]), ("d", 8, 1, [0.0, 80.0, 49.0, 0.0])], "doc_id string, ord int, page int, bbox array<double>")
    assert [r.image for r in parse.crops(pictures).collect()] == ["d/00007.png"]


def test_collections(spark, tmp_path):
    points = spark.createDataFrame([("e", "d1", "text", "b.pdf", [1.0, 2.0]), ("e", "d1", "picture", "a.pdf", [1.0, 2.0])], "experiment string, doc_id string, modality string, source_file string, embedding array<double>")
    assert store.ensure(points, 2, False) is points
    for dim, sparse in ((3, False), (2, True)):
        with pytest.raises(store.CollectionError):
            store.ensure(points, dim, sparse)
    with pytest.raises(store.CollectionError):
        store.ensure(points.withColumn("embedding", F.lit(None).cast("array<double>")), 2, False)
    store.write_documents(points.coalesce(1), f"file://{tmp_path}/p")
    assert [r.modality for r in spark.read.parquet(f"file://{tmp_path}/p").collect()] == ["picture", "text"]
    chunks = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    store.staleness(chunks, chunks)
    with pytest.raises(store.CollectionError, match="1 "):
        store.staleness(chunks, chunks.limit(1))


def test_table_files(spark):
    paths = ["file:/d/shop/Orders 2024.csv", "file:/d/shop/orders_2024.csv", "file:/d/Bad Name/x.csv", "file:/d/shop/2.csv"]
    rows = {r.path: (r.schema_name, r.table_name, r.problem) for r in files.table_files(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert rows[paths[0]] == ("shop", "orders_2024", None) and rows[paths[1]][2] and rows[paths[2]][2] == "Bad Name is not a plain schema name" and rows[paths[3]] == ("shop", "table_2", None)


def test_examples_and_their_index(spark):
    embedder = models.HashingEmbedder(8)
    indexed = examples.index(spark.createDataFrame([("s", "how many", 1), ("s", "which", 2)], "schema_name string, standalone string, turn_id int"), embedder)
    assert examples.fits(indexed, embedder) and not examples.fits(indexed, models.HashingEmbedder(16)) and [r.turn_id for r in examples.without(indexed, 1).collect()] == [2]


def test_a_failing_column_is_a_warning(spark):
    df = spark.createDataFrame([(1, "x"), (2, "5")], "a int, b string").select("a", F.col("b").cast("int").alias("bad"), F.lit("same").alias("c"))
    rows, warnings = profile.describe_registered(df)
    assert [(r["column"], r["position"], r["distinct"]) for r in rows] == [("a", 0, 2), ("c", 2, 1)] and len(warnings) == 1 and warnings[0].startswith("bad: ")
    assert profile.describe_registered(df.select("a", "c"))[1] == []


def test_timings():
    seen = []
    with evaluate.timed(seen.append, stage="parse") as row:
        row["items"] = 3
    with pytest.raises(ZeroDivisionError), evaluate.timed(seen.append, stage="chunk"):
        1 / 0
    assert [(r["stage"], r.get("items"), r["failed"], r["duration_ms"] >= 0) for r in seen] == [("parse", 3, False, True), ("chunk", None, True, True)]


def test_headings_in_order(spark):
    df = spark.createDataFrame([([["b", "x"], [], ["a"], ["b", "x"]],)], "p array<array<string>>")
    assert df.select(X.headings_in_order(F.col("p"))).first()[0] == ["b > x", "a"]


def test_shell(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(shell, "get_session", lambda **_: spark)
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").write.parquet(f"{tmp_path}/shop/orders.parquet")
    (tmp_path / "f.csv").write_text("k;v\n1;2\n")
    folder = f"file://{tmp_path}/shop"
    assert shell.main(["queries"]) == 0 and "hybrid_rrf" in capsys.readouterr().out
    assert shell.main(["ask", folder, "select name from orders where id = 2"]) == 0 and capsys.readouterr().out == "name\nb\n"
    assert shell.main(["ask", folder, "drop table orders"]) == 1 and "SELECT" in capsys.readouterr().err
    assert shell.main(["describe", folder]) == 0 and "Table shop.orders: 2 rows." in capsys.readouterr().out
    assert shell.main(["look", f"file://{tmp_path}/f.csv"]) == 0 and "delimiter ';'" in capsys.readouterr().out
    assert shell.main(["load", f"file://{tmp_path}/f.csv", f"file://{tmp_path}/t"]) == 0 and shell.main(["setup", f"file://{tmp_path}"]) == 0
    assert shell.main([]) == 2 and shell.main(["show"]) == 2 and shell.main(["show", "nothing", "x"]) == 1
