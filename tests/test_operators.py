"""Gates, weights, vectors, chunking, registry, files and settings against direct versions."""

import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.functions.vectors import cosine, truncate_normalise
from heddle.operators import chunking, evaluate, lexical, models, registry, search
from heddle.operators.profile import SchemaTooLarge, schema_text
from heddle.sources import files, settings, store


def test_floor_and_gate(spark):
    hits = spark.createDataFrame([(1, 0.9), (2, 0.4), (3, 0.05)], "rank long, score double")
    kept = lambda floor: [r.rank for r in search.above(hits, floor).orderBy("rank").collect()]
    assert (kept(0.4), kept(0.0), kept(0.95)) == ([1, 2], [1, 2, 3], [])
    assert search.enough(hits, 0.9).first().enough and not search.enough(hits.where("false"), 0.1).first().enough


def test_searches_are_bounded():
    for most in range(4):
        for new in (True, False):
            searches, rewrites, step = 1, 0, search.after_grade(False, 0, most)
            while step != "abstain":
                if step == "rewrite":
                    rewrites += 1
                    step = search.after_rewrite(new, rewrites, most)
                else:
                    searches += 1
                    step = search.after_grade(False, rewrites, most)
            assert searches == (most + 1 if new else 1)


def test_bm25_saturates_and_prefers_short_texts(spark):
    docs = spark.createDataFrame([(1, "cat cat cat dog"), (2, "cat dog"), (3, "cat dog " + "filler " * 40), (4, None), (5, "")], "doc_id long, text string")
    w = {(r.doc_id, r.term): r.weight for r in lexical.bm25_weights(docs).collect()}
    assert w[1, "cat"] < 3 * w[1, "dog"] and w[1, "cat"] > w[1, "dog"] and w[3, "cat"] < w[2, "cat"]
    mean = (4 + 2 + 42) / 5
    assert math.isclose(w[1, "cat"], 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 4 / mean)))
    assert lexical.sparse_search(docs, ["nothing"], 3).count() == 0


def test_yes_probability(spark):
    top = [("yes", math.log(0.5)), (" Yes", math.log(0.1)), ("No", math.log(0.2)), ("no", math.log(0.1)), ("The", math.log(0.05))]
    df = spark.createDataFrame([(top,), (top[-1:],), ([],)], "t array<struct<token:string,logprob:double>>")
    assert [round(r[0], 9) for r in df.select(search.yes_probability(F.col("t"))).collect()] == [round(0.6 / 0.9, 9), 0.0, 0.0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, 12.0, 0.5],), ([0.0, 0.0, 1.0, 1.0],)], "v array<float>")
    got = [r[0] for r in df.select(truncate_normalise(F.col("v"), 2)).collect()]
    assert np.allclose(got, [[0.6, 0.8], [0, 0]])
    assert [r[0] for r in df.select(cosine(F.col("v"), F.array(F.lit(0.0), F.lit(0.0)))).collect()] == [None, None]


def test_batch_search_equals_single(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(7)
    asked = spark.createDataFrame([(i, v) for i, v in rows[:5]], "query_id long, vector array<double>")
    got = {}
    for r in search.dense_search_batch(chunks, asked, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    for i, v in rows[:5]:
        one = search.dense_search(chunks, F.array(*[F.lit(x) for x in v]), 4).collect()
        assert sorted(got[i]) == [(r.rank, r.chunk_id) for r in one]
    blocks = {}
    for r in search.dense_search_batch(chunks, asked, 4, block_values=8).collect():  # a query a block
        blocks.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    assert {q: sorted(v) for q, v in blocks.items()} == {q: sorted(v) for q, v in got.items()}
    assert search.dense_search_batch(chunks, asked.where("query_id < 0"), 4).count() == 0


def test_text_expressions(spark):
    df = spark.createDataFrame([("Rare42 rare42 beta",), ("see [2], [1] and [2] [99999999999]",), (None,)], "t string")
    rows = df.select(F.array_distinct(X.tokens(F.col("t"))).alias("t"), X.citations(F.col("t")).alias("c")).collect()
    assert rows[0].t == ["rare42", "beta"] and rows[1].c[:2] == [1, 2] and rows[2].t == []
    new = spark.createDataFrame([("  what does  PMON do? ",), ("",), ("PMON background process",)], "q string").select(X.is_new_query(F.col("q"), F.array(F.lit("What does PMON do?"))))
    assert [r[0] for r in new.collect()] == [False, False, True]
    line = spark.range(1).select(X.passage(F.lit(2), F.lit("a.pdf"), F.lit(3), F.array(F.lit("A"), F.lit("B"))), X.sample_value(F.lit("it's " + "x" * 60))).first()
    assert line[0] == "[2] (a.pdf, page 3, A > B)" and line[1].startswith("'it''s xxx") and line[1].endswith("…'")


def test_pack_and_recursive_cover_the_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "another ", "end. ", "stop!  ", "\n\n", "x" * 9 + " "]) for _ in range(rng.randrange(1, 120))) for _ in range(30)] + ["", "one", "w " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in chunking.recursive(df, 12).collect():
        assert " ".join(" ".join(r.pieces).split()) == " ".join(r.text.split())
        assert all(0 < len(p.split()) <= 12 for p in r.pieces)
    for r in df.select("text", chunking.sentences(F.col("text")).alias("s")).collect():
        assert "".join(r.s) == r.text
    packed = spark.range(1).select(chunking.pack(F.array(*[F.lit(x) for x in ("a b ", "c ", "d e f g ", "h ")]), 3)).first()[0]
    assert packed == ["a b c", "d e f g", "h"]
    with pytest.raises(ValueError):
        chunking.fixed(df, 5, 5)


def test_html_blocks(spark):
    html = '<html><nav><li>menu</li></nav><article><h1>Top &amp; more</h1><p><b>One</b> two<br><p>Three<ul><li>item</li></ul></p><h2>Sub</h2><p>Four</p></article><footer><p>foot</p></footer><script>var p="<p>no</p>"</script></html>'
    rows = chunking.segment(chunking.blocks_from_html(spark.createDataFrame([(1, html)], "page_id long, html string"))).orderBy("ord").collect()
    assert [(r.kind, r.text, r.headings) for r in rows] == [
        ("heading", "Top & more", ["Top & more"]), ("text", "One two", ["Top & more"]), ("text", "Three", ["Top & more"]), ("text", "item", ["Top & more"]), ("heading", "Sub", ["Top & more", "Sub"]), ("text", "Four", ["Top & more", "Sub"]),
    ]


def test_embedding_cache(spark):
    calls = []

    class Counting(models.HashingEmbedder):
        def embed(self, texts):
            if any(t == "flaky" for t in texts) and not calls:
                calls.append(1)
                raise models.TransientError
            return super().embed(texts)

    assert models.with_retries(lambda: Counting(8).embed(["flaky"]), wait=lambda s: None).shape == (1, 8)
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "id long, text string")
    full, fresh = models.embed_cached(df, models.HashingEmbedder(8), None)
    cache = spark.createDataFrame(fresh.collect(), fresh.schema)
    assert cache.count() == 2
    again, none = models.embed_cached(df, models.HashingEmbedder(8), cache)
    assert none.count() == 0 and sorted((r.id, r.embedding) for r in again.collect() if r.embedding) == sorted((r.id, r.embedding) for r in full.collect() if r.embedding)


def test_registry_cascade_and_constraints(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    b = spark.createDataFrame([(10, 1), (11, 2), (12, 9)], "bid long, id long")
    c = spark.createDataFrame([(100, 10), (101, 11)], "cid long, bid long")
    left = registry.delete_cascade({"a": a, "b": b, "c": c}, [("b", "id", "a", "id"), ("c", "bid", "b", "bid")], "a", a.where("id = 1").select("id"))
    assert ([r.id for r in left["a"].collect()], sorted(r.bid for r in left["b"].collect()), [r.cid for r in left["c"].collect()]) == ([2], [11, 12], [101])
    assert [r.bid for r in registry.orphans(b, "id", a, "id").collect()] == [12]
    assert registry.duplicates(a.unionByName(a), ["id"]).count() == 2


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4), (2, "z", 1)], "query_id long, item_id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "c"), (1, "d"), (2, "q")], "query_id long, item_id string")
    one, two = evaluate.ranking_metrics(hits, relevant).orderBy("query_id").collect()
    assert one.mrr == 0.5 and one.map == round((1 / 2 + 2 / 4) / 3, 6) and one.recall_3 == round(1 / 3, 6) and one.hit_1 == 0
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert one.ndcg_5 == round((1 / math.log2(3) + 1 / math.log2(5)) / ideal, 6)
    assert two.mrr == 0 and two.map == 0 and two.ndcg_10 == 0


def test_files(spark, tmp_path):
    (tmp_path / "shop").mkdir()
    (tmp_path / "Bad Name").mkdir()
    for path, body in {"a.pdf": b"x" * 3000 + b"%%EOF\n", "b.pdf": b"%%EOF" + b"x" * 3000, "c.pdf": b"x" * 3000 + b"%%EOF\n"}.items():
        (tmp_path / path).write_bytes(body)
    for path in ("shop/Orders.csv", "shop/orders .csv", "Bad Name/t.csv"):
        (tmp_path / path).write_text("a\n1\n")
    pdfs = files.scan(spark, f"file://{tmp_path}", "*.pdf")
    assert {r.path[-5:]: r.c for r in pdfs.select("path", files.is_complete(F.col("content")).alias("c")).collect()} == {"a.pdf": True, "b.pdf": False, "c.pdf": True}
    assert sorted((r.path[-5:], r.copies) for r in files.documents(pdfs).collect()) == [("b.pdf", 1), ("c.pdf", 2)]
    assert not any(r[0] for r in pdfs.select(files.settled(F.col("modificationTime"))).collect())
    assert all(r[0] for r in pdfs.select(files.settled(F.col("modificationTime"), F.lit(datetime.now() + timedelta(days=2)))).collect())
    found = files.table_files(files.scan(spark, f"file://{tmp_path}", "*.csv")).collect()
    assert Counter((r.schema_name, r.table_name, r.problem is None) for r in found) == Counter([("shop", "orders", True), ("shop", "orders", False), ("Bad Name", "t", False)])


def test_store(spark, tmp_path):
    points = spark.createDataFrame([("e", "d1", "c1", [1.0, 2.0]), ("e", "d2", "c2", [1.0])], "experiment string, doc_id string, chunk_id string, embedding array<double>")
    path = f"file://{tmp_path}/points"
    for _ in range(2):
        store.write_documents(points, path)
    store.write_documents(points.where("doc_id = 'd1'").withColumn("chunk_id", F.lit("new")), path)
    assert sorted(r.chunk_id for r in spark.read.parquet(path).collect()) == ["c2", "new"]
    assert [r.doc_id for r in store.dimension_problems(points, 2).collect()] == ["d2"]
    assert [r.chunk_id for r in store.stale(points, points.where("doc_id = 'd1'")).collect()] == ["c2"]
    chunks = spark.createDataFrame([("d", "t", "text", "fixed", 1, ["h"], None, 3, "d:00000", None)], store.CHUNK)
    store.write_chunks(chunks, f"file://{tmp_path}/chunks")
    assert store.read_chunks(spark, f"file://{tmp_path}/chunks").collect() == chunks.collect()


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("name: ${WHO}\nsearch:\n  top_k: 7\n  floor: 1\n")
    got = settings.load(str(path), {"WHO": "me"})
    assert (got.name, got.search.top_k, got.search.floor) == ("me", 7, 1.0)
    assert settings.config_hash(got) != settings.config_hash(settings.Settings()) and len(settings.config_hash(got)) == 16
    assert settings.config_hash(got, ("name", "search")) == settings.config_hash(settings.Settings(), ("name", "search"))
    for bad in ("nope: 1\n", "search:\n  nope: 1\n", "search:\n  top_k: x\n", "name: ${UNSET_VARIABLE}\n"):
        path.write_text(bad)
        with pytest.raises(settings.SettingsError):
            settings.load(str(path), {})


def test_schema_text(spark):
    tables = {"orders": spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, None, "a")], "id long, customer_id long, kind string"), "customers": spark.createDataFrame([(5, "x"), (6, "y")], "customer_id long, name string")}
    text = schema_text(spark, "shop", tables)
    assert "Table shop.orders: 3 rows." in text and "  - kind (text): values: 'a', 'b'" in text and "  - customer_id (bigint): 1 distinct values; range 5 to 5; 1 NULL" in text
    assert "  - shop.orders.customer_id = shop.customers.customer_id (bigint)" in text and re.search(r"name \(text\): unique; e.g. 'x', 'y'", text)
    with pytest.raises(SchemaTooLarge):
        schema_text(spark, "shop", tables, budget=50)
