"""The kept index: batches of changes score as a rebuild does, and searches read the questions' terms alone."""

import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import lexical, lexindex

DOC, ASK = "doc_id long, text string", "query_id long, question string"


def text(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(n))


def rounded(frame):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in frame.collect())


def test_batches_score_as_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    index = lexindex.open_index(spark, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(i, text(rng, rng.randrange(1, 9))) for i in range(12)] + [(99, "absent"), (98, None)], ASK)
    assert lexindex.search(index.snapshot(), asked, 3).count() == 0
    live = {}

    def step(new, deleted):
        state = lexindex.update(index, spark.createDataFrame(list(new.items()), DOC), spark.createDataFrame([(d,) for d in deleted], "doc_id long"))
        for d in deleted:
            live.pop(d, None)
        live.update(new)
        docs = spark.createDataFrame(list(live.items()), DOC)
        assert state.facts["documents"] == len(live)
        return state, docs

    state, docs = step({i: text(rng, rng.randrange(0, 40)) for i in range(120)} | {500: None, 501: ""}, [])
    assert rounded(lexindex.search(state, asked, 3)) == rounded(lexical.sparse_search_batch(docs, asked, 3))
    # some are new, some changed, some removed, some of which were never there
    state, _ = step({i: text(rng, rng.randrange(0, 40)) for i in range(100, 160)}, [3, 4, 5, 9999])
    state, docs = step({4: text(rng, 20), 100: None}, [100_000, 7, 120])
    want = rounded(lexical.sparse_search_batch(docs, asked, 3))
    assert rounded(lexindex.search(state, asked, 3)) == want
    assert rounded(lexindex.search(state, asked, 3, seeds=1)) == want  # the bar and the blocks' bounds at work
    before = state
    merged = lexindex.merge(index)
    assert merged.facts["dead"] == 0 and merged.table("dead").count() == 0 and merged.table("documents").count() == len(live)
    assert merged.table("terms").groupBy("term").count().where("count > 1").count() == 0
    assert rounded(lexindex.search(merged, asked, 3)) == want
    assert rounded(lexindex.search(before, asked, 3)) == want  # an earlier state still reads as it was
    counts = {r.term: r.df for r in lexical.document_frequency(lexical.term_counts(docs)).collect()}
    assert {r.term: r.df for r in merged.table("terms").collect()} == counts


def test_a_batch_names_an_id_once(spark, tmp_path):
    index = lexindex.open_index(spark, f"file://{tmp_path}/index")
    with pytest.raises(lexindex.IndexProblem):
        lexindex.update(index, spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], DOC))
    assert index.versions() == []


def test_blocks_are_full_sorted_and_bound_their_postings(spark, tmp_path):
    docs = spark.createDataFrame([(i, "common " * (1 + i % 3) + f"rare{i % 50} x{i}") for i in range(600)], DOC)
    state = lexindex.update(lexindex.open_index(spark, f"file://{tmp_path}/index"), docs, buckets=4)
    blocks = state.table("postings").collect()
    assert all(len(b.ids) == len(b.tfs) == len(b.lengths) <= lexindex.BLOCK and b.ids == sorted(b.ids) for b in blocks)
    assert all(b.max_tf == max(b.tfs) and b.min_length == min(b.lengths) for b in blocks)
    assert sum(len(b.ids) for b in blocks if b.term == "common") == 600
    assert sorted(d for b in blocks if b.term == "rare7" for d in b.ids) == list(range(7, 600, 50))


def test_a_search_reads_the_buckets_and_rows_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha{i} beta{i % 7}") for i in range(400)], DOC)
    state = lexindex.update(lexindex.open_index(spark, f"file://{tmp_path}/index"), docs, buckets=16)
    blocks = state.table("postings")
    own = lexindex._of_terms(blocks, [3], ["beta3"], None)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:60] and "EqualTo(term,beta3)" in plan
    assert all("bucket=3/" in r[0] for r in own.select(F.input_file_name()).distinct().collect())


def test_a_hot_term_is_dealt_to_several_tasks(spark):
    counts = spark.range(20_000).select(F.col("id").alias("d"), F.lit(5).cast("long").alias("length"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("term"), F.lit(1).cast("long").alias("tf"))
    made = lexindex._blocks(counts, 1, 4).withColumn("part", F.spark_partition_id()).where("term = 'hot'")
    assert made.select("part").distinct().count() > 1 and made.agg(F.sum(F.size("ids"))).first()[0] == counts.where("term = 'hot'").count()


def test_a_batch_deals_pieces_and_not_postings(spark):
    docs = spark.createDataFrame([(i, "common " * (1 + i % 3) + f"x{i}") for i in range(2000)] + [(2000, ""), (2001, None)], "d long, text string").repartition(2)
    rows = lexindex._read(docs).collect()
    common = [lexindex.np.frombuffer(r.postings, lexindex.POSTING) for r in rows if r.term == "common"]
    assert len(common) <= 2 * (1 + 1002 // lexindex.PIECE) and max(map(len, common)) == lexindex.PIECE
    assert sorted(tuple(p.tolist()) for own in common for p in own) == [(i, 1 + i % 3, 2 + i % 3) for i in range(2000)]
    texts = {r.d: (r.length, sorted(r.words.split())) for r in rows if r.d is not None}
    assert texts == {i: (2 + i % 3, ["common", f"x{i}"]) for i in range(2000)} | {2000: (0, []), 2001: (0, [])}


def test_a_search_of_many_words_reads_the_index_once(spark, tmp_path):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(300)}" for _ in range(30))) for i in range(200)], DOC)
    state = lexindex.update(lexindex.open_index(spark, f"file://{tmp_path}/index"), docs, buckets=4)
    asked = spark.createDataFrame([(q, " ".join(f"w{i}" for i in range(50 * q, 50 * q + 50))) for q in range(5)], ASK)
    found = lexindex.search(state, asked, 3)
    assert not [f for f in found.inputFiles() if "/postings/" in f]
    assert rounded(found) == rounded(lexical.sparse_search_batch(docs, asked, 3))
