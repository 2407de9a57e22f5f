"""The graph index against exact scans: recall, filters, ties, vectors that are alike, and what has no place."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from heddle.operators import graph, search

POINTS, ASKED = "chunk_id long, embedding array<double>, modality string", "query_id long, vector array<double>"


def rows(frame):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in frame.collect())


def recall(found, exact):
    wanted = {(q, i) for q, _, i, _ in exact}
    return len(wanted & {(q, i) for q, _, i, _ in found}) / len(wanted)


@pytest.fixture(scope="module")
def clustered(spark):
    """1,500 vectors around 30 centres, of which 40 are the same; the modality of one in twelve is picture."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(30, 16))[rng.integers(0, 30, 1500)] + 0.5 * rng.normal(size=(1500, 16))
    v[100:140] = v[100]
    points = spark.createDataFrame([(i, v[i].tolist(), "picture" if i % 12 == 0 else "text") for i in range(1500)], POINTS)
    asked = spark.createDataFrame([(i, (v[i] + 0.1).tolist()) for i in range(0, 1500, 25)], ASKED)
    return points, asked


def test_recall_and_filter(spark, tmp_path, clustered):
    points, asked = clustered
    index = graph.build(points, f"file://{tmp_path}/g", graph.Shape(m=8, ef_construct=40, cell_rows=200, most=20), payload=("modality",))
    cells = index.centroids.count()
    assert cells == 15 and index.nodes.groupBy("cell", "part").count().agg({"count": "max"}).first()[0] <= 300
    for filters, pool in ((None, points), ({"modality": "picture"}, points.where("modality = 'picture'")), ({"modality": "text"}, points.where("modality = 'text'"))):
        exact = rows(search.dense_search_batch(pool, asked, 10))
        enough = graph.cells_for(index, asked, 10, share=0.99, filters=filters)
        assert 1 <= enough <= cells
        assert recall(rows(graph.search(index, asked, 10, filters=filters, cells=enough)), exact) >= 0.95
        assert recall(rows(graph.search(index, asked, 10, filters=filters, cells=cells, ef=1500)), exact) == 1.0
    assert rows(graph.search(index, asked, 10, filters={"modality": "sound"})) == []
    with pytest.raises(graph.GraphProblem):
        graph.search(index, asked, 21)
    with pytest.raises(graph.GraphProblem):
        graph.search(index, asked, 5, filters={"page": 1})


def test_alike_vectors_give_their_least_ids(spark, tmp_path, clustered):
    points, _ = clustered
    index = graph.build(points, f"file://{tmp_path}/g", graph.Shape(cell_rows=400, most=20))
    same = points.where("chunk_id = 100").selectExpr("1L AS query_id", "embedding AS vector")
    assert [r[2] for r in rows(graph.search(index, same, 20))] == list(range(100, 120))


def test_few_answers_are_completed_by_a_scan(spark, tmp_path, clustered):
    points, asked = clustered
    index = graph.build(points.where("chunk_id < 300"), f"file://{tmp_path}/g", graph.Shape(cell_rows=20, most=100))
    some = asked.where("query_id < 200")
    found = rows(graph.search(index, some, 90, cells=1))
    assert found == rows(search.dense_search_batch(points.where("chunk_id < 300"), some, 90))


def test_what_has_no_place(spark, tmp_path):
    odd = [(1, None, "a"), (2, [0.0, 0.0], "a"), (None, [1.0, 0.0], "a"), (3, [1.0], "a"), (4, [1.0, 1.0], None), (5, [2.0, 2.0], "a"), (5, [2.0, 2.0], "a")]
    index = graph.build(spark.createDataFrame(odd, POINTS), f"file://{tmp_path}/g", payload=("modality",))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], ASKED)
    assert [r[:3] for r in rows(graph.search(index, asked, 3))] == [(1, 1, 4), (1, 2, 5), (1, 3, 5)]
    assert [r[:3] for r in rows(graph.search(index, asked, 3, filters={"modality": "a"}))] == [(1, 1, 5), (1, 2, 5)]
    empty = graph.build(spark.createDataFrame([], POINTS), f"file://{tmp_path}/e")
    assert rows(graph.search(empty, asked, 3)) == [] and graph.cells_for(empty, asked, 3) == 1
    assert rows(graph.search(index, asked.where("false"), 3)) == []


def test_every_node_can_be_reached():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)) * rng.choice([1, 50], size=(400, 1))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = graph.links(v, 4, 10)
    met = graph.walk(v[7], v, near, np.ones(400, bool), 400)
    assert len(met) == 400 and met[0][1] == 7 and [n for _, n in met] == sorted(range(400), key=lambda i: (-(v[i] @ v[7]), i))
    assert graph.links(v[:1], 4, 10)[0].size == 0


def peak_mb(work):
    """What ``work`` gives, and the most memory that numpy held in it."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_rows_go_to_many_cells_in_small_batches():
    rng = np.random.default_rng(2)
    v, centres = rng.normal(size=(2000, 32)), rng.normal(size=(150, 32))
    part = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(v.tolist())], names=["q", "vector"])
    out = list(graph._to_cells(part, centres, 140))
    assert max(b.num_rows for b in out) * 32 <= graph.BLOCK_VALUES
    whole = pa.Table.from_batches(out)
    assert whole.column("q").to_pylist() == np.repeat(np.arange(2000), 140).tolist()
    assert whole.column("cell").to_pylist() == np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :140].ravel().tolist()


def test_links_and_exact_answers_hold_small_matrices(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(10_000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near, mb = peak_mb(lambda: graph.links(v[:2000], 8, 100))
    assert len(near) == 2000 and mb < 50, mb
    part = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(v.tolist())], names=["id", "v"])
    asked = [{"q": i, "v": v[i].tolist()} for i in range(0, 10_000, 20)]
    best = search._best_of(spark, asked, 16, 3)
    (out,), mb = peak_mb(lambda: list(best(iter([part]))))
    scores = v[::20] @ v.T
    want = [i for s in scores for i in np.lexsort((np.arange(10_000), -np.round(s, 9)))[:3]]
    assert out.column("id").to_pylist() == want and mb < 45, mb
