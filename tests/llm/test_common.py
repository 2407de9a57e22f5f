"""Slices of batches, ranges of keys, and components against direct versions."""

import bisect
import random

import pyarrow as pa
from pyspark.sql import functions as F

from heddle.llm.common import Stored, range_bounds, range_of, slices
from heddle.llm.components import connected_components


def test_slices_cover_a_batch():
    rng = random.Random(1)
    for _ in range(50):
        texts = [rng.choice([None, "", "x" * rng.randrange(300), "é" * 5]) for _ in range(rng.randrange(0, 60))]
        part = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["i", "t"])
        got = list(slices(part, 1, 256))
        assert [x for p in got for x in p.column(0).to_pylist()] == list(range(len(texts)))
        assert all(p.num_rows for p in got)
        for p in got:  # all but the last text of a slice fit
            assert sum(len((t or "").encode()) for t in p.column(1).to_pylist()[:-1]) <= 256


def test_ranges(spark):
    values = [random.Random(2).randrange(-1000, 1000) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "k long")
    bounds = range_bounds(df, "k", 30)
    assert bounds == sorted(set(bounds)) and len(bounds) < 30
    for cuts in (bounds, bounds[:1], []):
        for k, r in df.select("k", range_of(F.col("k"), cuts)).collect():
            assert r == (0 if k is None else bisect.bisect_right(cuts, k))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 120)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)] + [(7, 7), (None, 3), (0, 1)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    while True:
        before = dict(label)
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = {r.node: r.component_id for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame(edges[:1], "a long, b long").where("a > 9")).count() == 0


def test_stored_is_read_again_and_dropped(spark):
    stored = Stored(spark.range(5))
    assert stored.df.count() == 5 and stored.df.count() == 5
    stored.drop()
