"""Payload indexes: filters on a key read few row groups, by statistics or Bloom filters, and lose no row."""

import pytest
from pyspark.sql import functions as F

from heddle.plans import index_plans
from heddle.sources import store

N = 40_000


def read_rows(frame):
    """(rows found, rows that the scan gave to the filter)."""
    found = len(frame.collect())
    return found, frame._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_row_groups_are_skipped(spark, tmp_path):
    ids = spark.range(N).select(
        F.concat(F.lit("doc"), F.lpad((F.col("id") % 400).cast("string"), 5, "0")).alias("doc_id"),
        F.when(F.col("id") % 9 == 0, "table").otherwise("text").alias("modality"),
        F.md5((F.col("id") % 400).cast("string")).alias("source_file"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
        F.col("id").alias("n"),
    )
    path = f"{tmp_path}/points"
    store.write_indexed(ids, path, distinct=2000, row_group_bytes=64 << 10)
    points = spark.read.parquet(path)
    assert points.count() == N and sorted(points.columns) == sorted(ids.columns)
    found, scanned = read_rows(points.where("doc_id = 'doc00123'"))
    assert found == 100 and scanned < N / 10  # by statistics
    name = ids.where("n = 123").first().source_file
    found, scanned = read_rows(points.where(F.col("source_file") == name))
    assert found == 100 and scanned < N / 10  # hashes: no range tells them apart, Bloom filters do
    plain = f"{tmp_path}/plain"
    ids.write.option("parquet.block.size", 64 << 10).parquet(plain)
    assert read_rows(spark.read.parquet(plain).where(F.col("source_file") == name)) == (100, N)


def test_hot_keys_nulls_and_repeats(spark, tmp_path):
    rows = [("hot", "text", "f", i) for i in range(300)] + [(None, None, None, 1)] * 3 + [("a", "text", "g", 1)] * 2
    points = spark.createDataFrame(rows, "doc_id string, modality string, source_file string, n int")
    store.write_indexed(points, f"{tmp_path}/points")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/points").collect()), key=str) == sorted(rows, key=str)
    store.write_indexed(points.where("false"), f"{tmp_path}/points")
    assert spark.read.parquet(f"{tmp_path}/points").count() == 0
    with pytest.raises(store.CollectionError, match="none of the keys"):
        store.write_indexed(points.select("n"), f"{tmp_path}/other")


def test_equals_sql(same_rows):
    same_rows(index_plans.payload_lookup, index_plans.ORACLES["payload_lookup"])
