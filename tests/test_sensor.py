"""The sensor: versions once, whole and settled, over restarts, with a state that goes."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heddle.plans import stream_plans
from heddle.streaming import ingest, sensor

START = datetime(2024, 1, 1)


def test_equals_sql(same_rows):
    same_rows(stream_plans.stream_sensor, stream_plans.ORACLES["stream_sensor"])


def test_restarts_and_forgets(spark, tmp_path):
    had = [Counter()]
    out, checkpoint, source = f"{tmp_path}/out", f"{tmp_path}/checkpoint", f"{tmp_path}/in"
    schema = "key string, version string, seen timestamp, whole boolean, extra string"

    def tick(*rows):
        made = [(k, v, None if s is None else START + timedelta(seconds=s), w, "x") for k, v, s, w in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.to_parquet(sensor.ready(stream, settle=5, forget=100), out, checkpoint).awaitTermination()
        now = Counter((r.key, r.version) for r in spark.read.parquet(out).collect())
        new, had[0] = now - had[0], now
        return sorted(new.elements())

    assert tick(("a", "1", 0, True), ("b", "1", 0, False), (None, "1", 0, True), ("n", None, 0, True), ("t", "1", None, True)) == []
    assert tick(("a", "1", 6, True), ("b", "1", 6, True), ("c", "1", 6, None)) == [("a", "1")]  # b was not whole, c isn't
    assert tick(("a", "1", 20, True)) == [("b", "1")]  # by its timer, after a restart, without a sighting
    assert tick(("a", "2", 30, True), ("a", "2", 31, True), ("a", "3", 33, True)) == []  # 2 changed before it settled
    assert tick(("d", "1", 40, True)) == [("a", "3")]
    assert tick(("d", "1", 300, True)) == [("d", "1")]  # since 40; not seen for longer than that is remembered, it is new again
    assert tick(("a", "3", 400, True), ("d", "1", 390, True)) == [("d", "1")]
    assert tick(("d", "1", 410, True)) == [("a", "3")]  # forgotten, so new
    state = spark.read.format("statestore").option("stateVarName", "file").load(checkpoint)
    assert {r[0] for r in state.select(F.col("key.key")).collect()} == {"a", "d"}


def test_empty(spark, tmp_path):
    schema = "key string, version string, seen timestamp, whole boolean"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    rows = ingest.run(spark, sensor.ready(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")))
    assert rows.columns == ["key", "version", "since"] and rows.count() == 0


@pytest.fixture(autouse=True)
def _provider(spark):
    """Other tests' streams have the usual state store."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
