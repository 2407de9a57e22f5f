"""Queries over streams with state of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.streaming import ingest, sensor

SETTLE_S, FORGET_S = 6 * 3600, 10 * 366 * 86400


def stream_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sensor passes on of users as keys and kinds of event as versions (errors are not whole): versions that stayed for six hours."""
    events = ingest.read_stream(spark, f"{sf_dir}/events.parquet")
    sightings = events.select(F.col("user_id").alias("key"), F.col("event_type").alias("version"), F.col("ts").alias("seen"), (F.col("event_type") != "error").alias("whole"))
    rows = ingest.run(spark, sensor.ready(sightings, SETTLE_S, FORGET_S))
    return rows.select("key", "version", F.unix_millis("since").alias("since_ms"))


QUERIES = {f.__name__: f for f in (stream_sensor,)}

ORACLES = {
    "stream_sensor": f"""WITH s AS (SELECT user_id AS key, event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type <> 'error' THEN event_type END AS v, event_type FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
 m AS (SELECT *, lag(v) OVER w IS DISTINCT FROM v OR row_number() OVER w = 1 AS fresh, max(ms) OVER () AS latest FROM s WINDOW w AS (PARTITION BY key ORDER BY ms, event_type, event_id)),
 g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY key ORDER BY ms, event_type, event_id) AS run FROM m),
 runs AS (SELECT key, run, any_value(v) AS v, min(ms) AS since, max(ms) AS last, any_value(latest) AS latest FROM g GROUP BY key, run),
 ends AS (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY run) AS until FROM runs),
 stayed AS (SELECT *, lag(v) OVER (PARTITION BY key ORDER BY run) AS before FROM ends WHERE v IS NOT NULL AND (until >= since + {SETTLE_S * 1000} OR last >= since + {SETTLE_S * 1000} OR (until IS NULL AND latest > since + {SETTLE_S * 1000})))
 SELECT key::VARCHAR AS key, v AS version, since AS since_ms FROM stayed WHERE before IS DISTINCT FROM v""",
}
