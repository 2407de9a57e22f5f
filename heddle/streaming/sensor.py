"""A sensor with its own state: a file's version comes out once, when it is whole and has settled; what is no longer seen is forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from heddle.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "version string, since long, seen long, passed string"
OUT = "key string, version string, since timestamp"


class Sensor(StatefulProcessor):
    """The state of one key: the version that waits and since when, when the key was last seen, and the version that was passed on.

    Times are milliseconds of event time. A timer stands for the moment when the version that waits has settled, or else for the moment when the key is forgotten.
    """

    def __init__(self, settle_ms: int, forget_ms: int):
        self.settle, self.forget = settle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", STATE)

    def _wake(self, version: str | None, since: int, seen: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(since + self.settle if version is not None else seen + self.forget)

    def _frame(self, key: str, passed: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
        if passed:
            versions, since = zip(*passed, strict=True)
            yield pd.DataFrame({"key": [key] * len(passed), "version": versions, "since": pd.to_datetime(since, unit="ms")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        version, since, seen, last = self.file.get() if self.file.exists() else (None, 0, 0, None)
        sightings = pd.concat(list(rows)).sort_values(["seen", "version"], kind="stable", na_position="first")
        out: list[tuple[str, int]] = []
        for at, now, whole in zip(sightings["seen"].tolist(), sightings["version"].tolist(), sightings["whole"].tolist(), strict=True):
            if version is not None and at >= since + self.settle:
                out.append((version, since))
                last, version = version, None
            if last is not None and version is None and at >= seen + self.forget:
                last = None
            if not whole or now is None:
                version = None
            elif now == last:
                version = None
            elif now != version:
                version, since = now, at
            seen = max(seen, at)
        self.file.update((version, since, seen, last))
        self._wake(version, since, seen)
        yield from self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.file.exists():
            return
        version, since, seen, last = self.file.get()
        now = timerValues.getCurrentWatermarkInMs()
        out = []
        if version is not None and now >= since + self.settle:
            out, last, version = [(version, since)], version, None
        if version is None and now >= seen + self.forget:
            self.file.clear()
        else:
            self.file.update((version, since, seen, last))
            self.handle.registerTimer(since + self.settle if version is not None else seen + self.forget)
        yield from self._frame(key[0], out)

    def close(self) -> None:
        pass


def ready(sightings: DataFrame, settle: int = 5, forget: int = 30 * 86400, late: str = "0 seconds") -> DataFrame:
    """(key, version, since) of a stream of sightings (key, version, seen, whole): each version once, when it is whole and stayed so for ``settle`` seconds.

    A sighting is what a listing says of a file: its version (null: none), when it was seen and whether it is whole. A version that changes, or is not
    whole, before it has settled does not come; one that came and is seen again does not come again, one that comes back after another does. Sightings of null keys or times
    are left out. The state of a key goes ``forget`` seconds after it was last seen, so it is bounded by the files that are there. All times are
    those of the sightings, so a restart from the checkpoint gives the same rows. One trigger's sightings of one key meet in a task: bound triggers, not keys.
    """
    spark = sightings.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # a checkpoint keeps the one that it began with
    seen = F.col("seen").cast("timestamp")
    timed = sightings.select(F.col("key").cast("string").alias("key"), F.col("version").cast("string").alias("version"), seen.alias("at"), F.coalesce("whole", F.lit(False)).alias("whole"))
    known = timed.where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late).withColumn("seen", F.unix_millis("at"))
    return known.groupBy("key").transformWithStateInPandas(Sensor(settle * 1000, forget * 1000), OUT, "append", "eventTime")
