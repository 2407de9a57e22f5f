"""Incremental ingestion: files once by content, tables again by version, events in windows.

A run takes all that is available and ends (``availableNow``); with a processing-time trigger the same queries run on. State and progress are in
the checkpoint, so a restart goes on where it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from heddle.functions.text import content_id
from heddle.session import remove, shared_dir


def fresh(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream with the schema that it has now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent().toString()))  # a source watches folders


def once_by_content(stream: DataFrame, text_col: str = "text", time_col: str | None = None, within: str = "7 days") -> DataFrame:
    """The first row of each content.

    The state grows with distinct contents. With ``time_col`` it doesn't: a content is forgotten once the watermark, ``within`` behind
    the latest time, has passed it, and only repeats that come within that time are left out.
    """
    named = stream.withColumn("content_id", content_id(F.col(text_col)))
    if time_col is None:
        return named.dropDuplicates(["content_id"])
    return named.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, within).dropDuplicatesWithinWatermark(["content_id"])


def once_by_version(stream: DataFrame, key: str, version: str) -> DataFrame:
    """A row for each version of a key: a changed file is imported again, an unchanged one is not."""
    return stream.dropDuplicates([key, version])


def windowed(
    stream: DataFrame,
    time_col: str = "ts",
    late: str = "1 hour",
    size: str = "1 hour",
    by: str = "event_type",
    value: str = "value",
    slide: str | None = None,
) -> DataFrame:
    """Counts and sums by window, tumbling or sliding by ``slide``; windows end, and their state goes, once the watermark passes them."""
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    window = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    return timed.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, by: str, time_col: str = "ts", late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """(start, end, by, n): runs of a key's events that are less than ``gap`` apart."""
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    met = timed.groupBy(F.session_window(time_col, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return met.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes all that is available and ends. In ``complete`` mode each batch replaces the folder."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).outputMode(mode)
    return query.trigger(availableNow=True).start()


def run(spark: SparkSession, stream: DataFrame, schema: T.StructType | None = None, mode: str = "append") -> DataFrame:
    """The stream's whole result over what is there now; the rows stay in the shared folder, the progress does not."""
    out = fresh(spark)
    to_parquet(stream, f"{out}/rows", f"{out}/checkpoint", mode).awaitTermination()
    remove(spark, f"{out}/checkpoint")
    return spark.read.schema(schema or stream.schema).parquet(f"{out}/rows")


def watch_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """New files of a folder as a stream of (doc_id, path, modificationTime, content), each content once."""
    schema = T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("modificationTime", T.TimestampType()),
            T.StructField("length", T.LongType()),
            T.StructField("content", T.BinaryType()),
        ]
    )
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("doc_id", content_id(F.col("content"))).dropDuplicates(["doc_id"]).select("doc_id", "path", "modificationTime", "content")


def pending(files: DataFrame, manifest: DataFrame | None, ready) -> DataFrame:
    """Files of a scan that the manifest (key, version) lacks and that ``ready`` admits: one tick of a sensor.

    A file that is not whole yet is left out and seen again at the next tick, which a stream's offsets would not allow. A changed
    file has a new version and so comes again; a failed one stays in the manifest and doesn't.
    """
    now = files.where(ready).select(F.col("path").alias("key"), content_id(F.col("content")).alias("version"))
    return now if manifest is None else now.join(manifest.select("key", "version"), ["key", "version"], "left_anti")
