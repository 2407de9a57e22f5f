"""Folders of files as frames: which are new, whole, settled and usable."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions.text import content_id
from heddle.session import ship
from heddle.sources.csvload import clean_identifier

SETTLED_S = 5
END_MARK, END_BYTES = "%%EOF", 1024


def scan(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, modificationTime, length, content) of the matching files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def is_complete(content: Column) -> Column:
    """Whether a PDF's last kilobyte has its end mark."""
    tail = F.decode(F.substring(content, F.greatest(F.lit(1), F.length(content) - F.lit(END_BYTES - 1)), END_BYTES), "ISO-8859-1")
    return F.contains(tail, F.lit(END_MARK))


def settled(modified: Column, now: Column | None = None) -> Column:
    return modified <= (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {SETTLED_S} SECONDS")


def documents(files: DataFrame) -> DataFrame:
    """(doc_id, path, copies): files by the hash of their bytes; of equal files the last path counts."""
    return files.select(content_id(F.col("content")).alias("doc_id"), "path").groupBy("doc_id").agg(F.max("path").alias("path"), F.count("*").alias("copies"))


def version(content: Column, notes: Column) -> Column:
    """What makes a table's import stale: its content, and its notes if there are any."""
    return F.concat_ws(":", content_id(content), F.when(notes.isNotNull(), content_id(notes)))


def table_files(files: DataFrame) -> DataFrame:
    """(path, schema_name, table_name, problem) for ``<schema>/<table>.csv`` files; a problem makes one unusable.

    Names are cleaned where the listing is; of files whose tables have the same name the first counts.
    """
    ship(files.sparkSession)

    def batches(parts):
        for part in parts:
            paths = [p for p in part.column(0).to_pylist() if p.count("/")]
            split = [p.rsplit("/", 2)[-2:] for p in paths]
            rows = [
                (
                    p,
                    folder,
                    clean_identifier(name.rsplit(".", 1)[0], "table"),
                    None if folder == clean_identifier(folder, "schema") else f"{folder} is not a plain schema name",
                ) for p, (folder, name) in zip(paths, split, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.string()) for i in range(4)],
                names=["path", "schema_name", "table_name", "problem"],
            )

    found = files.select("path").mapInArrow(batches, "path string, schema_name string, table_name string, problem string")
    nth = F.row_number().over(Window.partitionBy("schema_name", "table_name").orderBy("path"))
    return found.withColumn("problem", F.coalesce("problem", F.when(nth > 1, F.lit("another file has this table's name"))))
