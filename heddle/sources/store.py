"""Chunk and index files: JSON lines, idempotent writes by document, and checks of what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD_KEYS = ("modality", "source_file")
CHUNK = "doc_id string, text string, modality string, strategy string, page int, headings array<string>, bbox array<double>, token_count int, chunk_id string, image string"


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def write_documents(points: DataFrame, path: str) -> None:
    """Replaces the written documents' partitions of each experiment and leaves the others; repeating it changes nothing.

    Rows are sorted by the payload that searches filter by, so that the files' statistics let a filter skip most of them.
    """
    keys = [k for k in PAYLOAD_KEYS if k in points.columns]
    points = points.sortWithinPartitions("experiment", "doc_id", *keys) if keys else points
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "doc_id").parquet(path)


def write_indexed(
    points: DataFrame,
    path: str,
    keys: tuple[str, ...] = ("doc_id", "modality", "source_file"),
    bloom: tuple[str, ...] = ("doc_id", "source_file"),
    distinct: int = 100_000,
    row_group_bytes: int = 32 << 20,
) -> None:
    """Writes points so that a filter on one of ``keys`` skips most of what can't match, without an index beside them; replaces what is there.

    Files and row groups are ranges of ``keys`` in this order, which Parquet's statistics and column indexes tell of; for keys that stand later, ``bloom`` columns
    have a filter in each row group, sized for ``distinct`` values of it. Rows beyond equal keys are dealt by a hash of their plain columns, so a key that many
    points have is several ranges. Keys that the points lack are left out; null keys come first.
    """
    sorts = [k for k in keys if k in points.columns]
    if not sorts:
        raise CollectionError(f"Points have none of the keys {', '.join(keys)}.")
    plain = [f.name for f in points.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    dealt = points.withColumn("_deal", F.xxhash64(*plain)).repartitionByRange(*sorts, "_deal").sortWithinPartitions(*sorts).drop("_deal")
    writer = dealt.write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    for column in (c for c in bloom if c in points.columns):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", distinct)
    writer.parquet(path)


def dimension_problems(points: DataFrame, dim: int, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector does not have ``dim`` components: empty if the store is sound."""
    return points.where(F.col(vector_col).isNull() | (F.size(vector_col) != dim))


def stale(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys that only one side has: empty if vectors and chunks belong together."""
    met = chunks.select(key, F.lit(1).alias("_c")).join(vectors.select(key, F.lit(1).alias("_v")), key, "full_outer")
    return met.where(F.col("_c").isNull() | F.col("_v").isNull()).select(key)


def stats(points: DataFrame, vector_col: str = "embedding") -> DataFrame:
    return points.agg(F.count("*").alias("point_count"), F.max(F.size(vector_col)).alias("dimension"))


class CollectionError(ValueError):
    """Points that don't go with the collection they are meant for."""


def ensure(points: DataFrame, dim: int, sparse: bool, vector_col: str = "embedding", terms_col: str = "terms") -> DataFrame:
    """``points`` if every vector has ``dim`` components and term weights are there exactly if the collection has them; else CollectionError."""
    if sparse != (terms_col in points.columns):
        raise CollectionError(f"The collection has {'' if sparse else 'no '}term weights and the points have {'none' if sparse else 'some'}.")
    if odd := dimension_problems(points, dim, vector_col).select(F.coalesce(F.size(vector_col), F.lit(0)).alias("n")).limit(1).collect():
        raise CollectionError(f"The collection's vectors have {dim} components; one of the points' has {max(0, odd[0].n)}.")
    return points


def staleness(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> None:
    """Raises CollectionError if chunks and vectors were not made from one another."""
    if n := stale(chunks, vectors, key).count():
        raise CollectionError(f"{n:,} chunks and vectors don't belong together; embed the document again.")
