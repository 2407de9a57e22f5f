"""Good answers kept as examples: saved once, found by likeness, indexed from their table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators import models, search
from heddle.operators.registry import first_of


def save(table: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Examples (schema_name, question, standalone, sql, turn_id) with new ones added; of equal ones the first turn stays."""
    every = rows if table is None else table.unionByName(rows)
    keyed = every.withColumns({"_q": F.md5("standalone"), "_s": F.md5("sql")})
    return first_of(keyed, ["schema_name", "_q", "_s"], [F.col("turn_id")]).select(every.columns)


def index(table: DataFrame, embedder: models.Embedder) -> DataFrame:
    """The searchable form, made from the table alone, so that it can be made again at any time."""
    return models.embed(table.withColumn("embed_key", F.lit(embedder.label)), embedder, "standalone")


def retrieve(indexed: DataFrame, question: Column, schema: str, embed_key: str, k: int = 3, least: float = 0.5) -> DataFrame:
    """(rank, turn_id, score): the k nearest of this schema and embedding, then those at or above the threshold."""
    near = search.dense_search(indexed, question, k, "turn_id", filters={"schema_name": schema, "embed_key": embed_key})
    return near.where(F.col("score") >= least)


def without(indexed: DataFrame, turn_id: object) -> DataFrame:
    """The index without a turn's example; the table goes first, so that the index can always be made from it again."""
    return indexed.where(~F.col("turn_id").eqNullSafe(F.lit(turn_id)))


def fits(indexed: DataFrame, embedder: models.Embedder) -> bool:
    """Whether the index was made with this embedding: its key and the size of its vectors; if not, make it again."""
    odd = indexed.where((F.col("embed_key") != embedder.label) | (F.size("embedding") != embedder.dim))
    return odd.limit(1).count() == 0
