"""Model functions behind protocols, with deterministic defaults that need no service."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.session import ship

BATCH, RETRIES = 32, 3


class Embedder(Protocol):
    label: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """A row for each text."""


class TransientError(Exception):
    """What may succeed when tried again."""


class HashingEmbedder:
    """Signed feature hashing of words and their neighbours, to unit length; equal texts have equal vectors."""

    def __init__(self, dim: int = 64):
        self.dim, self.label = dim, f"hashing|{dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            words = text.lower().split()
            for gram in (*words, *(" ".join(p) for p in zip(words, words[1:], strict=False))):
                h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def with_retries(call, retries: int = RETRIES, wait=time.sleep):
    """The call's result; transient errors are tried again after 1, 2, 4, ... seconds."""
    for attempt in range(retries + 1):
        try:
            return call()
        except TransientError:
            if attempt == retries:
                raise
            wait(2**attempt)


def embed(df: DataFrame, embedder: Embedder, text_col: str = "text", to: str = "embedding") -> DataFrame:
    """``df`` with the texts' vectors (null for null), in batches of 32 through Arrow."""

    ship(df.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
            some = [t for t in texts if t is not None]
            vectors = iter([v for i in range(0, len(some), BATCH) for v in with_retries(lambda i=i: embedder.embed(some[i : i + BATCH])).tolist()])
            column = pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, to])

    return df.mapInArrow(batches, T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.FloatType()))]))


def cache_key(embedder: Embedder, text_col: str):
    """sha256 of model, size and text."""
    return F.sha2(F.concat_ws("|", F.lit(embedder.label), F.col(text_col)).cast("binary"), 256)


def embed_cached(df: DataFrame, embedder: Embedder, cache: DataFrame | None, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``df`` with vectors, the new cache rows (key, embedding)): only distinct texts that the cache lacks are embedded."""
    keyed = df.withColumn("_key", cache_key(embedder, text_col))
    wanted = keyed.where(F.col(text_col).isNotNull()).select("_key", text_col).groupBy("_key").agg(F.first(text_col).alias(text_col))
    missing = wanted if cache is None else wanted.join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")
    fresh = embed(missing, embedder, text_col).select(F.col("_key").alias("key"), "embedding")
    known = fresh if cache is None else cache.select("key", "embedding").unionByName(fresh)
    return keyed.join(known.withColumnRenamed("key", "_key"), "_key", "left").drop("_key"), fresh


@dataclass(frozen=True)
class Family:
    """What the embedding models whose name starts alike need."""

    document: str
    query: str
    sizes: tuple[int, ...] = ()  # that vectors can be cut to
    images: bool = False
    short: bool = False  # whether a model is known by what follows the colon in its name


#: Families by the start of their models' names, with the templates of their documents and queries. A name that none begins is plain.
FAMILIES = {
    "qwen3-embedding": Family("{text}", "Instruct: {instruction}\nQuery: {text}", (256, 512, 768, 1024), short=True),
    "embeddinggemma-2": Family("title: none | text: {text}", "task: search result | query: {text}", (128, 256, 512, 768), images=True),
    "": Family("{text}", "{text}"),
}
INSTRUCTION = "Given a question, retrieve passages of the documents that answer it"


def family_of(model: str) -> Family:
    return FAMILIES[max((p for p in FAMILIES if model.startswith(p)), key=len)]


def size_label(model: str) -> str:
    """A model's short name: its size where the family's models differ by it, else the whole name."""
    return model.rpartition(":")[2] if family_of(model).short else model


def size_problem(model: str, size: int | None) -> str | None:
    """Why vectors of a model can't have this size; None if they can."""
    sizes = family_of(model).sizes
    return None if size is None or not sizes or size in sizes else f"{model} gives vectors of {', '.join(map(str, sizes))}, not of {size}."


def template(text: Column, model: str, query: bool, instruction: str = INSTRUCTION) -> Column:
    """The text as documents, or queries, of the model's family are written."""
    form = family_of(model).query if query else family_of(model).document
    before, after = form.replace("{instruction}", instruction).split("{text}")
    return F.concat(F.lit(before), text, F.lit(after))


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        """From 0 to 1, how well each text answers its query."""


class OverlapReranker:
    """The share of a query's distinct words that the text has; needs no service."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = lambda t: set(re.findall(r"\w+", t.lower()))
        return [len(words(q) & words(t)) / max(1, len(words(q))) for q, t in pairs]


def rerank(pairs: DataFrame, reranker: Reranker, query_col: str = "question", text_col: str = "text", to: str = "score") -> DataFrame:
    """``pairs`` with their scores (null where either side is), in batches of 32 through Arrow; transient errors are tried again."""
    ship(pairs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            both = list(
                zip(
                    part.column(part.schema.get_field_index(query_col)).to_pylist(),
                    part.column(part.schema.get_field_index(text_col)).to_pylist(),
                    strict=True,
                )
            )
            some = [p for p in both if None not in p]
            scores = iter([s for i in range(0, len(some), BATCH) for s in with_retries(lambda i=i: reranker.score(some[i : i + BATCH]))])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([None if None in p else float(next(scores)) for p in both], pa.float64())],
                names=[*part.schema.names, to],
            )

    return pairs.mapInArrow(batches, T.StructType([*pairs.schema.fields, T.StructField(to, T.DoubleType())]))
