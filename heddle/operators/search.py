"""Dense and hybrid search, reranking, the score gate and the bounded rewrite loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions.text import tokens
from heddle.functions.vectors import cosine
from heddle.operators.lexical import ranked, sparse_search
from heddle.session import Stored, ship

RRF_K = 2  # ranks count from 0
BLOCK_VALUES = 2_000_000  # 16 MB of doubles
BATCH_ROWS = 4_096  # vectors that a task multiplies by a block at once


def equals(filters: dict[str, object] | None) -> Column | None:
    """The conjunction of equalities that a search filters by, before its limit."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in filters.items()]) if filters else None


def dense_search(
    chunks: DataFrame,
    query: Column,
    top_k: int,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    filters: dict[str, object] | None = None,
) -> DataFrame:
    """(rank, id, score): the nearest vectors by cosine, ties by id. The filter and the columns read reach the scan."""
    where = equals(filters)
    pool = chunks if where is None else chunks.where(where)
    beside = pool.select(id_col, vector_col, query.alias("_query"))
    return ranked(beside.select(id_col, cosine(F.col(vector_col), F.col("_query")).alias("score")).where("score IS NOT NULL"), top_k, id_col)


def dense_search_batch(
    chunks: DataFrame,
    queries: DataFrame,
    top_k: int,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    query_col: str = "query_id",
    query_vector_col: str = "vector",
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """(query_id, rank, id, score) for a table of query vectors, ties by id.

    The queries go out in blocks of at most ``block_values`` numbers, each a broadcast matrix. A task multiplies every batch of chunks by
    it and keeps the best ``top_k`` of each query, so what is shuffled follows tasks x queries x top_k, not pairs. Null vectors are
    left out on both sides; no queries give no rows.
    """
    ship(chunks.sparkSession)
    asked = queries.select(F.col(query_col).alias("q"), F.col(query_vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    pool = chunks.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    schema = f"q {dict(asked.dtypes)['q']}, id {dict(pool.dtypes)['id']}, score double"
    size, dim = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-size * (dim or 1) // block_values))
    found = None
    for block in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        rows = own.collect()  # at most about block_values numbers
        part = pool.mapInArrow(_best_of(chunks.sparkSession, rows, dim or 0, top_k), schema)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "id")
    best = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k)
    return best.select(F.col("q").alias(query_col), "rank", F.col("id").alias(id_col), "score")


def _best_of(spark: SparkSession, queries: list, dim: int, top_k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, v) to the best ``top_k`` (q, id, score) of each query in the task."""
    matrix = np.array([r["v"] for r in queries], np.float64).reshape(len(queries), dim)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    shared = spark.sparkContext.broadcast(([r["q"] for r in queries], matrix))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = shared.value
        ids, scores = np.zeros((0, len(names)), object), np.zeros((0, len(names)))  # by rank and query
        for part in (whole.slice(start, BATCH_ROWS) for whole in parts for start in range(0, whole.num_rows, BATCH_ROWS)):
            if not names:
                continue
            part = part.take(pc.sort_indices(part.column(0)))
            v = np.stack(part.column(1).to_numpy(zero_copy_only=False))
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            own = np.array(part.column(0).to_pylist(), object)
            new_ids, new_scores = [], []
            for start in range(0, len(names), 256):
                some = slice(start, start + 256)
                s = v @ m[some].T
                n = min(top_k, len(s))
                edge = np.partition(s, len(s) - n, axis=0)[len(s) - n] - 1e-9
                if len(scores) == top_k:  # what the task has already found is a bar too
                    edge = np.maximum(edge, scores[-1, some] - 1e-9)
                rows = np.flatnonzero((s >= edge).any(1))
                i, x = _first(
                    np.concatenate([ids[:, some], np.repeat(own[rows][:, None], s.shape[1], 1)]),
                    np.concatenate([scores[:, some], s[rows]]),
                    top_k,
                )
                new_ids.append(i)
                new_scores.append(x)
            ids, scores = np.concatenate(new_ids, 1), np.concatenate(new_scores, 1)
        if ids.size:
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for q in names for _ in range(len(ids))]), pa.array(ids.T.ravel().tolist()), pa.array(scores.T.ravel())],
                names=["q", "id", "score"],
            )

    return batches


def _first(ids: np.ndarray, scores: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best rows of each column: by score at nine decimals, then by id."""
    keep = min(top_k, len(ids))
    by_id = np.argsort(ids, axis=0, kind="stable")
    ids, scores = np.take_along_axis(ids, by_id, 0), np.take_along_axis(scores, by_id, 0)
    best = np.argsort(-np.round(scores, 9), axis=0, kind="stable")[:keep]
    return np.take_along_axis(ids, best, 0), np.take_along_axis(scores, best, 0)


def branch_limit(candidates: int, top_k: int) -> int:
    """How many hits each branch of a hybrid search gives."""
    return max(candidates, top_k)


def hybrid_search(
    chunks: DataFrame,
    query: Column,
    terms: list[str],
    top_k: int,
    candidates: int = 20,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    text_col: str = "text",
    filters: dict[str, object] | None = None,
    k: int = RRF_K,
) -> DataFrame:
    """(rank, id, score): dense and lexical branches under the same filter, each with its own limit, fused.

    Raises ValueError where the collection has no texts to weigh terms by.
    """
    missing = [c for c in (id_col, vector_col, text_col) if c not in chunks.columns]
    if missing:
        raise ValueError(f"A hybrid search needs the column {missing[0]}; index the collection with term weights or search it by vectors alone.")
    limit = branch_limit(candidates, top_k)
    return fuse(
        [dense_search(chunks, query, limit, id_col, vector_col, filters), sparse_search(chunks, terms, limit, id_col, text_col, equals(filters))],
        top_k,
        id_col,
        k,
    )


def first_pictures(hits: DataFrame, most: int) -> DataFrame:
    """The first ``most`` hits that are pictures, by rank."""
    return hits.where("modality = 'picture'").orderBy("rank").limit(most)


def fuse(branches: list[DataFrame], top_k: int, id_col: str, k: int = RRF_K) -> DataFrame:
    """(rank, id, score): reciprocal-rank fusion of ranked branches, the sum of 1 / (k + rank from 0)."""
    rows = reduce(DataFrame.unionByName, [b.select(id_col, "rank") for b in branches])
    return ranked(rows.groupBy(id_col).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank") - F.lit(1))).alias("score")), top_k, id_col)


def lexical_overlap(query: Column, text: Column) -> Column:
    """The deterministic reranker: the share of the query's distinct tokens that the text has, 0 to 1."""
    asked = F.array_distinct(tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, tokens(text))), F.size(asked)), F.lit(0.0))


def yes_probability(top: Column) -> Column:
    """p(yes) / (p(yes) + p(no)) from (token, logprob) pairs, spellings summed; 0 if neither is there."""
    mass = lambda word: F.aggregate(F.filter(top, lambda t: F.lower(F.trim(t["token"])) == word), F.lit(0.0), lambda s, t: s + F.exp(t["logprob"]))
    return F.coalesce(F.try_divide(mass("yes"), mass("yes") + mass("no")), F.lit(0.0))


def rerank_merge(scored: DataFrame, hits: DataFrame, score: Callable[[DataFrame], DataFrame], top_k: int, id_col: str = "chunk_id") -> DataFrame:
    """(rank, id, score, seq): only hits that have no score yet are scored; the best of all stay, earlier ones first on ties."""
    fresh = score(hits.join(scored.select(id_col), id_col, "left_anti"))
    start = scored.agg(F.coalesce(F.max("seq"), F.lit(0))).scalar()
    new = fresh.select(id_col, "score", (start + F.row_number().over(Window.orderBy("rank", id_col))).cast("long").alias("seq"))
    best = scored.select(id_col, "score", "seq").unionByName(new).orderBy(F.desc("score"), "seq").limit(top_k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "seq")).cast("long").alias("rank"), id_col, "score", "seq")


def above(hits: DataFrame, least: float) -> DataFrame:
    """Hits at or above the floor; ranks stay as they are."""
    return hits.where(F.col("score") >= least)


def enough(hits: DataFrame, threshold: float, by: str | None = None) -> DataFrame:
    """Whether the best score reaches the threshold; no hits count as 0."""
    best = F.coalesce(F.max("score"), F.lit(0.0))
    grouped = hits.groupBy(by) if by else hits.groupBy()
    return grouped.agg(best.alias("best_score"), (best >= threshold).alias("enough"))


def after_grade(is_enough: bool, rewrites: int, max_rewrites: int) -> str:
    return "generate" if is_enough else "rewrite" if rewrites < max_rewrites else "abstain"


def after_rewrite(is_new: bool, rewrites: int, max_rewrites: int) -> str:
    return "retrieve" if is_new else "rewrite" if rewrites < max_rewrites else "abstain"


def answer_batch(
    questions: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    rewrite: Callable[[DataFrame], DataFrame],
    threshold: float,
    max_rewrites: int,
) -> tuple[DataFrame, DataFrame]:
    """(resolved, abstained) questions after at most ``max_rewrites`` + 1 searches, each over all that are unresolved.

    ``questions`` has (query_id, question); ``search`` gives (query_id, rank, id, score); ``rewrite`` gives new questions.
    Each round's grades are written, so that the next round starts from what is left.
    """
    done, open_ = None, questions.select("query_id", "question")
    for attempt in range(max_rewrites + 1):
        best = search(open_).groupBy("query_id").agg(F.max("score").alias("best_score"))
        met = open_.join(best, "query_id", "left").withColumn("best_score", F.coalesce("best_score", F.lit(0.0)))
        graded = Stored(met.withColumn("searches", F.lit(attempt + 1).cast("long"))).df  # else the next search would repeat this one
        found = graded.where(F.col("best_score") >= threshold)
        done = found if done is None else done.unionByName(found)
        left = graded.where(F.col("best_score") < threshold)
        open_ = rewrite(left.select("query_id", "question")) if attempt < max_rewrites else left
    return done, open_
