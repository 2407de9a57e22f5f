"""An approximate index for dense search: random hyperplanes in several tables.

A vector's place in a table is the signs of its products with the table's hyperplanes. A query looks at its own place and at those one sign
away; what it finds there is scored exactly. More tables find more and cost more rows, more planes make places smaller. An
exact scan (``search.dense_search``) needs no index and misses nothing; this is for collections that are too large for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.session import Stored

SLICE = 4096  # points or queries of a place that meet in one task


@dataclass(frozen=True)
class Planes:
    """What an index is built with; the same numbers give the same planes on every machine."""

    dim: int
    tables: int = 12
    planes: int = 12
    seed: int = 7

    def matrix(self) -> np.ndarray:
        """Tables x planes x dim."""
        return np.random.default_rng(self.seed).normal(size=(self.tables, self.planes, self.dim))


def _places(vector: Column, planes: Planes) -> Column:
    """An array of the vector's place in each table."""
    matrix = planes.matrix()
    wide = F.transform(vector, lambda x: x.cast("double"))

    def sign(row: np.ndarray) -> Column:
        plane = F.split(F.lit(",".join(repr(float(x)) for x in row)), ",").cast("array<double>")  # one literal
        return (F.aggregate(F.zip_with(wide, plane, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) >= 0).cast("long")

    return F.array(*[sum((F.shiftleft(sign(matrix[t, p]), p) for p in range(planes.planes)), F.lit(0).cast("long")) for t in range(planes.tables)])


def index(points: DataFrame, planes: Planes, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """(table, place, id, vector) of every point with a vector; write it partitioned by table and sorted by place."""
    found = points.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    each = Stored(found.withColumn("places", _places(F.col("vector"), planes))).df
    return each.select(F.posexplode("places").alias("table", "place"), "id", "vector")


def search(
    indexed: DataFrame,
    queries: DataFrame,
    planes: Planes,
    top_k: int,
    query_col: str = "query_id",
    vector_col: str = "vector",
    probes: bool = True,
) -> DataFrame:
    """(query, rank, id, score): the nearest of the points found, by cosine, ties by id.

    ``probes`` also looks one sign away in every table. Points meet the queries that look at their place in slices of at most about SLICE of both, and a
    slice gives each of its queries its best alone, so what is shuffled are the index, the queries and ``top_k`` rows for each look, not
    all pairs. Vectors without a direction (zero, or not of numbers) are not found.
    """
    asked = queries.select(F.col(query_col).alias("q"), F.col(vector_col).alias("asked")).where("asked IS NOT NULL")
    places = Stored(asked.withColumn("places", _places(F.col("asked"), planes))).df.select("q", "asked", F.posexplode("places").alias("table", "place"))
    flips = F.array(F.lit(0).cast("long"), *([F.lit(1 << p).cast("long") for p in range(planes.planes)] if probes else []))
    looked = places.select("q", "asked", "table", F.explode(F.transform(flips, lambda x: F.col("place").bitwiseXOR(x))).alias("place"))
    at = ["table", "place"]
    parts = lambda rows, name: rows.groupBy(at).agg(F.ceil(F.count("*") / SLICE).alias(name))
    met = Stored(parts(indexed, "n_points").join(parts(looked, "n_queries"), at)).df  # at most a row for each place of each table
    dealt = lambda key, own, other: (F.pmod(F.xxhash64(key), F.col(own)).alias(own[2:]), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other[2:]))
    by = [*at, "points", "queries"]
    points = indexed.join(F.broadcast(met), at).select(*at, "id", "vector", *dealt("id", "n_points", "n_queries")).groupBy(by)
    wanting = looked.join(F.broadcast(met), at).select(*at, "q", "asked", *dealt("q", "n_queries", "n_points")).groupBy(by)
    types = dict(asked.dtypes) | dict(indexed.dtypes)
    each = points.cogroup(wanting).applyInArrow(_best_of_slice(top_k), f"q {types['q']}, id {types['id']}, score double")
    scored = each.groupBy("q", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "id")
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k)
    return best.select(F.col("q").alias(query_col), "rank", "id", "score")


def _best_of_slice(top_k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Points (id, vector) and queries (q, asked) of a slice to each query's best (q, id, score)."""

    def units(rows: pa.Table, column: str, key: str) -> tuple[pa.Table, np.ndarray]:
        rows = rows.take(pc.sort_indices(rows, [(key, "ascending")]))
        wide = rows.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
        length = np.linalg.norm(wide, axis=1, keepdims=True)
        held = np.isfinite(length[:, 0]) & (length[:, 0] > 0)
        return rows.filter(pa.array(held)), wide[held] / length[held]

    def best(points: pa.Table, queries: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if points.num_rows and queries.num_rows:
            (points, v), (queries, m) = units(points, "vector", "id"), units(queries, "asked", "q")
            for start in range(0, len(m) if len(v) else 0, 256):
                s = np.clip(v @ m[start : start + 256].T, -1.0, 1.0)
                near = np.round(s, 9)
                n = min(top_k, len(s))
                query, row = np.nonzero((near >= np.partition(near, len(s) - n, axis=0)[len(s) - n]).T)  # rows by id
                order = np.lexsort((row, -near[row, query], query))
                query, row = query[order], row[order]
                first = np.arange(len(query)) - np.searchsorted(query, query) < n
                out.append((query[first] + start, row[first], s[row[first], query[first]]))
        query, row, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"q": queries.column("q").take(pa.array(query)), "id": points.column("id").take(pa.array(row)), "score": pa.array(score)})

    return best


def recall(found: DataFrame, exact: DataFrame, query_col: str = "query_id", found_id: str = "id", exact_id: str = "id") -> float:
    """The share of the exact answers that were found."""
    wanted = exact.select(F.col(query_col).alias("q"), F.col(exact_id).alias("i"))
    hit = wanted.join(found.select(F.col(query_col).alias("q"), F.col(found_id).alias("i")), ["q", "i"], "left_semi").count()
    return hit / max(1, wanted.count())
