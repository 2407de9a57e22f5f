"""A kept graph index for dense search: vectors in cells, a navigable graph in each part of a cell, filters that act during the walk.

- Cells are the nearest of centroids, which are fitted on at most SAMPLE vectors; every vector is indexed. A cell of more than ``cell_rows`` vectors
  is dealt to parts by hash, each with a graph of its own, so no task holds more, however many vectors are alike.
- Points with the same vector and payload are one node with the least ``most`` of their ids: a search for up to ``most`` answers can return no other.
- A node is linked to ``m`` of its ``ef_construct`` nearest, those that no nearer link already leads to, and back (at most 2 m links), and to the nearest
  of the nodes before it: from the first node every node can be reached.
- A search goes to the ``cells`` nearest to the query and walks each of their graphs with a beam of ``ef``. Nodes that the filter refuses are walked over
  and not counted, so the walk ends only when ``ef`` admitted nodes are found or the part is exhausted; where the filter admits fewer nodes of a part than
  a walk looks at, all of them are scored, and cells without any are passed by. Queries that still lack answers are answered by an exact scan of what the filter admits.

On disk a cell is a folder, so a search reads its cells alone.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from heddle.functions.vectors import norm
from heddle.operators.search import dense_search_batch, equals
from heddle.session import Stored, ship

SAMPLE = 20_000
MOST_CELLS = 2_048
SALTS = 32
ROUNDS = 10  # of fitting the centroids
SLICE_QUERIES = 2_000  # queries that one task takes through one graph
BLOCK_VALUES = 1_000_000  # 8 MB of doubles, that a task holds of each matrix at once


@dataclass(frozen=True)
class Shape:
    """What an index is built with. ``most`` is the largest number of answers that its searches can ask for."""

    m: int = 16
    ef_construct: int = 100
    cell_rows: int = 8_192
    most: int = 100


class GraphProblem(ValueError):
    """A search that an index can't answer."""


@dataclass(frozen=True)
class Graph:
    """An index in a folder: ``nodes`` by cell, and ``centroids`` with the number of parts of each cell (at most MOST_CELLS rows)."""

    spark: SparkSession
    path: str
    shape: Shape
    payload: tuple[str, ...]
    schema: T.StructType

    @property
    def nodes(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/nodes")

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids")


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), dim)


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors by cosine; the same sample gives the same."""
    own = _unit(sample)
    at = own[np.linspace(0, len(own) - 1, min(cells, len(own))).astype(int)]
    for _ in range(ROUNDS):
        near = (own @ at.T).argmax(1)
        total = np.zeros_like(at)
        np.add.at(total, near, own)
        full = np.bincount(near, minlength=len(at)) > 0
        at = np.where(full[:, None], _unit(total), at)
    return at


def links(v: np.ndarray, m: int, ef_construct: int) -> list[np.ndarray]:
    """The links of each of some unit vectors: diverse near ones in both directions, and the nearest one before it."""
    n, dim = v.shape
    wide = min(ef_construct, n - 1)
    if wide < 1:
        return [np.zeros(0, np.int32)] * n
    rows = max(16, min(512, BLOCK_VALUES // max(n, wide * max(dim, wide))))
    sources, targets, parents = [], [], [np.zeros(0, np.int64)]
    for start in range(0, n, rows):
        own = np.arange(start, min(n, start + rows))
        s = v[own] @ v.T
        s[np.arange(len(own)), own] = -np.inf
        if (later := own[own > 0]).size:
            earlier = np.where(np.arange(n)[None] < later[:, None], s[-len(later) :], -np.inf)
            parents.append(earlier.argmax(1))
        near = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        to_own = np.take_along_axis(s, near, 1)
        among = np.einsum("bid,bjd->bij", v[near], v[near], optimize=True)
        kept = np.zeros(near.shape, bool)
        for j in range(wide):  # a near one stays if none that stays is nearer to it
            closest = np.where(kept, among[:, j], -np.inf).max(1)
            kept[:, j] = (closest < to_own[:, j]) & (kept.sum(1) < m)
        i, j = np.nonzero(kept)
        sources.append(own[i])
        targets.append(near[i, j])
    a, b = np.concatenate(sources), np.concatenate(targets)
    both = np.unique(np.stack([np.concatenate([a, b]), np.concatenate([b, a])]), axis=1)
    order = np.lexsort((both[1], -np.einsum("ed,ed->e", v[both[0]], v[both[1]]), both[0]))
    a, b = both[:, order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    a, b = a[place < 2 * m], b[place < 2 * m]
    child, parent = np.arange(1, n), np.concatenate(parents)
    whole = np.unique(np.stack([np.concatenate([a, child, parent]), np.concatenate([b, parent, child])]), axis=1)
    return np.split(whole[1].astype(np.int32), np.searchsorted(whole[0], np.arange(1, n)))


def walk(query: np.ndarray, v: np.ndarray, near: list[np.ndarray], admitted: np.ndarray, ef: int) -> list[tuple[float, int]]:
    """The (score, node) of up to ``ef`` admitted nodes, best first, met on a walk from the first node."""
    seen = np.zeros(len(v), bool)
    seen[0] = True
    score = float(v[0] @ query)
    open_, found = [(-score, 0)], [(score, 0)] if admitted[0] else []
    while open_:
        best, at = heapq.heappop(open_)
        if len(found) == ef and -best < found[0][0]:
            break
        new = near[at][~seen[near[at]]]
        seen[new] = True
        scores = v[new] @ query
        for score, node in zip(scores.tolist(), new.tolist(), strict=True):
            if len(found) == ef and score < found[0][0]:
                continue
            heapq.heappush(open_, (-score, node))
            if admitted[node]:
                (heapq.heappushpop if len(found) == ef else heapq.heappush)(found, (score, node))
    return sorted(found, key=lambda x: (-x[0], x[1]))


def _to_cells(part: pa.RecordBatch, centres: np.ndarray, count: int) -> Iterator[pa.RecordBatch]:
    """Each row ``count`` times, in batches of up to BLOCK_VALUES numbers however many cells there are."""
    step = max(1, BLOCK_VALUES // max(1, len(centres), count * centres.shape[1]))
    for start in range(0, part.num_rows, step):
        own = part.slice(start, step)
        s = _matrix(own.column("vector"), centres.shape[1]) @ centres.T
        cells = np.argsort(-s, axis=1, kind="stable")[:, :count]
        out = own.take(pa.array(np.repeat(np.arange(len(s)), count)))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells.ravel().astype(np.int32))], names=[*out.schema.names, "cell"])


def _nearest(rows: DataFrame, at: np.ndarray, count: int, schema: str) -> DataFrame:
    """Rows with a last column ``vector``, each with ``cell``, the places of its ``count`` nearest centroids, a row for each."""
    shared = rows.sparkSession.sparkContext.broadcast(at)  # at most MOST_CELLS vectors
    count = min(count, len(at))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield from _to_cells(part, shared.value, count)

    return rows.mapInArrow(batches, schema)


def build(
    points: DataFrame,
    path: str,
    shape: Shape = Shape(),
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    payload: tuple[str, ...] = (),
) -> Graph:
    """Writes the index of ``points`` to a new folder. ``payload`` columns can be filtered by.

    Null and zero vectors, null ids and vectors of another length than the longest have no cosine and are left out; without any vector the
    index is empty and finds nothing.
    """
    spark = points.sparkSession
    ship(spark)
    named = [F.col(c).alias(f"p_{c}") for c in payload]
    keys = [f"p_{c}" for c in payload]
    pool = points.select(F.col(id_col).alias("id"), *named, F.col(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL")
    pool = pool.where(norm(F.col("vector")) > 0)
    dim, total = pool.agg(F.max(F.size("vector")), F.count("*")).first()
    dim = dim or 0
    pool = pool.where(F.size("vector") == dim)
    salted = Window.partitionBy("vector", *keys, F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    least = pool.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= shape.most).drop("_n")
    # at most SALTS x most rows of a vector are left, whatever it had
    nodes = least.groupBy(*keys, "vector").agg(F.slice(F.sort_array(F.collect_list("id")), 1, shape.most).alias("ids")).select("ids", *keys, "vector")
    nodes = Stored(nodes).df
    count = nodes.count()
    cells = max(1, min(MOST_CELLS, -(-2 * count // shape.cell_rows)))
    sample = nodes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(min(SAMPLE, 64 * cells)).collect() if count else []
    at = fit(np.array([r.vector for r in sample], np.float64), cells) if sample else np.zeros((0, dim))
    kind = dict(nodes.dtypes)
    wide = ", ".join(f"`{c}` {kind[c]}" for c in nodes.columns)
    unit = nodes.withColumn("vector", F.transform("vector", lambda x: x / norm(F.col("vector")))) if count else nodes
    placed = Stored(_nearest(unit, at, 1, f"{wide}, cell int") if count else unit.withColumn("cell", F.lit(0))).df
    sizes = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most MOST_CELLS rows
    parts = [-(-sizes.get(c, 0) // shape.cell_rows) for c in range(len(at))]
    centroids = spark.createDataFrame([(c, parts[c], [float(x) for x in at[c]]) for c in range(len(at))], "cell int, parts int, vector array<double>")
    centroids.coalesce(1).write.parquet(f"{path}/centroids")
    dealt = placed.join(F.broadcast(centroids.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int")).drop("parts")
    m, ef_construct = shape.m, shape.ef_construct

    def linked(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort([x[0] for x in table.column("ids").to_pylist()], kind="stable")))
        near = links(_matrix(table.column("vector"), dim), m, ef_construct)
        return table.append_column("near", pa.array(near, pa.list_(pa.int32()))).append_column("pos", pa.array(np.arange(len(table)), pa.int32()))

    order = ["cell", "part", "ids", *keys, "vector"]
    schema = f"cell int, part int, {wide}, near array<int>, pos int"
    graph = dealt.select(order).groupBy("cell", "part").applyInArrow(linked, schema)
    graph.write.partitionBy("cell").parquet(f"{path}/nodes")
    about = {"shape": asdict(shape), "payload": list(payload), "schema": graph.schema.jsonValue()}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
    return open_graph(spark, path)


def open_graph(spark: SparkSession, path: str) -> Graph:
    """The index that ``build`` wrote there, with all its parts; one that it did not finish has no ``about`` and can't be opened."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    return Graph(spark, path, Shape(**about["shape"]), tuple(about["payload"]), T.StructType.fromJson(about["schema"]))


def _where(index: Graph, filters: dict[str, object] | None) -> Column | None:
    if odd := sorted(set(filters or {}) - set(index.payload)):
        raise GraphProblem(f"The index can't filter by {', '.join(odd)}.")
    return equals({f"p_{c}": x for c, x in (filters or {}).items()})


def _holding(index: Graph, where: Column | None) -> list[Row]:
    """The cells that hold anything the filter admits, by number: at most MOST_CELLS rows."""
    known = sorted(index.centroids.where("parts > 0").collect(), key=lambda r: r.cell)
    if where is None:
        return known
    holding = {r.cell for r in index.nodes.where(where).select("cell").distinct().collect()}
    return [r for r in known if r.cell in holding]


def cells_for(
    index: Graph,
    queries: DataFrame,
    top_k: int,
    share: float = 0.95,
    query_col: str = "query_id",
    vector_col: str = "vector",
    filters: dict[str, object] | None = None,
    sample: int = 200,
) -> int:
    """How many cells a search of such queries must go to for ``share`` of the exact answers to be in them; at least one.

    It is measured with an exact scan for at most ``sample`` of the queries. How many it takes depends on the vectors (clustered ones need few), on
    their number and on the filter, so it is worth finding out once for each kind of search.
    """
    where = _where(index, filters)
    known = _holding(index, where)
    if not known:
        return 1
    some = queries.select(F.col(query_col).alias("q"), F.col(vector_col).cast("array<double>").alias("v"))
    some = some.where((norm(F.col("v")) > 0) & (F.size("v") == len(known[0].vector)))
    some = Stored(some.orderBy(F.xxhash64("q"), "q").limit(sample)).df
    admitted = index.nodes if where is None else index.nodes.where(where)
    each = admitted.select("cell", F.explode(F.slice("ids", 1, top_k)).alias("id"), "vector")
    exact = dense_search_batch(each.select("id", "vector"), some, top_k, "id", query_col="q", vector_col="vector", query_vector_col="v")
    placed = Stored(each.select("id", "cell").join(F.broadcast(Stored(exact.select("q", "id")).df), "id")).df.collect()  # sample x top_k rows
    if not placed:
        return 1
    at, cell = np.array([r.vector for r in known]), {r.cell: i for i, r in enumerate(known)}
    asked = {r.q: np.array(r.v, np.float64) for r in some.collect()}
    place = {q: np.argsort(np.argsort(-(at @ v), kind="stable")) for q, v in asked.items()}
    depth = sorted(int(place[r.q][cell[r.cell]]) + 1 for r in placed)
    return depth[min(len(depth) - 1, int(np.ceil(share * len(depth))) - 1)]


def search(
    index: Graph,
    queries: DataFrame,
    top_k: int,
    id_col: str = "chunk_id",
    query_col: str = "query_id",
    vector_col: str = "vector",
    filters: dict[str, object] | None = None,
    ef: int = 96,
    cells: int = 8,
) -> DataFrame:
    """(query_id, rank, id, score): the nearest points that the filter admits, by cosine, ties by id; approximate.

    A query is named once. A query without a vector, or with a zero one, has no answers. ``filters`` are equalities on the index's payload columns. More ``cells`` (see ``cells_for``) and a larger ``ef``
    find more and cost more.
    """
    if top_k > index.shape.most:
        raise GraphProblem(f"The index keeps {index.shape.most} ids of a vector and can't give {top_k} answers.")
    spark = index.spark
    ship(spark)
    where = _where(index, filters)
    id_kind = dict(index.nodes.dtypes)["ids"][6:-1]
    known = _holding(index, where)
    dim = len(known[0].vector) if known else 0
    raw = queries.select(F.col(query_col).alias("q"), F.col(vector_col).cast("array<double>").alias("vector"))
    raw = raw.where((norm(F.col("vector")) > 0) & (F.size("vector") == dim))
    asked = Stored(raw.withColumn("vector", F.transform("vector", lambda x: x / norm(F.col("vector"))))).df
    q_kind = dict(asked.dtypes)["q"]
    empty = spark.createDataFrame([], f"q {q_kind}, id {id_kind}, score double")
    if not known:
        return empty.select(F.col("q").alias(query_col), F.lit(1).cast("long").alias("rank"), F.col("id").alias(id_col), "score")
    to = _nearest(asked, np.array([r.vector for r in known]), cells, f"q {q_kind}, vector array<double>, cell int")
    to = Stored(to.withColumn("cell", F.get(F.array(*[F.lit(r.cell) for r in known]), F.col("cell")))).df
    load = {r.cell: r["count"] for r in to.groupBy("cell").count().collect()}
    plan = spark.createDataFrame([(r.cell, r.parts, -(-load[r.cell] // SLICE_QUERIES)) for r in known if r.cell in load], "cell int, parts int, slices int")
    sent = to.join(F.broadcast(plan), "cell").withColumn("slice", F.pmod(F.xxhash64("q"), F.col("slices")).cast("int"))
    sent = sent.select("q", "vector", "cell", "slice", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    admits = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    read = index.nodes.where(F.col("cell").isin(sorted(load))).withColumn("admitted", admits)
    read = read.join(F.broadcast(plan.select("cell", "slices")), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    read = read.select("cell", "part", "slice", "pos", "ids", "vector", "near", "admitted")
    out_schema = f"q {q_kind}, id {id_kind}, score double"
    arrow, width = empty.toArrow().schema, index.shape.m

    def answers(queries_: pa.Table, nodes: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(nodes) and len(queries_):
            nodes = nodes.sort_by("pos")
            v, near = _matrix(nodes.column("vector"), dim), nodes.column("near").combine_chunks()
            near = np.split(near.flatten().to_numpy(), near.offsets.to_numpy()[1:-1] - near.offsets.to_numpy()[0])
            admitted = nodes.column("admitted").to_numpy()
            ids = nodes.column("ids")
            few = np.flatnonzero(admitted)
            for q, x in zip(queries_.column("q").to_pylist(), _matrix(queries_.column("vector"), dim), strict=True):
                if len(few) < min(len(v), ef * width):  # fewer than a walk looks at
                    met = sorted(zip((v[few] @ x).tolist(), few.tolist(), strict=True), key=lambda e: (-e[0], e[1]))
                else:
                    met = walk(x, v, near, admitted, max(ef, top_k))
                own = []
                for score, node in met:
                    if len(own) >= top_k and round(score, 9) < round(own[top_k - 1][0], 9):
                        break
                    own += [(score, i) for i in ids[node].as_py()[:top_k]]
                own.sort(key=lambda e: (-round(e[0], 9), e[1]))
                rows += [(q, i, score) for score, i in own[:top_k]]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(3)], names=["q", "id", "score"])

    by = ["cell", "part", "slice"]
    met = sent.groupBy(by).cogroup(read.groupBy(by)).applyInArrow(answers, out_schema)
    order = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "id")
    best = Stored(met.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k)).df
    short = asked.join(best.where(F.col("rank") == top_k).select("q"), "q", "left_anti")
    if len(load) and len(known) > cells and short.limit(1).count():
        admitted = index.nodes if where is None else index.nodes.where(where)
        each = admitted.select(F.explode(F.slice("ids", 1, top_k)).alias("id"), "vector")
        exact = dense_search_batch(each, Stored(short).df, top_k, "id", query_col="q", vector_col="vector").select("q", "id", "score", "rank")
        best = best.join(short.select("q"), "q", "left_anti").unionByName(exact)
    return best.select(F.col("q").alias(query_col), "rank", F.col("id").alias(id_col), "score")
