"""Queries over indexes that are kept: each makes one by batches of changes and asks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import graph, lexindex, search
from heddle.plans.search_plans import _ASKED, _batch
from heddle.session import Folder
from heddle.sources import store
from heddle.sources.snapshots import Snapshot
from heddle.sources.tables import table

AWAY = 1_000_000_000_000  # documents that are only there for a while have ids beyond this


def _index(spark: SparkSession, sf_dir: str) -> Snapshot:
    """An index of all documents, after batches that added some, wrote some anew and took others off."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = lexindex.open_index(spark, Folder(spark).path)
    old = docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.reverse("text")).otherwise(F.col("text")))
    away = docs.where("doc_id % 7 = 0").select((F.col("doc_id") + AWAY).alias("doc_id"), "text")
    lexindex.update(index, old.unionByName(away))
    return lexindex.update(index, docs.where("doc_id % 3 = 0 OR doc_id % 5 = 0"), away.select("doc_id"))


def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document frequency of every term in an index that batches have changed."""
    terms = _index(spark, sf_dir).table("terms").groupBy("term").agg(F.sum("df").alias("df"))
    return terms.where("df > 0")


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three documents of each benchmark item, by the index."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return lexindex.search(_index(spark, sf_dir), asked, 3).withColumn("score", F.round("score", 6))


def _graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return graph.build(table(spark, sf_dir, "embeddings"), Folder(spark).path, id_col="vec_id", payload=("label",))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def graph_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and different ones of each label that a graph index holds, and how many of its nodes nothing links to."""
    nodes = _graph(spark, sf_dir).nodes
    led_to = nodes.select("cell", "part", F.explode("near").alias("pos")).distinct().withColumn("linked", F.lit(1))
    beside = nodes.select("cell", "part", "pos", F.col("p_label").alias("label")).join(led_to, ["cell", "part", "pos"], "left")
    alone = beside.where("linked IS NULL AND pos > 0").groupBy("label").agg(F.count("*").alias("apart"))
    held = nodes.groupBy(F.col("p_label").alias("label")).agg(F.count("*").alias("vectors"))
    return held.join(alone, "label", "left").select("label", "vectors", F.coalesce("apart", F.lit(0).cast("long")).alias("apart"))


def graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the exact five nearest vectors that the graph index finds for every twentieth, of all and of label 3 alone.

    A vector as near as the fifth is as good as it.
    """
    vectors, asked, index = table(spark, sf_dir, "embeddings"), _near(spark, sf_dir), _graph(spark, sf_dir)
    out = None
    for name, filters in (("all", None), ("label 3", {"label": 3})):
        pool = vectors if filters is None else vectors.where("label = 3")
        found = graph.search(index, asked, 5, "vec_id", filters=filters, cells=graph.cells_for(index, asked, 5, filters=filters))
        exact = search.dense_search_batch(pool, asked, 5, "vec_id")
        bar = exact.groupBy("query_id").agg(F.count("*").alias("wanted"), F.min(F.round("score", 9)).alias("bar"))
        hits = found.join(bar, "query_id").where(F.round("score", 9) >= F.col("bar")).groupBy("query_id").agg(F.count("*").alias("hits"))
        both = bar.join(hits, "query_id", "left").agg(F.sum("wanted").alias("wanted"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
        row = both.select(F.lit(name).alias("searched"), "wanted", "hits", F.round(F.try_divide("hits", "wanted"), 4).alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


def payload_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents with ids from 100 to 199, out of all documents written with payload indexes."""
    at = Folder(spark).path
    store.write_indexed(table(spark, sf_dir, "documents"), f"{at}/points", ("doc_id", "lang", "source"), ("doc_id", "source"))
    return spark.read.parquet(f"{at}/points").where("doc_id BETWEEN 100 AND 199 AND lang = 'en'").select("doc_id", "source", "n_chars")


QUERIES = {f.__name__: f for f in (index_update, index_search, graph_points, graph_recall, payload_lookup)}

ORACLES = {
    "index_update": r"""
SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY term
""",
    "graph_points": """SELECT label, count(DISTINCT embedding) AS vectors, 0::BIGINT AS apart FROM embeddings
      WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 GROUP BY label""",
    "payload_lookup": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id BETWEEN 100 AND 199 AND lang = 'en'",
    "index_search": f"WITH {_batch(_ASKED, 3)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM hits",
}
