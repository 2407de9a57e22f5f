"""Queries over bookkeeping, evaluation and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import evaluate, registry, search
from heddle.sources.tables import table
from heddle.streaming import ingest


def latest_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, as an experiment's last settings."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))
    return registry.latest(log, ["user_id"], [F.col("event_id")])


def insert_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and kind: what is there stays."""
    return registry.first_of(
        table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"),
        ["user_id", "event_type"],
        [F.col("event_id")],
    )


def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    new = nation.where("n_nationkey % 5 = 0").select(
        (F.col("n_nationkey") + F.when(F.col("n_nationkey") == 20, 80).otherwise(0)).cast("int").alias("n_nationkey"),
        F.concat(F.lit("NEW "), "n_name").alias("n_name"),
        "n_regionkey",
    )
    return registry.upsert(nation, new, ["n_nationkey"])


def sessions_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.sessions(table(spark, sf_dir, "conversations"))


def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty sessions with the most turns, ties by id."""
    return registry.sessions(table(spark, sf_dir, "conversations")).orderBy(F.desc("turns"), "conv_id").limit(30).select("conv_id", "turns")


def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.history(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role", "recent")


def registry_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels")
    return registry.sync(known, table(spark, sf_dir, "documents"), ["doc_id"])


def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose supplier is not among those kept."""
    return registry.orphans(
        table(spark, sf_dir, "lineitem"),
        "l_suppkey",
        table(spark, sf_dir, "supplier").where("s_nationkey <> 7"),
        "s_suppkey",
    ).select("l_orderkey", "l_linenumber", "l_suppkey")


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in customer, orders and lineitem once the customers of a nation go."""
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")}
    graph = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    gone = tables["customer"].where("c_nationkey = 3").select("c_custkey")
    left = registry.delete_cascade(tables, graph, "customer", gone)
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def facet_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by source with one sample's fields."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("points"),
        F.min("doc_id").alias("sample_doc"),
        F.min_by("lang", "doc_id").alias("sample_lang"),
        F.max("n_chars").alias("longest"),
    )


def library_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of labels and of documents side by side, either of which may lack the other."""
    rows = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    points = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("points"))
    return registry.library(rows, points, "doc_id")


def stage_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a second by kind, each event's value taken as its milliseconds."""
    met = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("items"), F.round(F.sum("value"), 3).alias("ms"))
    return met.select("event_type", "items", F.round(registry.throughput(F.col("items"), F.col("ms")), 4).alias("per_second"))


def node_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.node_medians(table(spark, sf_dir, "events"), "user_id", "event_type", "value")


def latency_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(table(spark, sf_dir, "events"), "event_type", "value").select(
        "event_type",
        "n",
        "p50",
        "p95",
        "p99",
        "least",
        "most",
        F.round("mean", 4).alias("mean"),
    )


def turn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order as one row: the path of kinds, the last kind and the values' sum."""
    return evaluate.fold_turn(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "value")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases out of labels: what was expected, what came out and how long it took."""
    d = F.col("doc_id")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "labels").select(
        F.lpad(d.cast("string"), 8, "0").alias("id"), pick(d, "answer", "answer", "answer", "abstain", "direct").alias("expect"), pick(d + F.col("quality"), "answered", "answered", "abstained", "direct").alias("outcome"),
        pick(d, "retrieve", "retrieve", "direct").alias("route"), (F.col("quality") == 1).alias("ok"), (F.col("toxic") == 0).alias("found"), (d % 37 == 0).alias("says_not"),
        (1000.0 + (d * 7919) % 5000).alias("total_ms"), (d % 4).alias("model_calls"), (d % 3 + 1).alias("searches"), F.when(d % 29 == 0, F.lit("failed")).alias("error"),
    )


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summarise(_cases(spark, sf_dir))


def eval_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds' counts of the second half of events beside those of the first."""
    events = table(spark, sf_dir, "events")
    count = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"))
    return evaluate.changes(
        count(events.where("event_id % 2 = 1")),
        count(events.where("event_id % 2 = 0 AND event_type <> 'error'")),
        "event_type",
        "n",
    )


def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the query's label are relevant; the query itself is left out."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = search.dense_search_batch(vectors, asked, 11, "vec_id").where("vec_id <> query_id")
    from pyspark.sql.window import Window

    hits = hits.select(
        "query_id",
        F.col("vec_id").alias("item_id"),
        F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"),
    ).where("rank <= 10")
    labels = vectors.select("vec_id", "label")
    relevant = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(
        labels.select(F.col("vec_id").alias("item_id"), "label"),
        "label",
    ).where("item_id <> query_id")
    return evaluate.ranking_metrics(hits, relevant)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contents of a document stream."""
    stream = ingest.read_stream(spark, f"{sf_dir}/documents.parquet")
    return ingest.run(spark, ingest.once_by_content(stream).select("content_id"))


def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user and kind once: a key's versions."""
    stream = ingest.read_stream(spark, f"{sf_dir}/events.parquet")
    return ingest.run(spark, ingest.once_by_version(stream.select("user_id", "event_type"), "user_id", "event_type"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and kind, as a stream with a watermark."""
    stream = ingest.windowed(ingest.read_stream(spark, f"{sf_dir}/events.parquet"))
    rows = ingest.run(spark, stream, mode="complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (
    latest_per_name, insert_once, upsert_rows, sessions_list, recent_sessions, history_last_n, registry_sync, orphan_rows, duplicate_keys, delete_cascade, facet_documents, library_rollup, stage_throughput,
    node_timings, latency_by_kind, turn_fold, eval_summary, eval_changes, ranking_metrics, stream_dedup, stream_versions, stream_windows,
)}

_CASES = """cases AS (SELECT lpad(doc_id::VARCHAR, 8, '0') AS id, (['answer','answer','answer','abstain','direct'])[doc_id % 5 + 1] AS expect, (['answered','answered','abstained','direct'])[(doc_id + quality) % 4 + 1] AS outcome,
  (['retrieve','retrieve','direct'])[doc_id % 3 + 1] AS route, quality = 1 AS ok, toxic = 0 AS found, doc_id % 37 = 0 AS says_not, 1000.0 + (doc_id * 7919) % 5000 AS total_ms, doc_id % 4 AS model_calls, doc_id % 3 + 1 AS searches, doc_id % 29 = 0 AS err FROM labels)"""
_IDS = "coalesce(string_agg(id, ',' ORDER BY id) FILTER ({c}), '')"
_RANK = """WITH h AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, e.label = q.label AS rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank
   FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10),
 n AS (SELECT q.vec_id AS query_id, count(*) AS n FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1),
 f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM h WHERE rel)
 SELECT n.query_id, round(coalesce(1.0 / min(rank), 0), 6) AS mrr, round(coalesce(sum(nth / rank), 0) / n.n, 6) AS map"""
for _k in (1, 3, 5, 10):
    _RANK += f""", (count(*) FILTER (rank <= {_k}) > 0)::INT AS hit_{_k}, round(count(*) FILTER (rank <= {_k}) / n.n, 6) AS recall_{_k}, round(count(*) FILTER (rank <= {_k}) / {_k}, 6) AS precision_{_k},
   round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {_k}), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= least({_k}, n.n)), 6) AS ndcg_{_k}"""
_RANK += " FROM n LEFT JOIN f USING (query_id) GROUP BY n.query_id, n.n"

ORACLES = {
    "latest_per_name": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 4) AS value FROM events GROUP BY user_id",
    "insert_once": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
    "upsert_rows": "WITH n AS (SELECT (n_nationkey + CASE WHEN n_nationkey = 20 THEN 80 ELSE 0 END)::INT AS n_nationkey, 'NEW ' || n_name AS n_name, n_regionkey FROM nation WHERE n_nationkey % 5 = 0) SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM n) UNION ALL SELECT * FROM n",
    "sessions_list": "SELECT conv_id, substr(arg_min(text, turn), 1, 80) AS title, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
    "recent_sessions": "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id ORDER BY turns DESC, conv_id LIMIT 30",
    "history_last_n": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recent FROM conversations QUALIFY recent <= 3",
    "registry_sync": "WITH k AS (SELECT DISTINCT doc_id FROM labels), w AS (SELECT DISTINCT doc_id FROM documents) SELECT doc_id, 'removed' AS change FROM k WHERE doc_id NOT IN (FROM w) UNION ALL SELECT doc_id, 'new' FROM w WHERE doc_id NOT IN (FROM k)",
    "orphan_rows": "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey <> 7)",
    "duplicate_keys": "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "delete_cascade": """WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c))
      SELECT 'customer' AS table_name, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (FROM c) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM o)""",
    "facet_documents": "SELECT source, count(*) AS points, min(doc_id) AS sample_doc, arg_min(lang, doc_id) AS sample_lang, max(n_chars) AS longest FROM documents GROUP BY source",
    "library_rollup": "SELECT doc_id, quality, a.doc_id IS NOT NULL AS has_row, points, b.doc_id IS NOT NULL AS has_collection FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) a FULL JOIN (SELECT doc_id, count(*) AS points FROM documents GROUP BY 1) b USING (doc_id)",
    "stage_throughput": "SELECT event_type, count(*) AS items, round(count(*) / (round(sum(value), 3) / 1000), 4) AS per_second FROM events GROUP BY 1",
    "node_timings": "SELECT event_type AS node, count(*) AS turns, round(median(ms), 6) AS median_ms FROM (SELECT user_id, event_type, sum(value) AS ms FROM events GROUP BY ALL) GROUP BY 1",
    "latency_by_kind": "SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean FROM events GROUP BY 1",
    "turn_fold": """WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type AS fresh FROM events)
      SELECT user_id, count(*) AS events, string_agg(event_type, '>' ORDER BY event_id) FILTER (fresh) AS trace, arg_max(event_type, event_id) AS last_kind, round(sum(value), 4) AS total FROM e GROUP BY user_id""",
    "eval_summary": f"""WITH {_CASES} SELECT count(*) AS cases, {_IDS.format(c='err')} AS failed,
      count(*) FILTER (NOT err AND expect = 'answer' AND found) AS hit_rate, count(*) FILTER (NOT err AND expect = 'answer') AS hit_rate_of, count(*) FILTER (NOT err AND expect = 'answer' AND ok) AS correct, count(*) FILTER (NOT err AND expect = 'answer') AS correct_of,
      count(*) FILTER (NOT err AND outcome = 'abstained' AND expect = 'abstain') AS abstain_precision, count(*) FILTER (NOT err AND outcome = 'abstained') AS abstain_precision_of, count(*) FILTER (NOT err AND outcome = 'abstained' AND expect = 'abstain') AS abstain_recall, count(*) FILTER (NOT err AND expect = 'abstain') AS abstain_recall_of,
      count(*) FILTER (NOT err AND route = CASE WHEN expect = 'direct' THEN 'direct' ELSE 'retrieve' END) AS route_accuracy, count(*) FILTER (NOT err) AS route_accuracy_of,
      {_IDS.format(c="NOT err AND expect <> 'direct' AND route = 'direct'")} AS knowledge_sent_direct, {_IDS.format(c='NOT err AND says_not')} AS says_not_in_documents,
      round(median(total_ms / 1000) FILTER (NOT err), 6)::DOUBLE AS median_s, round(quantile_disc(total_ms / 1000, 0.95) FILTER (NOT err), 6)::DOUBLE AS p95_s, median(model_calls) FILTER (NOT err) AS model_calls_median, max(searches) FILTER (NOT err) AS searches_max FROM cases""",
    "eval_changes": "WITH a AS (SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1), b AS (SELECT event_type, count(*) AS was FROM events WHERE event_id % 2 = 0 AND event_type <> 'error' GROUP BY 1) SELECT event_type, n, was, was IS NOT NULL AND n <> was AS changed FROM a LEFT JOIN b USING (event_type)",
    "ranking_metrics": _RANK,
    "stream_dedup": "SELECT DISTINCT substr(sha256(text), 1, 16) AS content_id FROM documents",
    "stream_versions": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
