"""Queries over the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.functions.vectors import norm, truncate_normalise
from heddle.operators import lexical, search
from heddle.sources.tables import table

TERMS = ["the", "tion", "ing", "thon", "eau"]
K = 20


def _query_vector(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").scalar()


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.dense_search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), K, "vec_id")
    return found.withColumn("score", F.round("score", 6))


def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.dense_search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), K, "vec_id", filters={"label": 3})
    return found.select("rank", "vec_id", F.round("score", 6).alias("score"), F.round(1 - F.col("score"), 6).alias("distance"))


def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.dense_search_batch(vectors, asked, 5, "vec_id").withColumn("score", F.round("score", 6))


def matryoshka_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "embeddings").select("vec_id", truncate_normalise(F.col("embedding"), 16).alias("v"))
    return cut.select(
        "vec_id",
        F.size("v").cast("long").alias("dim"),
        F.round(norm(F.col("v")), 6).alias("norm"),
        F.round(F.get("v", F.lit(0)), 6).alias("first"),
    )


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        X.token_count(F.col("text")).alias("n_tokens"),
        F.size(F.array_distinct(X.tokens(F.col("text")))).cast("long").alias("n_terms"),
    )


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lexical.term_counts(table(spark, sf_dir, "documents"))
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_weights(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


def bm25_weights_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_weights(table(spark, sf_dir, "documents"), batch_col="source").select(
        "doc_id",
        "source",
        "term",
        "tf",
        F.round("weight", 6).alias("weight"),
    )


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.sparse_search(table(spark, sf_dir, "documents"), TERMS, K).withColumn("score", F.round("score", 6))


def sparse_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.sparse_search(
        table(spark, sf_dir, "documents"),
        TERMS,
        K,
        where=search.equals({"lang": "en"}),
    ).withColumn("score", F.round("score", 6))


def sparse_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return lexical.sparse_search_batch(table(spark, sf_dir, "documents"), asked, 3).withColumn("score", F.round("score", 6))


def _branches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    dense = search.dense_search(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), _query_vector(spark, sf_dir), K, "doc_id")
    return [dense, lexical.sparse_search(table(spark, sf_dir, "documents"), TERMS, K)]


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and lexical ranks over the same ids, fused; the flagship."""
    return search.fuse(_branches(spark, sf_dir), 10, "doc_id").withColumn("score", F.round("score", 6))


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best lexical candidates of each benchmark item, rescored by token overlap; ties keep the first rank."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    hits = lexical.sparse_search_batch(docs, asked, 5)
    pairs = hits.join(asked, "query_id").join(docs.select("doc_id", "text"), "doc_id")
    from pyspark.sql.window import Window

    scored = pairs.select(
        "query_id",
        "doc_id",
        F.col("rank").alias("first_rank"),
        F.round(search.lexical_overlap(F.col("question"), F.col("text")), 6).alias("score"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_rank")
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))


def rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a second search join those already scored; only new ones get a score (here one from the vector id)."""
    first, second = _branches(spark, sf_dir)
    scored = first.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").alias("seq"))
    merged = search.rerank_merge(
        scored,
        second,
        lambda hits: hits.withColumn("score", F.round((F.col("doc_id") % 97) / F.lit(97.0), 6)),
        10,
        "doc_id",
    )
    return merged


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items have a passage whose best overlap reaches 0.9."""
    return search.enough(rerank(spark, sf_dir), 0.9, "query_id")


def score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.above(dense_topk(spark, sf_dir), 0.3)


def loop_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision of the bounded loop: a search at most max_rewrites + 1 times."""
    rows = [(e, r, m, search.after_grade(e, r, m), search.after_rewrite(e, r, m)) for e in (True, False) for m in range(4) for r in range(m + 1)]
    return spark.createDataFrame(rows, "yes boolean, rewrites int, max_rewrites int, after_grade string, after_rewrite string")


def answer_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark questions searched at most twice; a question that finds too little is asked again by its first five words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    again = lambda q: q.select("query_id", F.array_join(F.slice(F.split("question", " "), 1, 5), " ").alias("question"))
    done, failed = search.answer_batch(asked, lambda q: lexical.sparse_search_batch(docs, q, 3), again, 40.0, 1)
    rows = done.withColumn("outcome", F.lit("answered")).unionByName(failed.withColumn("outcome", F.lit("abstained")))
    return rows.select("query_id", "searches", F.round("best_score", 6).alias("best_score"), "outcome")


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each content; of equal texts the last document wins, as a path would."""
    docs = table(spark, sf_dir, "documents").select(X.content_id(F.col("text")).alias("content_id"), "doc_id")
    return docs.groupBy("content_id").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite passages: the turns of conversations with numbers put in."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    answer = F.concat(
        F.col("text"),
        F.lit(" ["),
        (F.col("turn") + 1).cast("string"),
        F.lit("] and ["),
        (F.col("conv_id") % 9).cast("string"),
        F.lit("], again ["),
        (F.col("turn") + 1).cast("string"),
        F.lit("]"),
    )
    cited = turns.select("conv_id", "turn", X.citations(answer).alias("c"))
    show = lambda c: F.array_join(c.cast("array<string>"), ",")
    return cited.select(
        "conv_id",
        "turn",
        show(F.col("c")).alias("cited"),
        show(X.known_citations(F.col("c"), F.lit(5))).alias("known"),
        show(X.unknown_citations(F.col("c"), F.lit(5))).alias("unknown"),
    )


def source_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold a benchmark snippet, whitespace aside (candidates by a rare word, then the exact test)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.squash(F.col("text")).alias("t"))
    items = table(spark, sf_dir, "benchmark").select("item_id", X.squash(F.col("text")).alias("s"))
    word = lambda c: F.array_distinct(X.tokens(c))
    longest = items.withColumn(
        "w",
        F.try_element_at(
            F.array_sort(
                word(F.col("s")),
                lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0),
            ),
            F.lit(1),
        ),
    )
    # ids and words alone meet the items; the texts come back for the exact test of what met
    met = docs.select(F.col("doc_id").alias("d"), F.explode(word(F.col("t"))).alias("w")).join(longest, "w").select("d", "item_id", "s").distinct()
    inside = docs.join(met, F.col("doc_id").eqNullSafe(F.col("d"))).where(F.contains("t", "s"))
    return inside.select("doc_id", "item_id").distinct()


QUERIES = {f.__name__: f for f in (
    dense_topk, dense_topk_filtered, dense_topk_batch, matryoshka_norm, token_counts, term_df, bm25_weights, bm25_weights_by_batch, sparse_topk, sparse_topk_filtered,
    sparse_topk_batch, hybrid_rrf, rerank, rerank_merge, gate, score_floor, loop_routing, answer_loop, content_dedup, citations, source_containment,
)}

_TOK = "regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}_]+')"
_TOK_TEXT = _TOK.format(t="text")
_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
_DENSE = f"SELECT row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) AS rank, vec_id, s FROM (SELECT vec_id, {_COS} AS s FROM embeddings WHERE {{w}}) QUALIFY rank <= {K}"
_TF = f"tok AS (SELECT doc_id, source, lang, {_TOK_TEXT} AS t FROM documents), tf AS (SELECT doc_id, source, any_value(len(t)) AS n, term, count(*) AS tf FROM (SELECT doc_id, source, t, unnest(t) AS term FROM tok) GROUP BY doc_id, source, term)"
_W = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / {avg}))"
_LIST = ", ".join(f"'{t}'" for t in TERMS)


def _sparse(where: str = "true") -> str:
    return f"""tok AS (SELECT doc_id, {_TOK_TEXT} AS t FROM documents WHERE {where}),
 st AS (SELECT count(*) AS nd, avg(len(t)) AS m FROM tok),
 tf AS (SELECT doc_id, any_value(len(t)) AS n, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM tok) WHERE term IN ({_LIST}) GROUP BY doc_id, term),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 sp AS (SELECT doc_id, sum({_W.format(avg='m')} * ln(1 + (nd - df + 0.5) / (df + 0.5))) AS s FROM tf JOIN df USING (term), st GROUP BY doc_id),
 sparse AS (SELECT row_number() OVER (ORDER BY round(s, 9) DESC, doc_id) AS rank, doc_id, s FROM sp QUALIFY rank <= {K})"""


def _batch(questions: str, k: int, name: str = "hits") -> str:
    return f"""dtok AS (SELECT doc_id, {_TOK_TEXT} AS t FROM documents), st AS (SELECT count(*) AS nd, avg(len(t)) AS m FROM dtok),
 tf AS (SELECT doc_id, any_value(len(t)) AS n, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM dtok) GROUP BY doc_id, term),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 w AS (SELECT doc_id, term, {_W.format(avg='m')} * ln(1 + (nd - df + 0.5) / (df + 0.5)) AS w FROM tf JOIN df USING (term), st),
 q AS (SELECT query_id, unnest(list_distinct({_TOK.format(t='question')})) AS term FROM ({questions})),
 {name} AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank, doc_id, s AS score FROM (SELECT query_id, doc_id, sum(w) AS s FROM q JOIN w USING (term) GROUP BY ALL) QUALIFY rank <= {k})"""


_ASKED = "SELECT item_id AS query_id, text AS question FROM benchmark"
_RERANK = f"""WITH {_batch(_ASKED, 5)},
 sc AS (SELECT h.query_id, h.doc_id, h.rank AS first_rank, round(len(list_intersect(list_distinct({_TOK.format(t='b.text')}), {_TOK.format(t='d.text')})) / len(list_distinct({_TOK.format(t='b.text')})), 6) AS score
   FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d USING (doc_id)),
 rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS rank FROM sc)"""
_ANSWER = "text || ' [' || (turn + 1) || '] and [' || (conv_id % 9) || '], again [' || (turn + 1) || ']'"
_CITED = f"list_sort(list_distinct(list_transform(regexp_extract_all({_ANSWER}, '\\[(\\d+)\\]', 1), lambda x: x::INT)))"

ORACLES = {
    "dense_topk": f"SELECT rank, vec_id, round(s, 6) AS score FROM ({_DENSE.format(w='true')})",
    "dense_topk_filtered": f"SELECT rank, vec_id, round(s, 6) AS score, round(1 - s, 6) AS distance FROM ({_DENSE.format(w='label = 3')})",
    "dense_topk_batch": """SELECT query_id, rank, vec_id, round(s, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, e.vec_id) AS rank, s
      FROM embeddings q, embeddings e, LATERAL (SELECT list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s) WHERE q.vec_id % 20 = 0) WHERE rank <= 5""",
    "matryoshka_norm": """SELECT vec_id, 16::BIGINT AS dim, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1], 6) AS "first"
      FROM (SELECT vec_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS v FROM (SELECT vec_id, embedding[1:16]::DOUBLE[] AS c FROM embeddings))""",
    "token_counts": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms FROM (SELECT doc_id, {_TOK_TEXT} AS t FROM documents)",
    "term_df": f"WITH {_TF} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term",
    "bm25_weights": f"WITH {_TF}, a AS (SELECT avg(len(t)) AS m FROM tok) SELECT doc_id, term, tf, round({_W.format(avg='m')}, 6) AS weight FROM tf, a",
    "bm25_weights_by_batch": f"WITH {_TF}, a AS (SELECT source, avg(len(t)) AS m FROM tok GROUP BY source) SELECT doc_id, source, term, tf, round({_W.format(avg='m')}, 6) AS weight FROM tf JOIN a USING (source)",
    "sparse_topk": f"WITH {_sparse()} SELECT rank, doc_id, round(s, 6) AS score FROM sparse",
    "sparse_topk_filtered": f"""WITH {_sparse("lang = 'en'")} SELECT rank, doc_id, round(s, 6) AS score FROM sparse""",
    "sparse_topk_batch": f"WITH {_batch(_ASKED, 3)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM hits",
    "hybrid_rrf": f"""WITH {_sparse()}, dense AS ({_DENSE.format(w='true')}), f AS (SELECT doc_id, sum(1.0 / (1 + rank)) AS s FROM (SELECT doc_id, rank FROM sparse UNION ALL SELECT vec_id, rank FROM dense) GROUP BY doc_id)
      SELECT row_number() OVER (ORDER BY round(s, 9) DESC, doc_id) AS rank, doc_id, round(s, 6) AS score FROM f QUALIFY rank <= 10""",
    "rerank": f"{_RERANK} SELECT query_id, doc_id, first_rank, score, rank FROM rr",
    "rerank_merge": f"""WITH {_sparse()}, dense AS ({_DENSE.format(w='true')}), old AS (SELECT vec_id AS doc_id, round(s, 6) AS score, rank AS seq FROM dense),
      fresh AS (SELECT doc_id, round((doc_id % 97) / 97.0, 6) AS score, {K} + row_number() OVER (ORDER BY rank) AS seq FROM sparse WHERE doc_id NOT IN (SELECT doc_id FROM old))
      SELECT row_number() OVER (ORDER BY score DESC, seq) AS rank, doc_id, score, seq FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh) QUALIFY rank <= 10""",
    "gate": f"{_RERANK} SELECT query_id, max(score) AS best_score, max(score) >= 0.9 AS enough FROM rr GROUP BY query_id",
    "score_floor": f"SELECT rank, vec_id, round(s, 6) AS score FROM ({_DENSE.format(w='true')}) WHERE round(s, 6) >= 0.3",
    "content_dedup": "SELECT substr(sha256(text), 1, 16) AS content_id, max(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "citations": f"""SELECT conv_id, turn, array_to_string(c, ',') AS cited, array_to_string(list_filter(c, lambda n: n BETWEEN 1 AND 5), ',') AS known, array_to_string(list_filter(c, lambda n: n NOT BETWEEN 1 AND 5), ',') AS unknown
      FROM (SELECT conv_id, turn, {_CITED} AS c FROM conversations WHERE role = 'assistant')""",
    "source_containment": "WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM benchmark) SELECT doc_id, item_id FROM d JOIN b ON contains(t, s)",
    "loop_routing": """SELECT yes, r::INT AS rewrites, m::INT AS max_rewrites, CASE WHEN yes THEN 'generate' WHEN r < m THEN 'rewrite' ELSE 'abstain' END AS after_grade, CASE WHEN yes THEN 'retrieve' WHEN r < m THEN 'rewrite' ELSE 'abstain' END AS after_rewrite
      FROM (VALUES (true), (false)) y(yes), range(4) a(m), range(4) b(r) WHERE r <= m""",
    "answer_loop": f"""WITH {_batch(_ASKED, 3, 'h1')}, g1 AS (SELECT query_id, question, coalesce(max(score), 0) AS s FROM ({_ASKED}) LEFT JOIN h1 USING (query_id) GROUP BY ALL),
      q2 AS (SELECT query_id, unnest(list_distinct({_TOK.format(t="array_to_string(string_split(question, ' ')[1:5], ' ')")})) AS term FROM g1 WHERE s < 40),
      g2 AS (SELECT query_id, coalesce(max(x), 0) AS s FROM g1 LEFT JOIN (SELECT query_id, sum(w) AS x FROM q2 JOIN w USING (term) GROUP BY query_id, doc_id) USING (query_id) WHERE g1.s < 40 GROUP BY query_id)
      SELECT query_id, 1::BIGINT AS searches, round(s, 6) AS best_score, 'answered' AS outcome FROM g1 WHERE s >= 40
      UNION ALL SELECT query_id, 2, round(s, 6), CASE WHEN s >= 40 THEN 'answered' ELSE 'abstained' END FROM g2""",
}
