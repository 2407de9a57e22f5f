"""Lexical search: term counts, BM25 weights and sparse top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions.text import tokens
from heddle.session import Stored

K1, B = 1.2, 0.75
SEED_POSTINGS = 5_000  # of a question's rarest terms
BROADCAST_ROWS = 1_000_000
IDLE_SHARE = 0.5  # of the bar, that the bounds of the terms that are not joined may reach
FIRST = 8  # texts for each that is asked for, from which the bar is found
SLACK = 1e-6  # of bounds against rounding


def counted(terms: Column) -> Column:
    """Distinct terms of an array with their number, as an array of (term, tf): they are sorted, and a term's run is counted by where it begins."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, at: F.zip_with(
        at,
        F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s))),
        lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).cast("long").alias("tf")),
    )
    return F.when(F.size(terms) > 0, once(F.sort_array(terms), lambda s: once(begins(s), lambda at: runs(s, at))))


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: DataFrame | None = None, batch_col: str | None = None) -> DataFrame:
    """(id, length, term, tf), and the batch: one row for each distinct term of a text, or of those in ``only`` (a frame of terms).

    A text's words are counted in its row, so nothing is shuffled; only where an id stands in several rows are their counts summed up.
    """
    key = [*dict.fromkeys([id_col, *([batch_col] if batch_col else [])])]
    split = docs.select(*key, tokens(F.col(text_col)).alias("_t"))
    each = split.select(*key, F.size("_t").cast("long").alias("length"), F.explode_outer(counted(F.col("_t"))).alias("_e")).where("_e IS NOT NULL").select(*key, "length", "_e.term", "_e.tf")
    if only is not None:
        each = each.join(only, "term", "left_semi")
    if docs.groupBy(id_col).count().where("count > 1").isEmpty():
        return each
    return each.groupBy(*key, "length", "term").agg(F.sum("tf").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df) from term counts."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def document_weight(tf: Column, length: Column, average: Column) -> Column:
    """The BM25 weight of a term in a text, without IDF."""
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.try_divide(length, average)))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_col: str | None = None) -> DataFrame:
    """(id, term, tf, weight); lengths are relative to the mean of the row's batch, or of all rows.

    The mean is aggregated by batch and joined, broadcast unless there are very many: rows of terms stay where they are counted.
    """
    lengths = docs.select(*([batch_col] if batch_col else []), F.size(tokens(F.col(text_col))).cast("long").alias("_n"))
    counts = term_counts(docs, id_col, text_col, batch_col=batch_col)
    if batch_col is None:
        average = lengths.agg(F.avg("_n")).scalar()
        return counts.select(id_col, "term", "tf", document_weight(F.col("tf"), F.col("length"), average).alias("weight"))
    means = Stored(lengths.groupBy(batch_col).agg(F.avg("_n").alias("_mean"))).df
    return counts.join(F.broadcast(means) if means.count() <= BROADCAST_ROWS else means, batch_col).select(
        *dict.fromkeys([id_col, batch_col]),
        "term",
        "tf",
        document_weight(F.col("tf"), F.col("length"), F.col("_mean")).alias("weight"),
    )


def sparse_search(
    docs: DataFrame,
    terms: list[str],
    top_k: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    where: Column | None = None,
) -> DataFrame:
    """(rank, id, score): the best texts for a query by BM25 with IDF, ties by id.

    ``where`` filters before the search; texts without a query term are absent. Only occurrences of query terms are
    shuffled; the corpus mean, its size and the terms' frequencies are scalar subqueries and one small aggregate.
    """
    wanted = sorted(set(terms))
    pool = docs if where is None else docs.where(where)
    split = pool.select(id_col, tokens(F.col(text_col)).alias("_t")).select(id_col, F.size("_t").cast("long").alias("length"), "_t")
    stats = split.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = split.select(id_col, "length", F.explode_outer("_t").alias("term")).where(F.col("term").isin(wanted)).groupBy(id_col, "length", "term").agg(F.count("*").alias("tf"))
    found = hits.join(F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df"))), "term")  # a row for each query term
    weight = document_weight(F.col("tf"), F.col("length"), stats.select("mean").scalar()) * idf(stats.select("n").scalar(), F.col("df"))
    scored = found.groupBy(id_col).agg(F.sum(weight).alias("score"))
    return ranked(scored, top_k, id_col)


def ranked(scored: DataFrame, top_k: int, id_col: str) -> DataFrame:
    """(rank, id, score) of the ``top_k`` best, ties by id; scores are compared at nine decimals."""
    best = scored.orderBy(F.round("score", 9).desc(), id_col).limit(top_k)
    order = Window.orderBy(F.round("score", 9).desc(), id_col)  # over at most top_k rows
    return best.select(F.row_number().over(order).cast("long").alias("rank"), id_col, "score")


def sparse_search_batch(
    docs: DataFrame,
    questions: DataFrame,
    top_k: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_col: str = "query_id",
    question_col: str = "question",
    seeds: int = SEED_POSTINGS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score) for a table of questions, exact, without joining common words with their postings; see ``best_of_batch``.

    The texts are read for their words once; the postings of the questions' words are written beside, some tenths of the texts' size. ``lexindex`` keeps
    postings for searches that come again.
    """
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    terms = Stored(question_words(questions, query_col, question_col)).df
    vocabulary = Stored(terms.select("word").distinct().select("word", F.xxhash64("word").alias("term"))).df
    split = docs.select(F.col(id_col).alias("d"), tokens(F.col(text_col)).alias("t")).select("d", F.size("t").cast("long").alias("length"), "t")
    whole = split.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    n, mean = whole["n"], whole["mean"] or 0.0
    # the one pass over the texts' words: from here on a word of the questions is a number, and its postings are a table
    each = split.select("d", "length", F.explode("t").alias("word")).join(small(vocabulary), "word")
    postings = Stored(each.groupBy("d", "length", "term").agg(F.count("*").alias("tf"))).df
    by_term = postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf(F.lit(n), F.col("df")))
    known = terms.select("q", F.xxhash64("word").alias("term")).join(by_term, "term")
    weight = document_weight(F.col("tf"), F.col("length"), F.lit(mean)) * F.col("idf")

    def found_of(some: DataFrame) -> DataFrame:
        """(q, d, gain) of these (q, term, idf, need); rows below what their question needs of them are left out."""
        met = postings.join(small(some), "term").withColumn("gain", weight)
        return met.where(F.col("need").isNull() | (F.col("gain") >= F.col("need"))).select("q", "d", "gain")

    def gains_of(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """(q, d, gain) of these (q, d) by all terms."""
        wanted = pairs.join(small(known.select("q", "term", "idf")), "q")
        own = postings.join(small(pairs.select("d").distinct()), "d", "left_semi")
        return own.join(wanted, ["d", "term"]).select("q", "d", weight.alias("gain"))

    best = best_of_batch(known, found_of, gains_of, top_k, seeds, small)
    return best.select(F.col("q").alias(query_col), "rank", F.col("d").alias(id_col), "score")


def question_words(questions: DataFrame, query_col: str = "query_id", question_col: str = "question") -> DataFrame:
    """(q, word): the distinct words of each question."""
    return questions.select(F.col(query_col).alias("q"), F.explode(F.array_distinct(tokens(F.col(question_col)))).alias("word"))


def best_of_batch(
    known: DataFrame,
    found: Callable[[DataFrame], DataFrame],
    gains: Callable[[DataFrame, DataFrame], DataFrame],
    top_k: int,
    seeds: int = SEED_POSTINGS,
    small: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """(q, rank, d, score), exact, of questions whose terms are ``known`` (q, term, df, idf).

    ``found`` gives (q, d, gain) of (q, term, idf, need), where it may leave out what gains less than ``need``; ``gains`` gives (q, d, gain) of given (q, d) by all terms.
    Each question is first sought by its rarest terms alone, at most about ``seeds`` postings of them beyond the rarest; of the texts that are best by these, the
    ``top_k``th best score by all terms is a bar. A term adds at most ``(K1 + 1) * idf`` to a score, so the commonest terms whose bounds add up to less
    than the bar can't lift a text over it by themselves: only postings of the others are sought, of those only ones that gain what
    the bar leaves when all other terms gave their most, and the texts that could still reach
    the bar are scored in full. Questions that find fewer than ``top_k`` texts by their rarest terms are sought by all of them.
    """
    own = Window.partitionBy("q")
    known = Stored(known.withColumn("before", F.sum("df").over(own.orderBy("df", "term")) - F.col("df"))).df
    summed = lambda rows: rows.groupBy("q", "d").agg(F.sum("gain").alias("score"))
    nth = F.row_number().over(own.orderBy(F.desc("score"), "d"))
    rarest = known.where(F.col("before") < seeds).select("q", "term", "idf", F.lit(None).cast("double").alias("need"))
    first = summed(found(rarest)).withColumn("nth", nth).where(F.col("nth") <= FIRST * top_k)
    fully = summed(gains(Stored(first.select("q", "d")).df, known))
    bars = fully.withColumn("nth", nth).where(F.col("nth") == top_k).select("q", (F.col("score") - F.lit(SLACK)).alias("bar"))
    bound = F.lit(K1 + 1) * F.col("idf")
    below = F.sum(bound).over(own.orderBy("idf", F.desc("term"))) < F.coalesce("bar", F.lit(0.0)) * F.lit(IDLE_SHARE)
    others = F.sum(bound).over(own) - bound
    judged = Stored(known.join(bars, "q", "left").withColumns({"idle": below & F.col("bar").isNotNull(), "need": F.col("bar") - others - F.lit(SLACK)})).df
    rest = judged.groupBy("q").agg(F.coalesce(F.sum(F.when(F.col("idle"), bound)), F.lit(0.0)).alias("rest"), F.max("bar").alias("bar"))
    able = summed(found(judged.where(~F.col("idle")).select("q", "term", "idf", "need")))
    near = able.join(small(rest), "q").where(F.col("bar").isNull() | (F.col("score") + F.col("rest") >= F.col("bar")))
    order = own.orderBy(F.round("score", 9).desc(), "d")
    best = summed(gains(Stored(near.select("q", "d")).df, known)).withColumn("rank", F.row_number().over(order).cast("long"))
    return best.where(F.col("rank") <= top_k)
