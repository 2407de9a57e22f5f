"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

An item's sketch is its least shingle hashes. Items are partitioned by size (powers of two), and the items of a partition have sketches of the same
length. Of an item with n distinct shingles a document that contains it lacks at most ``lost`` = n less what containment
demands, so of a sketch of k hashes it has at least k - ``lost``, wherever they stand and in whatever order: a document that
quotes an item in fragments is found like one that quotes it whole. A partition's sketches have 2 * ``lost`` + 1 hashes of its largest size
(all of a smaller item), which demands a good half of them: one shared shingle alone makes no candidate.

A document has no sketch of its own, as a short item's hashes may stand anywhere in a long text: all its shingles are looked up among
those of the sketches, and what is found is counted by document and item before it is shuffled. Candidates are verified on the shingles' texts.

Items of fewer than five words are one shingle of that many words and are sought among the documents'
shingles of this length, all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import Stored
from heddle.llm.shingles import SYMBOLS, WORDS, with_shingles, words

CONTAINMENT = 0.8
BROADCAST_ROWS = 1_000_000  # long pairs: some 40 MB in a hash table
SALTS = 16


def lost_of(size: Column, containment: float = CONTAINMENT) -> Column:
    """How many of an item's ``size`` shingles a document that contains it may lack."""
    return (size - F.greatest(F.lit(1), F.ceil(F.round(size * F.lit(containment), 9)))).cast("int")


def partition_of(size: Column) -> Column:
    """The largest size of an item's partition: the power of two from ``size`` on."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double")))).cast("int")


def sketch_length(size: Column, containment: float = CONTAINMENT) -> Column:
    """How many of its least hashes an item keeps."""
    return F.least(size.cast("int"), F.lit(2) * lost_of(partition_of(size), containment) + F.lit(1))


def sketches(sizes: DataFrame, hashed: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, item_text, k, h, needed): the items' sketches, and of how many of these hashes a document must have."""
    n, own = F.col("n_shingles"), Window.partitionBy("item_id", "item_text", "k").orderBy("h")
    nth = hashed.join(sizes, ["item_id", "item_text", "k"]).withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= sketch_length(n, containment))
    return nth.select("item_id", "item_text", "k", "h", (sketch_length(n, containment) - lost_of(n, containment)).alias("needed"))


def _text_pieces(w: Column, k: Column) -> Column:
    """The runs of ``k`` of the words, joined; a shorter text is one run."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + F.lit(1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))


def find(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    containment: float = CONTAINMENT,
    shortest: int = 1,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): the items that documents contain.

    An item is contained if the document has at least ``containment`` of its distinct shingles of five words
    (lower-case runs of letters and digits). Items of fewer than ``shortest`` words are not sought. Null, empty and wordless
    texts contain nothing and are in nothing. Rows that repeat
    an id are one document; rows that repeat an item's id are items of their own and give the best of them. Rows with a
    null id are left out. The items' shingles are broadcast only up to ``broadcast_rows``, and so are the candidates;
    beyond that both are joined by shuffles, with the documents' side salted, as a passage may be in a third of all documents.
    """
    own = items.select(
        F.col(item_col).cast("long").alias("item_id"),
        F.col(item_text_col).cast("string").alias("text"),
    ).where("item_id IS NOT NULL AND text IS NOT NULL")
    own = own.withColumn("w", words(F.col("text"), SYMBOLS)).where(F.size("w") >= max(1, shortest)).withColumn("k", F.least(F.size("w"), F.lit(WORDS)).cast("int"))
    own = own.select("item_id", F.xxhash64("text").alias("item_text"), "k", "w")
    pieces = Stored(
        own.select("item_id", "item_text", "k", F.explode_outer(F.array_distinct(_text_pieces(F.col("w"), F.col("k")))).alias("piece")).distinct()
    ).df
    sizes = pieces.groupBy("item_id", "item_text", "k").agg(F.count("*").alias("n_shingles"))
    kept = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    ).where("doc_id IS NOT NULL AND text IS NOT NULL")
    few = pieces.count() <= broadcast_rows
    small = F.broadcast if few else (lambda df: df)
    hashed = Stored(sketches(sizes, _piece_hashes(pieces), containment)).df
    met = [hashed.select(F.lit(0).cast("long").alias("doc_id"), "item_id", "item_text", "k").where("false")]
    for k in sorted(r.k for r in sizes.select("k").distinct().collect()):  # at most five rows
        keys = with_shingles(kept, F.col("text"), "shingles", k, SYMBOLS).select("doc_id", F.explode_outer(F.array_distinct("shingles")).alias("h"))
        counted = _meet(keys, hashed.where(F.col("k") == k), ["h"], few).groupBy("doc_id", "item_id", "item_text", "k").agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
        met.append(counted.where("n >= needed").select("doc_id", "item_id", "item_text", "k"))
    candidates = Stored(reduce(DataFrame.unionByName, met)).df
    near = F.broadcast if candidates.count() <= broadcast_rows else (lambda df: df)
    suspects = kept.join(near(candidates.select("doc_id", "k").distinct()), "doc_id")
    suspects = suspects.withColumn("w", words(F.col("text"), SYMBOLS)).select(
        "doc_id",
        "k",
        F.explode_outer(_text_pieces(F.col("w"), F.col("k"))).alias("piece"),
    )
    shared = (
        _meet(suspects, pieces, ["k", "piece"], few)
        .groupBy("doc_id", "item_id", "item_text", "k").agg(F.count_distinct("piece").alias("n_shared"))
    )
    found = shared.join(small(sizes), ["item_id", "item_text", "k"]).withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= containment)
    best = F.max(F.struct("containment", "n_shingles", "n_shared")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id",
        "item_id",
        F.col("best.n_shingles").alias("n_shingles"),
        F.col("best.n_shared").alias("n_shared"),
        F.col("best.containment").alias("containment"),
    )


def _meet(documents: DataFrame, items: DataFrame, on: list[str], few: bool) -> DataFrame:
    """Rows of documents with those of items: by broadcast, or by a shuffle in which each document's rows go with a salt."""
    if few:
        return documents.join(F.broadcast(items), on)
    salted = documents.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    return salted.join(items.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*on, "salt"])


def _piece_hashes(pieces: DataFrame) -> DataFrame:
    """The hash that ``with_shingles`` gives each piece."""
    return pieces.withColumn("h", F.xxhash64(F.transform(F.split("piece", " "), lambda w: F.xxhash64(w))))


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    shortest: int = WORDS,
    broadcast_rows: int = BROADCAST_ROWS,
    **options,
) -> DataFrame:
    """``docs`` without the documents that contain an item of at least ``shortest`` words; rows with a null id stay.

    Shorter items would take every document that has their one or two words; lower ``shortest`` to seek them too.
    """
    found = Stored(find(docs, items, id_col, shortest=shortest, broadcast_rows=broadcast_rows, **options).select("doc_id").distinct()).df
    gone = found.withColumnRenamed("doc_id", id_col)
    return docs.join(F.broadcast(gone) if found.count() <= broadcast_rows else gone, id_col, "left_anti").select(docs.columns)
