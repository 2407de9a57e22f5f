"""A kept inverted index: postings in blocks, updated by batches of added, changed and removed documents, merged when asked to.

The tables of an index change together (``sources.snapshots``):

- ``postings``: blocks of at most BLOCK postings of one term, with the greatest count and the least length in the block, which bound
  what any of its texts can gain whatever the mean length is by then. Folders are buckets of the terms' hash, files are sorted by term and have a
  Bloom filter for it, so a search reads the buckets of its terms and skips the row groups of others.
- ``terms``: changes of document frequencies, summed up when read.
- ``documents``: each text's length and distinct words, by which its removal is counted off.
- ``dead``: ids and the segment before which their postings no longer count.

A batch is a segment. Its postings are written once; what it takes off the index is a row in ``dead``. Counts, mean length and frequencies are
those of the live documents exactly, so scores are those of an index that is built from them anew. ``merge`` writes the live postings as one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.text import tokens
from heddle.operators.lexical import BROADCAST_ROWS, SEED_POSTINGS, best_of_batch, document_weight, idf, question_words
from heddle.session import Stored, ship
from heddle.sources.snapshots import Change, Snapshot, Snapshots

BLOCK = 128
PIECE = 2 * BLOCK  # postings of a term in one row, before blocks are made of them
RUN = 1 << 22  # words, or postings, that are sorted at once
BUCKETS = 32
SLICES = 32
PUSHED_TERMS = 200  # so many terms are named to the scan one by one
POSTING = np.dtype([("d", "<i8"), ("tf", "<i4"), ("length", "<i4")])
PIECES = "term string, postings binary"  # POSTINGs one after another
READ = f"d long, length long, words string, {PIECES}"
BLOCKS = "bucket int, term string, segment long, max_tf long, min_length long, ids array<long>, tfs array<long>, lengths array<long>"
DOCUMENTS = "d long, length long, segment long, words array<string>"
DEAD = "d long, before long"
TERMS = "bucket int, term string, df long"
OPTIONS = {"parquet.bloom.filter.enabled#term": "true", "parquet.block.size": str(16 << 20)}


class IndexProblem(ValueError):
    """A batch that an index can't take."""


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def open_index(spark: SparkSession, path: str) -> Snapshots:
    return Snapshots(spark, path)


def update(index: Snapshots, docs: DataFrame | None = None, deleted: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> Snapshot:
    """Adds documents, in place of those with the same ids, and removes the ``deleted`` ids, in one change; returns the state it made.

    A batch names an id once (else IndexProblem); rows with a null id are left out, null texts have no words. Removing an id that isn't there changes
    nothing. What is read of the index are its documents with ids of the batch, and no posting.
    """
    spark = index.spark
    empty = spark.createDataFrame([], "d long, text string")
    texts = empty if docs is None else docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("text")).where("d IS NOT NULL")
    gone = empty.select("d") if deleted is None else deleted.select(F.col(id_col).cast("long").alias("d")).where("d IS NOT NULL")
    read = Stored(_read(texts)).df
    own = read.where("d IS NOT NULL").select("d", "length", F.when(F.col("length") > 0, F.split("words", " ")).otherwise(F.array().cast("array<string>")).alias("words"))
    if twice := own.groupBy("d").count().where("count > 1").limit(1).collect():
        raise IndexProblem(f"The batch has the document {twice[0].d} more than once.")
    pieces = read.where("term IS NOT NULL").select("term", "postings")
    sizes = Stored(_sizes(pieces)).df
    named = Stored(own.select("d").unionByName(gone).distinct()).df

    def work(now: Snapshot) -> Change:
        segment = F.lit(now.version + 1).cast("long")
        out = Stored(_live(now, now.table("documents", DOCUMENTS)).join(_small(named), "d", "left_semi")).df
        left, left_length = out.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        came, came_length = own.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        deltas = sizes.withColumnRenamed("n", "df")
        if left:
            lost = out.select(F.explode("words").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
            deltas = deltas.unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        before = now.facts or {"documents": 0, "length": 0, "dead": 0, "buckets": buckets}
        change = Change(facts=before | {"documents": before["documents"] + came - left, "length": before["length"] + came_length - left_length, "dead": before["dead"] + left}, options=OPTIONS)
        width = before["buckets"]
        change.add("postings", _blocks_of(pieces, sizes, now.version + 1, width), "bucket")
        change.add("terms", deltas.select(bucket(F.col("term"), width).alias("bucket"), "term", "df").repartition("bucket").sortWithinPartitions("bucket", "term"), "bucket")
        change.add("documents", own.select("d", "length", segment.alias("segment"), "words").sortWithinPartitions("d"))
        return change.add("dead", out.select("d", segment.alias("before")))

    return index.commit(work, rests_on=("documents", "dead"))


def merge(index: Snapshots) -> Snapshot:
    """Writes the live postings and documents as one segment and the frequencies as one row a term; searches find the same."""

    def work(now: Snapshot) -> Change:
        segment, width = now.version + 1, now.facts["buckets"]
        counts = Stored(_live(now, _entries(now.table("postings", BLOCKS)))).df.select("d", "length", "term", "tf")
        change = Change(facts=now.facts | {"dead": 0}, options=OPTIONS)
        change.replace("postings", _blocks(counts, segment, width), "bucket")
        whole = now.table("terms", TERMS).groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
        change.replace("terms", whole.select("bucket", "term", "df").repartition("bucket").sortWithinPartitions("bucket", "term"), "bucket")
        live = _live(now, now.table("documents", DOCUMENTS))
        change.replace("documents", live.select("d", "length", F.lit(segment).cast("long").alias("segment"), "words").sortWithinPartitions("d"))
        return change.replace("dead", index.spark.createDataFrame([], DEAD))

    return index.commit(work)


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def _live(now: Snapshot, rows: DataFrame) -> DataFrame:
    """Rows (d, segment, ...) that no later segment has taken off."""
    if not now.facts.get("dead"):
        return rows
    last = now.table("dead", DEAD).groupBy("d").agg(F.max("before").alias("before"))
    last = F.broadcast(last) if now.facts["dead"] <= BROADCAST_ROWS else last
    return rows.join(last.withColumnRenamed("d", "dead_d"), (F.col("d") == F.col("dead_d")) & (F.col("segment") < F.col("before")), "left_anti")


def _entries(blocks: DataFrame) -> DataFrame:
    """One row a posting, with the block's other columns."""
    each = F.explode(F.arrays_zip(F.col("ids").alias("d"), F.col("tfs").alias("tf"), F.col("lengths").alias("length"))).alias("e")
    return blocks.select(*[c for c in blocks.columns if c not in ("ids", "tfs", "lengths", "max_tf", "min_length")], each).select("*", "e.d", "e.tf", "e.length").drop("e")


def _blocks(counts: DataFrame, segment: int, buckets: int) -> DataFrame:
    """Blocks of (d, length, term, tf) rows."""
    pieces = Stored(_pieces(counts)).df
    return _blocks_of(pieces, Stored(_sizes(pieces)).df, segment, buckets)


def _spans(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have up to RUN values together, or are one row."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + RUN, "right")))
        yield a, b
        a = b


def _starts(codes: np.ndarray, most: int) -> np.ndarray:
    """Where pieces of up to ``most`` equal neighbours begin."""
    runs = np.flatnonzero(np.diff(codes, prepend=-1))
    return np.flatnonzero((np.arange(len(codes)) - np.repeat(runs, np.diff(np.append(runs, len(codes))))) % most == 0)


def _lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _piece_rows(terms: pa.Array, codes: np.ndarray, d: np.ndarray, tf: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Rows of PIECES from postings that are sorted by term and document."""
    starts, packed = _starts(codes, PIECE), np.empty(len(codes), POSTING)
    packed["d"], packed["tf"], packed["length"] = d, tf, length
    ends = np.append(starts, len(codes)).astype(np.int32) * np.int32(POSTING.itemsize)
    postings = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    return pa.RecordBatch.from_arrays([terms.take(pa.array(codes[starts])), postings], names=["term", "postings"])


def _unpacked(column: pa.Array) -> np.ndarray:
    """The POSTINGs of some rows."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(POSTING)


def _read(texts: DataFrame) -> DataFrame:
    """Rows of READ from (d, text) rows with different ids, whose words are sought once: each document's distinct words (no word has a space), and the postings in pieces.

    A task sorts its words by term, so a row goes on for each piece and not for each posting.
    """
    ship(texts.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            d, words = part.column("d").to_numpy(), part.column("words")
            for a, b in _spans(np.diff(words.offsets.to_numpy())):
                own, ids, n = words.slice(a, b - a), d[a:b], b - a
                lengths, order, place = np.diff(own.offsets.to_numpy()), np.argsort(ids), np.empty(n, np.int64)
                place[order] = np.arange(n)
                coded = own.flatten().dictionary_encode()
                met, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(place, lengths), return_counts=True)
                codes, at = met // n, order[met % n]
                by_text = np.argsort(at.astype(np.min_scalar_type(n)), kind="stable")
                ends = pa.array(np.append(0, np.cumsum(np.bincount(at, minlength=n))), pa.int32())
                distinct = pc.binary_join(pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(codes[by_text]))), " ")
                yield _wide([pa.array(ids), pa.array(lengths, pa.int64()), distinct], ["d", "length", "words"])
                if len(met):
                    pieces = _piece_rows(coded.dictionary, codes, ids[at], tf, lengths[at])
                    yield _wide(pieces.columns, pieces.schema.names)

    return texts.select("d", tokens(F.col("text")).alias("words")).mapInArrow(batches, READ)


def _wide(columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """A batch of READ with nulls in its other columns."""
    kinds = {"d": pa.int64(), "length": pa.int64(), "words": pa.string(), "term": pa.string(), "postings": pa.binary()}
    own = dict(zip(names, columns, strict=True))
    return pa.RecordBatch.from_arrays([own.get(c, pa.nulls(len(columns[0]), kind)) for c, kind in kinds.items()], names=[*kinds])


def _pieces(counts: DataFrame) -> DataFrame:
    """The postings of (d, length, term, tf) rows in pieces."""
    ship(counts.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                coded, d, tf, length = part.column("term").dictionary_encode(), *(part.column(c).to_numpy() for c in ("d", "tf", "length"))
                codes = coded.indices.to_numpy()
                order = np.lexsort((d, codes))
                yield _piece_rows(coded.dictionary, codes[order], d[order], tf[order], length[order])

    return counts.select("d", "length", "term", "tf").mapInArrow(batches, PIECES)


def _sizes(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("term").agg(F.sum((F.octet_length("postings") / POSTING.itemsize).cast("long")).alias("n"))


def _blocks_of(pieces: DataFrame, sizes: DataFrame, segment: int, buckets: int) -> DataFrame:
    """Blocks of stored pieces, ``sizes`` the number of each term's postings. A term with more than its share of all postings is dealt to several tasks by pieces."""
    spark = pieces.sparkSession
    ship(spark)
    tasks = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = max(BLOCK, (sizes.agg(F.sum("n")).first()[0] or 0) // (4 * tasks))
    hot = sizes.where(F.col("n") > share).select("term", F.lit(True).alias("hot"))  # at most 4 x tasks terms
    placed = pieces.join(F.broadcast(hot), "term", "left").select(
        bucket(F.col("term"), buckets).alias("bucket"),
        F.when(F.col("hot"), F.pmod(F.xxhash64("postings"), F.lit(SLICES))).otherwise(0).alias("slice"),
        "term",
        "postings",
    )

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = pc.binary_length(part.column("postings")).to_numpy() // POSTING.itemsize
            for a, b in _spans(sizes):
                some = part.slice(a, b - a)
                codes = some.column("term").dictionary_encode().indices.to_numpy()  # rows are sorted by term
                rows = np.repeat(np.arange(b - a), sizes[a:b])
                met = _unpacked(some.column("postings"))
                order = np.lexsort((met["d"], codes[rows]))
                rows, (d, tf, length) = rows[order], (met[c][order] for c in POSTING.names)
                starts = _starts(codes[rows], BLOCK)
                first = pa.array(rows[starts])
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("bucket").take(first),
                        some.column("term").take(first),
                        pa.array(np.full(len(starts), segment, np.int64)),
                        pa.array(np.maximum.reduceat(tf, starts).astype(np.int64)),
                        pa.array(np.minimum.reduceat(length, starts).astype(np.int64)),
                        *(_lists(starts, x, pa.int64()) for x in (d, tf, length)),
                    ],
                    names=["bucket", "term", "segment", "max_tf", "min_length", "ids", "tfs", "lengths"],
                )

    ordered = placed.repartition(tasks, "bucket", "slice").sortWithinPartitions("bucket", "term")
    return ordered.mapInArrow(batches, BLOCKS)


def _of_terms(rows: DataFrame, buckets: list[int], named: list[str] | None, terms: DataFrame) -> DataFrame:
    """The rows of these terms: their buckets' folders alone, of those the row groups that may have one where the terms are few."""
    rows = rows.where(F.col("bucket").isin(buckets))
    if named is not None:
        by_name = F.lit(False)
        for term in named:
            by_name = by_name | (F.col("term") == term)
        return rows.where(by_name)
    return rows.join(terms, "term", "left_semi")


def search(
    state: Snapshot,
    questions: DataFrame,
    top_k: int,
    id_col: str = "doc_id",
    query_col: str = "query_id",
    question_col: str = "question",
    seeds: int = SEED_POSTINGS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score), exact and equal to ``lexical.sparse_search_batch`` over the live documents.

    Only the questions' terms are read, and where they are many, written beside once; blocks whose bound is below what a question needs of the term are not opened.
    """
    small = lambda df: _small(df, broadcast_rows)
    width = state.facts.get("buckets", BUCKETS)
    n, mean = state.facts.get("documents", 0), state.facts.get("length", 0) / max(1, state.facts.get("documents", 0))
    words = Stored(question_words(questions, query_col, question_col).withColumnRenamed("word", "term")).df
    vocabulary = Stored(words.select("term").distinct().withColumn("bucket", bucket(F.col("term"), width))).df
    buckets = [r.bucket for r in vocabulary.select("bucket").distinct().collect()]  # at most the index's number of buckets
    few = vocabulary.select("term").limit(PUSHED_TERMS + 1).collect()
    named = [r.term for r in few] if len(few) <= PUSHED_TERMS else None
    terms = small(vocabulary.select("term"))
    by_term = _of_terms(state.table("terms", TERMS), buckets, named, terms).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    known = words.join(by_term, "term").withColumn("idf", idf(F.lit(n), F.col("df")))
    blocks = _of_terms(state.table("postings", BLOCKS), buckets, named, terms)
    if named is None:  # else the scan itself skips what is not asked for
        blocks = Stored(blocks).df
    weight = document_weight(F.col("tf"), F.col("length"), F.lit(mean)) * F.col("idf")
    most = document_weight(F.col("max_tf"), F.col("min_length"), F.lit(mean)) * F.col("idf")

    def found(some: DataFrame) -> DataFrame:
        able = blocks.join(small(some), "term").where(F.col("need").isNull() | (most >= F.col("need")))
        return _live(state, _entries(able)).withColumn("gain", weight).where(F.col("need").isNull() | (F.col("gain") >= F.col("need"))).select("q", "d", "gain")

    def gains(pairs: DataFrame, known: DataFrame) -> DataFrame:
        wanted = pairs.join(small(known.select("q", "term", "idf")), "q")
        own = _live(state, _entries(blocks).join(small(pairs.select("d").distinct()), "d", "left_semi"))
        return own.join(wanted, ["d", "term"]).select("q", "d", weight.alias("gain"))

    best = best_of_batch(known, found, gains, top_k, seeds, small)
    return best.select(F.col("q").alias(query_col), "rank", F.col("d").alias(id_col), "score")
