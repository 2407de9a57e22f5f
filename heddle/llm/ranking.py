"""Ranked lexical search by windowed bucket scoring.

A task takes its documents in windows of so many. A window's postings (slot, occurrences, length by term) are kept for the
questions' terms alone and turned into contributions once; then each question's postings are traversed term by term and
scatter-added into an array with a place for each slot of the window, small enough for a core's cache, while a bitset notes the slots that
were touched. Touched slots whose sum beats the least of the question's heap are harvested into it, and the array is cleared by its bitset.
What leaves a task is a heap for each question: rows that are shuffled are tasks x questions x ``top_k``, whatever the documents' size.

Statistics come first, in a pass of their own over whole texts: how many documents have a term, all terms, and of the questions' terms the document
frequencies, summed up in the tasks before they are shuffled. Texts are read twice and never shuffled, and no posting is stored.

Questions go to the tasks in blocks of at most ``block_terms`` rows (question, term), so what a task holds doesn't grow with
their number; each block is a pass.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import Stored, slices
from heddle.session import ship

TOP_K = 10
WINDOW = 8192  # slots: the array of sums has 64 KB
WINDOW_POSTINGS = 1 << 21  # a window of long documents ends early
PIECE = 1 << 20  # bytes of a text whose terms are a list at a time
BLOCK_TERMS = 500_000  # rows (question, term) of a pass: some 60 MB in a task
DOCUMENTS, TERMS = -1, -2  # rows of the statistics that are no term's

#: A-Z become a-z, other ASCII characters than letters and digits become spaces; bytes beyond ASCII stay.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, repeats included, a list for each piece of it; a piece ends between terms."""
    line = text.encode().translate(FOLDED) if text else b""
    at = 0
    while at < len(line):
        end = line.find(b" ", at + PIECE)
        end = len(line) if end < 0 else end
        yield line[at:end].split()
        at = end


def counted(text: str | None, wanted: dict[bytes, int]) -> tuple[int, Counter]:
    """(n, tf): how many terms a text has, and how often each of the wanted ones by their numbers."""
    n, tf = 0, Counter()
    for piece in terms_of(text):
        n += len(piece)
        tf.update(wanted[t] for t in piece if t in wanted)
    return n, tf


def weight(documents: int, frequency: int) -> int:
    """What a term counts: 1000 times the logarithm of how rare it is, rounded down."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def length_share(n: int, documents: int, terms: int) -> int:
    """A document's length against the mean, in hundredths, a tenth of it fixed."""
    return 100 - 90 + (90 * n * documents) // terms


class Questions:
    """A block of questions as numbers: ``wanted`` numbers their terms, ``own`` has each question's term numbers."""

    def __init__(self, rows: list):
        self.ids = list(dict.fromkeys(r.q for r in rows))
        self.wanted: dict[bytes, int] = {}
        own: dict = {q: [] for q in self.ids}
        for r in rows:
            own[r.q].append(self.wanted.setdefault(r.term.encode(), len(self.wanted)))
        self.own = [own[q] for q in self.ids]


class Scores:
    """The documents of a window, their postings, and the scores of all questions in it."""

    def __init__(self, questions: Questions, weights: np.ndarray, top_k: int, slots: int):
        self.questions, self.weights, self.top_k = questions, weights, top_k
        self.sums = np.zeros(slots, np.int64)
        self.touched = np.zeros(slots, bool)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in questions.ids]  # (score, -doc_id): the least falls out
        self.clear()

    def clear(self) -> None:
        self.docs: list[int] = []
        self.terms: list[int] = []
        self.slots: list[int] = []
        self.tfs: list[int] = []
        self.shares: list[int] = []

    def add(self, doc_id: int, share: int, tf: Counter) -> None:
        slot = len(self.docs)
        self.docs.append(doc_id)
        self.terms.extend(tf.keys())
        self.tfs.extend(tf.values())
        self.slots.extend([slot] * len(tf))
        self.shares.append(share)

    def full(self) -> bool:
        return len(self.docs) >= len(self.sums) or len(self.terms) >= WINDOW_POSTINGS

    def score(self) -> None:
        """Adds the window's documents to the heaps and empties it."""
        if self.terms:
            term, slot, tf = (np.array(x, np.int64) for x in (self.terms, self.slots, self.tfs))
            order = np.argsort(term, kind="stable")
            term, slot, tf = term[order], slot[order], tf[order]
            gain = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.array(self.shares, np.int64)[slot]))
            firsts = np.searchsorted(term, np.arange(len(self.weights) + 1))
            docs = np.array(self.docs, np.int64)
            for heap, own in zip(self.heaps, self.questions.own, strict=True):
                self._harvest(heap, own, firsts, slot, gain, docs)
        self.clear()

    def _harvest(self, heap: list, own: list[int], firsts: np.ndarray, slot: np.ndarray, gain: np.ndarray, docs: np.ndarray) -> None:
        for t in own:
            a, b = firsts[t], firsts[t + 1]
            if a < b:  # a term's slots are distinct
                self.sums[slot[a:b]] += gain[a:b]
                self.touched[slot[a:b]] = True
        at = np.flatnonzero(self.touched)
        if not len(at):
            return
        got = self.sums[at]
        self.sums[at], self.touched[at] = 0, False
        bar = heap[0][0] if len(heap) == self.top_k else 1
        at, got = at[got >= bar], got[got >= bar]
        if len(at) > self.top_k:
            best = np.lexsort((docs[at], -got))[: self.top_k]
            at, got = at[best], got[best]
        for entry in zip(got.tolist(), (-docs[at]).tolist(), strict=True):
            if len(heap) < self.top_k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)


def question_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(q, term): the distinct terms of each question."""
    kept = items.select(F.col(id_col).cast("long").alias("q"), F.col(text_col).cast("string").alias("text"))

    def batches(parts):
        for part in (p for whole in parts for p in slices(whole, 1)):
            each = [sorted({t for piece in terms_of(x.as_py()) for t in piece}) for x in part.column(1)]
            q = pa.array(np.repeat(np.arange(part.num_rows), np.array([len(e) for e in each], np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(q), pa.array([t.decode() for e in each for t in e], pa.string())], names=["q", "term"])

    return kept.mapInArrow(batches, "q long, term string").distinct()


def statistics(docs: DataFrame, wanted: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, document frequencies of the wanted terms) of (doc_id, text) rows."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def batches(parts):
        wanted = shared.value
        found, documents, terms = np.zeros(len(wanted), np.int64), 0, 0
        for part in (p for whole in parts for p in slices(whole, 1)):
            for x in part.column(1):
                n, tf = counted(x.as_py(), wanted)
                documents += n > 0
                terms += n
                found[np.fromiter(tf, np.int64, len(tf))] += 1
        some = np.flatnonzero(found)
        keys, values = [DOCUMENTS, TERMS, *some.tolist()], [documents, terms, *found[some].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], names=["term", "n"])

    got = {r.term: r.n for r in docs.mapInArrow(batches, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each wanted term
    return got.get(DOCUMENTS, 0), got.get(TERMS, 0), np.array([got.get(i, 0) for i in range(len(wanted))], np.int64)


def search(
    docs: DataFrame,
    items: DataFrame,
    top_k: int = TOP_K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top_k`` documents with the highest score above 0, ties by ascending id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. Null, empty and termless texts match
    nothing and don't count; items without terms have no rows. Items that share an id are one item with the terms of all, those without an id too.
    Every row of ``docs`` is a document, rows that repeat an id too; rows with a null id count in the statistics and are not ranked. No documents or no items
    give no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    terms = Stored(question_terms(items, item_col, item_text_col)).df
    blocks = max(1, math.ceil(terms.count() / block_terms))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for block in range(blocks):
        part = terms if blocks == 1 else terms.where(_block(F.col("q"), blocks) == block)
        one = _search_block(texts, Questions(part.orderBy("q", "term").collect()), top_k, window)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.select(F.col("q").alias("item_id"), "rank", "doc_id", "score")


def _block(q: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(q), F.lit(blocks))


def _search_block(texts: DataFrame, questions: Questions, top_k: int, window: int) -> DataFrame:
    """(q, doc_id, score): of each task the ``top_k`` best documents of each question."""
    spark = texts.sparkSession
    documents, terms, frequency = statistics(texts, questions.wanted)
    weights = np.array([weight(documents, int(f)) for f in frequency], np.int64)
    shared = spark.sparkContext.broadcast((questions, weights))

    def batches(parts):
        questions, weights = shared.value
        now = Scores(questions, weights, top_k, window)
        for part in (p for whole in parts for p in slices(whole, 1)):
            for doc_id, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                n, tf = counted(x.as_py(), questions.wanted)
                if tf and doc_id is not None:
                    now.add(doc_id, length_share(n, documents, terms), tf)
                    if now.full():
                        now.score()
        now.score()
        for q, heap in zip(questions.ids, now.heaps, strict=True):
            if heap:
                best = sorted(heap, reverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * len(best), pa.int64()), pa.array([-d for _, d in best], pa.int64()), pa.array([s for s, _ in best], pa.int64())],
                    names=["q", "doc_id", "score"],
                )

    return texts.mapInArrow(batches, "q long, doc_id long, score long")
