"""Spelling variants by pairless wildcard groups.

Two words that differ in one replaced character share exactly one group (position, prefix, suffix): the word with a
wildcard at that position. A group keeps its size and its two leading words; a member then has size - 1 near words in it, and the best of them
is the leader, or the second for the leader itself. Words that differ by one inserted or deleted character meet where a deletion of
the longer one is the shorter: deletions join the vocabulary, and such a group keeps how many words come down to its word and the
best of them. What the groups of a word say is summed up; no pair of words is ever a row.

A group has at most one word for each letter and place, so none is hot, however often a word occurs. Occurrences are counted in Arrow batches before
they are shuffled; from there on all is DataFrame work whose rows follow the vocabulary, about twice a word's length for each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import Stored, slices
from heddle.session import ship

RUN, AFTER = re.compile(rb"[a-z\xc0-\xff]+"), re.compile(rb"[^a-z\xc0-\xff]")
PIECE = 1 << 20  # bytes of a text whose words are a list at a time
HELD = 200_000  # words that a task counts before it passes them on
SHORTEST, LEAST, RATIO, DROPPED = 5, 3, 2, 97
WILDCARD = "\x00"  # no word has it
LITERAL = 64  # code points: the groups of longer words go by a digest, so that a word's rows stay linear in its length
OWNER, LONGER, MEMBER = 0, 1, 2  # a word as such, a deletion of a longer one, a word with a wildcard


def words_of(doc_id: int | None, text: str | None, dropped: int = DROPPED) -> Counter:
    """How often each word is in a whole text, as Latin-1 bytes in lower case (A-Z alone).

    Where ``dropped`` divides the crc32 of ``<doc_id>:<word>``, the word loses the letter at the crc32 modulo its length (a null id
    is written as nothing). Letters beyond Latin-1 end a word; a text is looked through piece by piece.
    """
    found: Counter = Counter()
    line = text.encode("latin-1", "replace").lower() if text else b""
    at = 0
    while at < len(line):
        end = AFTER.search(line, at + PIECE)
        end = end.start() if end else len(line)
        found.update(RUN.findall(line, at, end))
        at = end
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for word, n in found.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        i = h % len(word)
        out[word if h % dropped else word[:i] + word[i + 1 :]] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped: int = DROPPED, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the words of all texts with at least ``shortest`` letters and ``least`` occurrences; see ``words_of``."""
    ship(docs.sparkSession)

    def batches(parts):
        held: Counter = Counter()

        def counted():
            got = pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays(list(got), names=["word", "n"])

        for part in (p for whole in parts for p in slices(whole, 1)):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                for word, n in words_of(doc_id, text.as_py(), dropped).items():
                    if len(word) >= shortest:
                        held[word] += n
            if len(held) >= HELD:
                yield counted()
        yield counted()

    each = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(batches, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def without(word: Column, at: Column) -> Column:
    """The word without its code point ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + F.lit(2), F.length(word)))


def _with_wildcard(word: Column, at: Column) -> Column:
    key = F.concat(F.substring(word, F.lit(1), at), F.lit(WILDCARD), F.substring(word, at + F.lit(2), F.length(word)))
    return F.when(F.length(word) <= LITERAL, key).otherwise(F.concat(F.lit(WILDCARD * 2), F.sha2(key.cast("binary"), 256)))


def _short_name(word: Column) -> Column:
    """A word as the name of its group."""
    return F.when(F.length(word) < LITERAL, word).otherwise(F.concat(F.lit(WILDCARD * 3), F.sha2(word.cast("binary"), 256)))


def _groups(words: DataFrame) -> DataFrame:
    """(key, role, word, n): each word in all groups that it is in."""
    word, places = F.col("word"), F.sequence(F.lit(0), F.length("word") - F.lit(1))
    named = lambda role, key: F.struct(F.lit(role).alias("role"), key.alias("key"))
    shorter = F.array_distinct(F.transform(places, lambda i: _short_name(without(word, i))))
    keys = F.concat(
        F.array(named(OWNER, _short_name(word))),
        F.transform(shorter, lambda k: named(LONGER, k)),
        F.transform(places, lambda i: named(MEMBER, _with_wildcard(word, i))),
    )
    return words.select("word", "n", F.explode(keys).alias("k")).select("k.key", "k.role", "word", "n")


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are one edit away, and (-n, word) of the commonest of them; words without any are absent."""
    group = Window.partitionBy("key")
    order = group.orderBy("role", F.desc("n"), "word")
    entry = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    # a group is of members alone, or of at most one owner, which comes first, and the longer words, the commonest first
    seen = _groups(words).select(
        "word",
        "role",
        entry.alias("own"),
        F.count("*").over(group).alias("size"),
        F.row_number().over(order).alias("nth"),
        F.first("role").over(order).alias("first_role"),
        F.first(entry).over(order).alias("first"),
        F.lead(entry).over(order).alias("after"),
    ).where("size > 1")
    others = F.col("size") - F.lit(1)
    leads = F.col("nth") == 1
    told = seen.select(
        "word",
        F.when(F.col("role") == LONGER, F.lit(1).cast("long")).otherwise(others).alias("count"),
        F.when(leads, F.col("after")).otherwise(F.col("first")).alias("best"),
        (F.col("first_role") != LONGER).alias("counts"),  # longer words that come down to no word say nothing
    ).where("counts")
    return told.groupBy("word").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, n, n_near, form_n): a word's form is its commonest near word, ties by code points, if that occurs ``ratio`` times as often; else null."""
    found = words.join(near(words), "word", "left")
    more = -F.col("best.less")
    strong = more >= F.lit(ratio) * F.col("n")
    return found.select(
        "word",
        F.when(strong, F.col("best.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, more).alias("form_n"),
    )


def roots(chains: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows, forms followed to the last; chains halve every round.

    A form occurs at least twice as often as its word, so no chain comes back and rounds grow with the logarithm of the logarithm of the commonest
    word's count.
    """
    now = Stored(chains.select("word", F.col("form").alias("root")))
    while True:
        further = now.df.select(F.col("word").alias("root"), F.col("root").alias("last"))
        then = Stored(now.df.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")))
        now.drop()
        moved = then.df.agg(F.count_if("moved")).first()[0]
        now = then
        if not moved:
            return now.df.select("word", "root")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the vocabulary of all texts and what each word is a variant of.

    ``root`` is the last word that forms lead to, the word itself if it has no form. Null and empty texts have no words; rows that repeat are
    read as often as they are there; no words give no rows. Other columns are not read, whatever their names. A word of very many letters
    costs time by the square of its length, and memory in proportion to it.
    """
    words = Stored(vocabulary(docs, id_col, text_col, **options)).df
    found = Stored(forms(words)).df
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
