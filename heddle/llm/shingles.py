"""Word shingles as arrays of hashes, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 5
#: Runs of these separate words.
SPACES = r"\s+"
SYMBOLS = r"[^\p{L}\p{N}]+"


def words(text: Column, separator: str = SPACES) -> Column:
    """The lower-case words of a text; none for null."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.array_remove(F.split(low, separator), "")


def with_shingles(df: DataFrame, text: Column, to: str = "shingles", size: int = WORDS, separator: str = SPACES) -> DataFrame:
    """Adds the array of the hashes of all word n-grams, repeats included.

    Fewer words than ``size`` are one shingle together, none give an empty array. Each word is hashed once; a
    shingle's hash chains those of its words. The steps are columns of their own: Spark evaluates a column that later
    steps use repeatedly once, but would repeat an expression inside a lambda for every element.
    """
    h = f"_{to}_words"
    df = df.withColumn(h, F.transform(words(text, separator), lambda w: F.xxhash64(w)))
    chained = F.transform(F.col(h), lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + F.lit(j)) for j in range(1, size)]))
    n = F.size(h)
    return df.withColumn(
        to,
        F.when(n >= size, F.slice(chained, 1, n - F.lit(size - 1))).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")),
    ).drop(h)
