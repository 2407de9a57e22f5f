"""Bottom-k sketches of word shingles: resemblance, containment and distinct counts of documents.

A sketch is the ascending array of the k least distinct 32-bit shingle hashes, so a set of fewer than k is
kept whole. The sketch of a union is the bottom k of the sketches' union: sketches of parts merge exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import parallelism, range_bounds, range_of
from heddle.llm.shingles import WORDS, with_shingles

K = 128
SPACE = float(1 << 32)
RANGES_PER_PARTITION = 8
MOST_RANGES = 100_000  # a range of 100 TB then has a gigabyte


def bottom(hashes: Column, k: int = K) -> Column:
    """The sketch of an array of 32-bit hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: Column, to: str, k: int = K, size: int = WORDS) -> DataFrame:
    """Adds the sketch of a text; null and wordless texts have the empty one."""
    tmp = f"_{to}_hashes"
    df = with_shingles(df, text, tmp, size)
    return df.withColumn(to, bottom(F.transform(tmp, lambda x: F.shiftrightunsigned(x, 32)), k)).drop(tmp)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Distinct shingles: exact below k, else (k - 1) over the k-th least hash's share of the hash space."""
    full = F.lit(k - 1) / ((F.get(sketch, F.lit(k - 1)) + F.lit(1)) / F.lit(SPACE))
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(full)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard likeness from 0 to 1: the share of the union's sketch that both have; 1 for two empty sets."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has, from 0 to 1; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct_count(a, k), F.lit(1.0))))


def to_string(sketch: Column) -> Column:
    """Eight hexadecimal digits for each hash, end to end."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def sketch_all(df: DataFrame, key: str | Column, sketch: str = "sketch", k: int = K) -> DataFrame:
    """(key, sketch): the sketch of each key's union of sketches, with partial bottom-k sets before the shuffle.

    Hashes are distinct by key after the first aggregation; only those that can be among a key's k least go on, by
    a rank over a salted part of the key first, so no task holds a key's hashes whole.
    """
    name = F.col(key) if isinstance(key, str) else key
    hashes = df.select(name.alias("key"), F.explode(sketch).alias("h")).distinct()
    salted = Window.partitionBy("key", F.pmod("h", F.lit(64))).orderBy("h")
    some = hashes.withColumn("nth", F.row_number().over(salted)).where(F.col("nth") <= k)
    ranked = some.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("h"))).where(F.col("nth") <= k)
    return ranked.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def _beside_next(docs: DataFrame, key: str) -> tuple[DataFrame, Window]:
    """Adds ``_range``, ``_extra`` and the rows that follow each range's last; and the window in which lead() is the next row.

    Rows are dealt by ranges of the key; rows without a key, which come first, by ranges of ``_tie``, below 0. Each range also gets the first row of
    the range after it (the last gets the first's), marked ``_extra``: one row a range, so every next row is found within a range.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    keyed = docs.withColumn("_order", order)
    ranges = min(MOST_RANGES, RANGES_PER_PARTITION * parallelism(spark))
    bounds = range_bounds(keyed.where(F.col(key).isNotNull()).select("_order"), "_order", ranges)
    by_tie = F.least(F.lit(-1), F.floor((F.col("_tie").cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(ranges)).cast("int") - F.lit(ranges))
    keyed = keyed.withColumn("_range", F.when(F.col(key).isNull(), by_tie).otherwise(range_of(F.col("_order"), bounds)).cast("int"))
    firsts = keyed.groupBy("_range").agg(F.min(F.struct("_order", "_tie")).alias("first")).orderBy("_range").collect()  # one row a range
    ends = [(*r["first"], firsts[i - 1]["_range"]) for i, r in enumerate(firsts)]
    extra = keyed.withColumn("_extra", F.lit(False))
    if ends:
        to = spark.createDataFrame(ends, "_order long, _tie long, _range int")
        first = keyed.drop("_range").join(F.broadcast(to), ["_order", "_tie"]).dropDuplicates(["_range"])
        extra = extra.unionByName(first.withColumn("_extra", F.lit(True)).select(extra.columns))
    return extra, Window.partitionBy("_range").orderBy("_extra", "_order", "_tie")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = WORDS) -> DataFrame:
    """Sketches of every text and of its edited text, and how like it is to that and to the next document.

    The next document is the one with the next greater id (null first, ties by the text's hash), after the last the
    first. The edited text has the last floor(n_chars / 2) code points replaced by the next document's first as many,
    or all it has. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (see ``to_string``),
    near_edited, near_next, n_distinct (estimate), in_next (estimated containment in the next document).
    Null texts are empty. Extra columns are not read. No rows give no rows.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows, window = _beside_next(kept.withColumn("_tie", F.xxhash64("text")), "doc_id")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("next_text", F.lead("text").over(window)).withColumns(
        {
            "n_chars": F.length("text").cast("long"),
            "edited": F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.coalesce(F.col("next_text"), F.lit("")), half)),
        }
    )
    rows = with_sketch(rows, F.col("text"), "own", k, size)
    rows = with_sketch(rows, F.when(~F.col("_extra"), F.col("edited")), "changed", k, size)
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("text", "next_text", "edited")
    rows = rows.withColumn("next_own", F.lead("own").over(window)).where(~F.col("_extra"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", to_string(F.col("own")).alias("fingerprint"), to_string(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"),
        distinct_count(F.col("own"), k).alias("n_distinct"), containment(F.col("own"), F.col("next_own"), k).alias("in_next"),
    )
