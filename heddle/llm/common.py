"""What the operators share: reading tables, cutting lineage, dealing rows into ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.session import Scope, Stored, shared_dir
from heddle.sources.tables import table


__all__ = ["Scope", "Stored", "parallelism", "range_bounds", "range_of", "shared_dir", "slices", "spare", "table"]

SLICE_BYTES = 1 << 18


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def range_bounds(df: DataFrame, column: str, ranges: int) -> list[int]:
    """At most ``ranges - 1`` cut points that split a long column into about equal ranges.

    Only that column is read; the driver gets the cut points alone.
    """
    cuts = df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], max(1000, 2 * ranges))).first()[0] if ranges > 1 else None
    return sorted(set(cuts or []))


def range_of(column: Column, bounds: list[int]) -> Column:
    """The number of the range that a value falls in (how many cuts are at or below it), 0 for nulls."""
    if not bounds:
        return F.lit(0)
    g = max(1, round(len(bounds) ** 0.5))
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  one literal, folded by the planner
    at_or_below = lambda xs: F.size(F.filter(xs, lambda c: c <= column))
    head = at_or_below(longs(bounds[::g]))
    inside = at_or_below(F.slice(longs(bounds), F.greatest(head - F.lit(1), F.lit(0)) * F.lit(g) + F.lit(1), g))
    return F.when(head > 0, (head - F.lit(1)) * F.lit(g) + inside).otherwise(F.lit(0))


def slices(part: pa.RecordBatch, at: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in consecutive slices of about ``size`` bytes of its text column (a longer text is a slice of its own).

    What Python holds at a time so follows the longest text, not the rows of a batch.
    """
    lengths = pc.fill_null(pc.binary_length(part.column(at)), 0).to_numpy().astype(np.int64)
    before = np.cumsum(lengths) - lengths
    cuts = [*np.flatnonzero(np.diff(before // size, prepend=-1)).tolist(), part.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        yield part.slice(start, end - start)
