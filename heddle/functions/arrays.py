"""Array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def scan(values: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """What an associative ``merge`` makes of the elements before each element, from ``start``, its neutral element; one more at the end for all of them.

    It runs within blocks first and over the blocks then, so that a long array isn't copied for every element.
    """
    run = lambda xs: F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK)), lambda i: run(F.slice(values, i, BLOCK)))
    before = run(F.transform(blocks, lambda b: F.element_at(b, -1)))
    inside = F.flatten(
        F.zip_with(
            blocks,
            F.slice(before, 1, F.size(before) - F.lit(1)),
            lambda b, first: F.transform(F.slice(b, 1, F.size(b) - F.lit(1)), lambda x: merge(first, x)),
        )
    )
    return F.concat(inside, F.slice(before, -1, 1))


def running(sizes: Column) -> Column:
    """The sum of the sizes before each element, as longs."""
    sums = scan(sizes, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.slice(sums, 1, F.size(sums) - F.lit(1))
