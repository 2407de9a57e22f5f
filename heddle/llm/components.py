"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import Stored


def _toward_least(edges: DataFrame) -> DataFrame:
    """(node, least): the least of each node and its neighbours; edges are (node, other)."""
    return edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component_id) for every end of an edge; component_id is the least node it can reach.

    ``edges`` has two long columns. Loops, repeated edges and rows with a null end change
    nothing; no edges give no rows. Each round is two joins on aggregated minima (a hub's
    minimum is aggregated before the shuffle) and is written to the shared folder; the number of
    rounds grows with the logarithm of the longest path. Raises RuntimeError rather than return
    a component that is not whole after ``max_rounds``.
    """
    now = Stored(
        edges.select(F.greatest(a, b).cast("long").alias("node"), F.least(a, b).cast("long").alias("other"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    seen = _state(now.df)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.df.unionByName(now.df.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = (
            both.join(_toward_least(both), "node")
            .where(F.col("other") > F.col("node"))
            .select(F.col("other").alias("node"), F.col("least").alias("other"))
            .distinct()
        )
        least = _toward_least(large)
        small = (
            large.join(least, "node")
            .select(F.explode(F.array(F.struct(F.col("other").alias("node"), F.col("least").alias("other")), F.struct("node", F.col("least").alias("other")))).alias("e"))
            .select("e.*")
            .where(F.col("node") != F.col("other"))
            .distinct()
        )
        then = Stored(small)
        now.drop()
        state = _state(then.df)
        now = then
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components are not whole after {max_rounds} rounds")
    roots = now.df.select(F.col("other").alias("node"), F.col("other").alias("component_id"))
    return now.df.select("node", F.col("other").alias("component_id")).unionByName(roots.distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "other")), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first())
