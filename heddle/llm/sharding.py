"""Shards by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child draws ``-ln(u) / weight``, where u is a hash of the row's key and the child's
name in (0, 1); the least draw wins, so a child gets rows in proportion to its weight. A child's draws
depend on nothing but its own name and weight: where a weight grows, rows move only into that subtree;
where it shrinks, only out of it. A new shard enters as a region of its own, so that a tree with one more
shard takes rows only into that shard.

Slots number a shard's rows from 0 without gaps in the order of the key. Rows are dealt by ranges of the
key; each (shard, range) is numbered on its own, after the rows of the ranges before it.
Equal rows are counted before they are shuffled, and numbered together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import parallelism, range_bounds, range_of

SHARDS = 24
RACK = 4
REGION = 12
PART = 4096
RANGES_PER_PARTITION = 2


@dataclass(frozen=True)
class Node:
    """A region, a rack or (without children) a shard, which has a number."""

    name: str
    children: tuple[Node, ...] = ()
    weight: float = 1.0
    shard: int = -1

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def tree(shards: int = SHARDS, weights: dict[int, float] | None = None, added: int = 0) -> Node:
    """Racks of RACK shards in regions of REGION; each shard beyond ``shards`` is a region of its own."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    leaf = lambda i: Node(f"shard-{i}", weight=(weights or {}).get(i, 1.0), shard=i)
    regions = []
    for r in range(0, shards, REGION):
        racks = [
            Node(f"rack-{k}", tuple(leaf(i) for i in range(k, min(k + RACK, r + REGION, shards)))) for k in range(r, min(r + REGION, shards), RACK)
        ]
        regions.append(Node(f"region-{r}", tuple(racks)))
    for i in range(shards, shards + added):
        regions.append(Node(f"region-of-{i}", (Node(f"rack-of-{i}", (leaf(i),)),)))
    return Node("root", tuple(regions))


def _draw(key: Column, node: Node) -> Column:
    """The node's draw: exponential with the node's total weight as its rate; the least of several wins."""
    top = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double")
    return -F.log((top + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(node.total)


def shard_of(key: Column, node: Node) -> Column:
    """The number of the shard that a key falls in; only the draws on its path are taken."""
    if not node.children:
        return F.lit(node.shard)
    able = [c for c in node.children if c.total > 0]
    if len(able) == 1:
        return shard_of(key, able[0])
    pick = F.array_min(F.array(*[F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(able)]))["child"]
    if all(not c.children for c in able):
        return F.get(F.array(*[F.lit(c.shard) for c in able]), pick)
    out = shard_of(key, able[-1])
    for i, c in reversed(list(enumerate(able[:-1]))):
        out = F.when(pick == i, shard_of(key, c)).otherwise(out)
    return out


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: dict[int, float] | None = None,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``size`` is the text's UTF-8 bytes (none for null) plus 8; ``law`` is ``key``: the id and the tree decide.
    ``grown_shard`` is the shard in the tree with one more. Rows that repeat an id share its shard; a null id is
    a key of its own. A shard's slots follow the id (null first), then size and checksum. No rows give no rows.
    """
    spark = docs.sparkSession
    now, grown = tree(shards, weights), tree(shards, weights, added=1)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("copies"))
    )
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    bounds = range_bounds(ids, "doc_id", RANGES_PER_PARTITION * parallelism(spark))
    place = range_of(F.col("doc_id"), bounds).cast("int")
    if ids.where("doc_id IS NULL").limit(1).count():  # rows without an id all fall to one shard: ranges of their sizes, before the others
        place = F.when(F.col("doc_id").isNull(), F.floor(F.log2(F.col("size")) * F.lit(8)).cast("int") - F.lit(300)).otherwise(place)
        ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"))
    dealt = rows.withColumns({"shard": shard_of(key, now), "range": place})
    sizes = ids.groupBy(shard_of(key, now).alias("shard"), place.alias("range")).agg(F.count("*").alias("n"))
    before = sizes.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("before"))
    order = Window.partitionBy("shard", "range").orderBy("doc_id", "size", "text_crc32")
    numbered = dealt.withColumn("first", F.sum("copies").over(order) - F.col("copies"))
    placed = numbered.join(F.broadcast(before), ["shard", "range"])  # at most shards x ranges rows, whatever the table
    # equal rows in parts, so that no array holds them all
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - F.lit(1), F.lit(PART).cast("long")))
    parts = placed.withColumn("start", start).withColumn("from", F.col("before") + F.col("first") + F.col("start"))
    last = F.col("from") + F.least(F.lit(PART).cast("long"), F.col("copies") - F.col("start")) - F.lit(1)
    return parts.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.explode(F.sequence("from", last)).alias("slot"), shard_of(key, grown).cast("int").alias("grown_shard"),
    )
