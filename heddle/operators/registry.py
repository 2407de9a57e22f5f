"""Bookkeeping tables: append-only logs with views of the latest, cascades and constraints as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TITLE_CHARS = 80


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, by a partial aggregate: no window, so a hot key is one row before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(log.columns)


def first_of(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: an insert that leaves what is there."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(log.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of the same key replaced and new ones added."""
    return table.join(rows.select(*keys), keys, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def delete_cascade(tables: dict[str, DataFrame], graph: list[tuple[str, str, str, str]], root: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the ``gone`` rows of ``root`` and what refers to them.

    ``graph`` lists (child, child column, parent, parent column), parents first.
    """
    key = gone.columns
    lost = {root: tables[root].join(gone, key, "left_semi")}
    out = {**tables, root: tables[root].join(gone, key, "left_anti")}
    for child, column, parent, parent_column in graph:
        if parent in lost:
            ids = lost[parent].select(F.col(parent_column).alias(column)).distinct()
            lost[child] = tables[child].join(ids, column, "left_semi")
            out[child] = out[child].join(ids, column, "left_anti").select(tables[child].columns)
    return out


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows that refer to nothing: empty if the foreign key holds."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): empty if the keys are unique."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def sync(known: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): ``removed`` where only known, ``new`` where only wanted."""
    gone = known.select(*keys).distinct().join(wanted.select(*keys), keys, "left_anti").withColumn("change", F.lit("removed"))
    return gone.unionByName(wanted.select(*keys).distinct().join(known.select(*keys), keys, "left_anti").withColumn("change", F.lit("new")))


def sessions(turns: DataFrame, session: str = "conv_id", turn: str = "turn", question: str = "text") -> DataFrame:
    """(session, title, turns, last_turn): the title is the first question's first 80 characters."""
    return turns.groupBy(session).agg(
        F.substring(F.min_by(question, turn), 1, TITLE_CHARS).alias("title"),
        F.count("*").alias("turns"),
        F.max(turn).alias("last_turn"),
    )


def history(turns: DataFrame, pairs: int, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last turns of each session, ``recent`` counting from 1 at the newest."""
    order = Window.partitionBy(session).orderBy(F.desc(turn))
    return turns.withColumn("recent", F.row_number().over(order).cast("long")).where(F.col("recent") <= pairs)


def throughput(items: Column, ms: Column) -> Column:
    """Items a second; null where no time passed."""
    return F.try_divide(items.cast("double"), ms / 1000)


def library(experiments: DataFrame, collections: DataFrame, name: str) -> DataFrame:
    """Rows of either side with ``has_row`` and ``has_collection``."""
    a, b = experiments.withColumn("has_row", F.lit(True)), collections.withColumn("has_collection", F.lit(True))
    met = a.join(b, name, "full_outer")
    return met.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_row", "has_collection")})
