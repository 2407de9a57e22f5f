"""Evaluation: shares, latencies, ranking metrics and the difference of two runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ids(condition) -> F.Column:
    return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col("id")))), ",")


def summarise(cases: DataFrame) -> DataFrame:
    """One row of a run: each share as how many and of how many, latencies, extremes and the ids of odd cases.

    ``cases`` has id, expect (answer, abstain, direct), outcome, route, ok, found, says_not, total_ms, model_calls, searches, error.
    """
    ran = F.col("error").isNull()
    answerable, unanswerable = ran & (F.col("expect") == "answer"), ran & (F.col("expect") == "abstain")
    abstained = ran & (F.col("outcome") == "abstained")
    right_route = F.col("route") == F.when(F.col("expect") == "direct", "direct").otherwise("retrieve")
    share = lambda name, test, base: [F.count_if(base & test).alias(name), F.count_if(base).alias(f"{name}_of")]
    return cases.agg(
        F.count("*").alias("cases"),
        _ids(~ran).alias("failed"),
        *share("hit_rate", F.col("found"), answerable),
        *share("correct", F.col("ok"), answerable),
        *share("abstain_precision", F.col("expect") == "abstain", abstained),
        *share("abstain_recall", F.col("outcome") == "abstained", unanswerable),
        *share("route_accuracy", right_route, ran),
        _ids(ran & (F.col("expect") != "direct") & (F.col("route") == "direct")).alias("knowledge_sent_direct"),
        _ids(ran & F.col("says_not")).alias("says_not_in_documents"),
        F.round(F.median(F.when(ran, F.col("total_ms") / 1000)), 6).alias("median_s"),
        F.round(F.percentile_disc(0.95, F.when(ran, F.col("total_ms") / 1000)) if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN error IS NULL THEN total_ms / 1000 END)"), 6).alias("p95_s"),
        F.median(F.when(ran, F.col("model_calls"))).alias("model_calls_median"),
        F.max(F.when(ran, F.col("searches"))).alias("searches_max"),
    )


def node_medians(timings: DataFrame, turn: str, node: str, ms: str) -> DataFrame:
    """(node, turns, median_ms): a turn's repeats of a node are summed first."""
    per_turn = timings.groupBy(turn, node).agg(F.sum(ms).alias("_ms"))
    return per_turn.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("turns"), F.round(F.median("_ms"), 6).alias("median_ms"))


def ranking_metrics(
    hits: DataFrame,
    relevant: DataFrame,
    ks: tuple[int, ...] = (1, 3, 5, 10),
    query: str = "query_id",
    item: str = "item_id",
) -> DataFrame:
    """(query, first, average_precision and for each k: hit, recall, precision, ndcg).

    ``hits`` has (query, item, rank), ``relevant`` (query, item). An item counts at its best rank.
    """
    best = hits.groupBy(query, item).agg(F.min("rank").alias("rank"))
    wanted = relevant.select(query, item).distinct()
    total = wanted.groupBy(query).agg(F.count("*").alias("n"))
    found = best.join(wanted, [query, item]).withColumn("nth", F.row_number().over(Window.partitionBy(query).orderBy("rank")))
    gain = 1 / F.log2(F.col("rank") + 1)
    met = total.join(found, query, "left").groupBy(query, "n")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = met.agg(
        F.coalesce(F.try_divide(F.lit(1.0), F.min("rank")), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.col("nth") / F.col("rank")), F.lit(0.0)).alias("_ap"),
        *[F.count_if(F.col("rank") <= k).alias(f"_h{k}") for k in ks],
        *[F.coalesce(F.sum(F.when(F.col("rank") <= k, gain)), F.lit(0.0)).alias(f"_g{k}") for k in ks],
    )
    out = [query, F.round("mrr", 6).alias("mrr"), F.round(F.col("_ap") / F.col("n"), 6).alias("map")]
    for k in ks:
        hit = F.col(f"_h{k}")
        out += [
            (hit > 0).cast("int").alias(f"hit_{k}"),
            F.round(hit / F.col("n"), 6).alias(f"recall_{k}"),
            F.round(hit / F.lit(k), 6).alias(f"precision_{k}"),
            F.round(F.col(f"_g{k}") / ideal(k), 6).alias(f"ndcg_{k}"),
        ]
    return rows.select(*out)


def latency(rows: DataFrame, by: str, ms: str) -> DataFrame:
    """(by, n, mean, p50, p95, p99, least, most); percentiles are values that occur (nearest rank)."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {ms})")
    return rows.groupBy(by).agg(
        F.count(ms).alias("n"),
        F.round(F.avg(ms), 6).alias("mean"),
        at(0.5).alias("p50"),
        at(0.95).alias("p95"),
        at(0.99).alias("p99"),
        F.min(ms).alias("least"),
        F.max(ms).alias("most"),
    )


def changes(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, was, changed) of two runs' numbers; ``was`` is null for what the earlier run lacks."""
    old = before.select(F.col(key), F.col(value).alias("was"))
    return now.select(key, value).join(old, key, "left").withColumn("changed", F.col("was").isNotNull() & ~F.col(value).eqNullSafe(F.col("was")))


def fold_turn(events: DataFrame, turn: str, seq: str, kind: str, value: str) -> DataFrame:
    """(turn, events, trace, last_of_kind...): a turn's events in order as one row, by an ordered fold."""
    met = events.groupBy(turn).agg(
        F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(kind).alias("kind"), F.col(value).alias("value")))).alias("e")
    )
    runs = F.aggregate(
        "e",
        F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == x["kind"]), acc).otherwise(F.concat(acc, F.array(x["kind"]))),
    )
    return met.select(
        turn,
        F.size("e").cast("long").alias("events"),
        F.array_join(runs, ">").alias("trace"),
        F.element_at("e", -1)["kind"].alias("last_kind"),
        F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x["value"]), 4).alias("total"),
    )


@contextmanager
def timed(record: Callable[[dict], None], **what: object) -> Iterator[dict]:
    """Measures what is done inside and hands on ``what`` with ``duration_ms`` and whether it ``failed``; values put into the dict go along."""
    began, seen = time.perf_counter(), dict(what)
    try:
        yield seen
    except BaseException:
        record(seen | {"duration_ms": (time.perf_counter() - began) * 1000, "failed": True})
        raise
    record(seen | {"duration_ms": (time.perf_counter() - began) * 1000, "failed": False})
