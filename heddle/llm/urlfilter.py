"""URL filters by a temporal list join.

A list is a log of dated entries: from a day on, a host, a domain with all below it, or a path prefix is blocked, allowed,
or no longer listed. Consecutive entries of the same target become validity intervals; an entry that takes a target off the
list (``clear``) only ends the interval before it, so that less specific targets decide again. Every capture is judged
by the entries in force when it was fetched: an as-of join of its target keys with the intervals. The most
specific target decides (the longest prefix, then the host, then the longest domain); entries of one target on the same
day count as the strictest of them.

Captures that share a URL and a time are judged once. A list of at most ``broadcast_rows`` intervals is
broadcast, after counting it; a longer one is joined by a shuffle with the keys salted, so a host that has a third of all
captures is spread over many tasks. What was decided is joined back on URL and time, salted too, as one pair may have a third of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import spare

BROADCAST_ROWS = 500_000
SALTS = 32
BACK_SALTS = 8
#: Strictness of actions on the same day, and specificity of kinds.
STRICT = {"clear": 0, "allow": 1, "block": 2}
KINDS = {"domain": 1, "host": 2, "prefix": 3}
VERDICTS = {"block": "blocked", "allow": "allowed"}
NO_URL, UNLISTED = "no_url", "unlisted"


def host(url: Column) -> Column:
    """The lower-case host of an absolute URL without user, port or final dot, an IPv6 address in its brackets; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.%]+\]|[^/?#:@\[\]]+?)\.?(?:[:/?#]|$)", 1))


def path_segments(url: Column) -> Column:
    """The non-empty segments of the path, case kept."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.array_remove(F.split(path, "/"), "")


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, action, valid_from, valid_to) from (kind, value, action, listed_on).

    ``valid_to`` is the target's next date, null for its last; intervals that begin with ``clear`` are none. Entries with a null or unknown part are left out;
    hosts and domains are compared without case, prefixes lose their final slash and their host's case; a prefix that is a host alone has every path of it. Repeated
    entries count once.
    """
    strict = F.create_map(*[x for a, n in STRICT.items() for x in (F.lit(a), F.lit(n))])
    low = F.lower("value")
    value = F.when(
        F.col("kind") == "prefix",
        F.concat(
            F.substring_index(low, "/", 1),
            F.regexp_replace(F.substring(F.col("value"), F.length(F.substring_index("value", "/", 1)) + F.lit(1), F.length("value")), "/+$", ""),
        ),
    ).otherwise(F.rtrim(low, F.lit(".")))
    days = (
        entries.where(F.col("kind").isin(*KINDS) & F.col("action").isin(*STRICT) & F.col("value").isNotNull() & F.col("listed_on").isNotNull())
        .select("kind", value.alias("value"), "listed_on", F.struct(F.try_element_at(strict, F.col("action")).alias("n"), "action").alias("a"))
        .groupBy("kind", "value", "listed_on")
        .agg(F.max("a")["action"].alias("action"))
    )
    order = Window.partitionBy("kind", "value").orderBy("listed_on")
    dated = days.select("kind", "value", "action", F.col("listed_on").alias("valid_from"), F.lead("listed_on").over(order).alias("valid_to"))
    return dated.where(F.col("action") != "clear")


def _keys(url: Column, depths: list[int]) -> Column:
    """The targets that a URL can match: (kind, value, rank); only prefixes as deep as the list's are made."""
    name, segments = host(url), path_segments(url)
    labels = F.when(name.startswith("["), F.array(name)).otherwise(F.split(name, r"\."))
    key = lambda kind, value, rank: F.struct(F.lit(kind).alias("kind"), value.alias("value"), rank.cast("int").alias("rank"))
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), "."), F.size(labels) - i),
    )
    prefixes = [
        F.when(F.size(segments) >= d, key("prefix", F.array_join(F.concat(F.array(name), F.slice(segments, 1, d)), "/"), F.lit(d))) for d in depths
    ]
    return F.when(name != "", F.array_compact(F.concat(domains, F.array(key("host", name, F.lit(0)), *prefixes))))


def judge(
    captures: DataFrame,
    entries: DataFrame,
    url_col: str = "url",
    time_col: str = "fetched_at",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``captures`` with ``verdict``, ``matched_kind``, ``matched_value`` and ``listed_on`` of the entry that decided.

    The verdict is ``blocked``, ``allowed``, ``unlisted`` (no entry in force; a null time has none) or ``no_url`` (null, empty
    or without a host). Every row stays, repeated rows too. Columns of the added names are replaced; all others pass
    through, whatever they are called.
    """
    added = ("verdict", "matched_kind", "matched_value", "listed_on")
    rows = captures.select(*[f"`{c}`" for c in captures.columns if c not in added])
    valid = intervals(entries)
    n, depths = valid.agg(F.count("*"), F.collect_set(F.when(F.col("kind") == "prefix", F.size(F.split("value", "/")) - F.lit(1)))).first()
    own_url, own_time = F.col(f"`{url_col}`").cast("string"), F.col(f"`{time_col}`")
    once = rows.select(own_url.alias("url"), own_time.alias("at")).where("url IS NOT NULL AND at IS NOT NULL").distinct()
    keys = once.select(
        "url",
        "at",
        F.explode_outer(_keys(F.col("url"), sorted(depths))).alias("k"),
    ).select("url", "at", "k.kind", "k.value", "k.rank")
    on = ["kind", "value"]
    if n <= broadcast_rows:
        valid = F.broadcast(valid)
    else:
        keys = keys.withColumn("salt", F.pmod(F.xxhash64("url", "at"), F.lit(SALTS)).cast("int"))
        valid = valid.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        on.append("salt")
    in_force = keys.join(valid, on).where((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    special = F.create_map(*[x for k, i in KINDS.items() for x in (F.lit(k), F.lit(i))])
    best = in_force.groupBy("url", "at").agg(
        F.max(F.struct(F.try_element_at(special, F.col("kind")).alias("special"), "rank", "kind", "value", "action", "valid_from")).alias("best")
    )
    # one column of a name that no capture has carries the key, another what was decided
    key, found = spare(rows, "judged_key"), spare(rows, "judged")
    nth = F.monotonically_increasing_id()
    salt = F.when(own_url.isNotNull() & own_time.isNotNull(), F.pmod(nth, F.lit(BACK_SALTS))).otherwise(F.lit(-1) - nth).cast("long")  # rows that match nothing are spread
    keyed = rows.withColumn(key, F.struct(own_url.alias("url"), own_time.alias("at"), salt.alias("salt")))
    decided = best.withColumn(
        "salt",
        F.explode(F.array(*[F.lit(i).cast("long") for i in range(BACK_SALTS)])),
    ).select(F.struct("url", "at", "salt").alias(key), F.col("best").alias(found))
    joined = keyed.join(decided, key, "left")
    verdict = F.when(F.coalesce(host(own_url), F.lit("")) == "", F.lit(NO_URL))
    for action, name in VERDICTS.items():
        verdict = verdict.when(F.col(f"{found}.action") == action, F.lit(name))
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        verdict.otherwise(F.lit(UNLISTED)).alias("verdict"),
        F.col(f"{found}.kind").alias("matched_kind"),
        F.col(f"{found}.value").alias("matched_value"),
        F.col(f"{found}.valid_from").alias("listed_on"),
    )
