"""Verdicts against a direct version over the entry log, and odd rows."""

import random
import re
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from heddle.llm import urlfilter

DAY = datetime(2024, 1, 1)


def direct(url, time, entries):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-fA-F:.%]+\]|[^/?#:@\[\]]+)([^?#]*)", url or "")
    if not m or not m[1].strip("."):
        return ("no_url", None, None)
    name = m[1].lower().removesuffix(".")
    path = re.sub(r"^:\d*", "", m[2])
    segments = [s for s in path.split("/") if s]
    labels = [name] if name[0] == "[" else name.split(".")
    targets = [("prefix", "/".join([name, *segments[:d]])) for d in range(len(segments), -1, -1)] + [("host", name)] + [("domain", ".".join(labels[i:])) for i in range(len(labels))]
    for kind, value in targets:
        past = [(when, urlfilter.STRICT[a], a) for k, v, a, when in entries if k == kind and v == value and time is not None and when <= time]
        if past:
            day = max(past)[0]
            action = max((n, a) for when, n, a in past if when == day)[1]
            if action != "clear":  # a target that is no longer listed leaves the decision to less specific ones
                return ({"block": "blocked", "allow": "allowed"}[action], kind, value)
    return ("unlisted", None, None)


def test_judge_equals_direct(spark):
    rng = random.Random(8)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c.net", "WWW.B.org", "[::1]", "[2001:DB8::7]"]
    entries = [
        (kind, value, rng.choice(list(urlfilter.STRICT)), DAY + timedelta(days=rng.randrange(20)))
        for _ in range(60)
        for kind, value in [rng.choice([("domain", "a.com"), ("domain", "com"), ("host", "x.a.com"), ("host", "b.org"), ("prefix", "a.com/p"), ("prefix", "a.com/p/q"), ("prefix", "c.net/P"), ("prefix", "b.org"), ("prefix", "[::1]"), ("domain", "org"), ("host", "[::1]"), ("domain", "[2001:db8::7]")])]
    ]
    rows = []
    for i in range(400):
        url = f"http{rng.choice(['', 's'])}://{rng.choice(['', 'u:p@'])}{rng.choice(hosts)}{rng.choice(['', ':80', '.'])}{rng.choice(['', '/', '/p', '/p/q/r', '/P?x=/p', '/pq', '#p'])}"
        rows.append((i, url, DAY + timedelta(hours=rng.randrange(600)), "v"))
    rows += [(900, None, DAY, "v"), (901, "", DAY, "v"), (902, "nonsense", DAY, "v"), (903, "http://a.com/", None, "v"), (904, "http://a.com/" + "p/" * 5000, DAY + timedelta(days=30), "v")] + rows[:20]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp_ntz, verdict string").withColumns({c: F.lit(1) for c in ("best", "kind", "value", "rank", "action", "_url", "_time", "_best", "at", "salt", "judged", "_judged", "judged_key")})
    log = spark.createDataFrame([*entries, ("host", None, "block", DAY), ("what", "a.com", "block", DAY), ("host", "a.com", "block", None), *entries[:5]], "kind string, value string, action string, listed_on timestamp_ntz")
    want = Counter((i, *direct(url, time, entries)) for i, url, time, _ in rows)
    for limit in (urlfilter.BROADCAST_ROWS, 0):
        got = urlfilter.judge(captures, log, broadcast_rows=limit).collect()
        assert Counter((r.page_id, r.verdict, r.matched_kind, r.matched_value) for r in got) == want
        assert set(got[0].asDict()) == {*captures.columns, "matched_kind", "matched_value", "listed_on"} and {r._url for r in got} == {1}
    assert len({v for _, v, *_ in want}) == 4
    assert urlfilter.judge(captures.where("page_id < 0"), log).count() == 0
    assert {r.verdict for r in urlfilter.judge(captures, log.where("kind = 'none'")).collect()} == {"unlisted", "no_url"}


def test_a_cleared_host_leaves_the_domain_to_decide(spark):
    log = spark.createDataFrame([("domain", "a.example", "block", DAY), ("host", "x.a.example", "allow", DAY), ("host", "x.a.example", "clear", DAY + timedelta(days=5))], "kind string, value string, action string, listed_on timestamp_ntz")
    captures = spark.createDataFrame([("http://x.a.example/", DAY + timedelta(days=d)) for d in (1, 9)] + [("http://[::1]/", DAY)], "url string, fetched_at timestamp_ntz")
    assert sorted((r.fetched_at, r.verdict, r.matched_kind) for r in urlfilter.judge(captures, log).collect()) == sorted(
        [(DAY, "unlisted", None), (DAY + timedelta(days=1), "allowed", "host"), (DAY + timedelta(days=9), "blocked", "domain")]
    )
    assert {r[0] for r in captures.select(urlfilter.host(F.col("url"))).collect()} == {"x.a.example", "[::1]"}


def test_a_prefix_of_a_host_alone_has_all_its_paths(spark):
    log = spark.createDataFrame([("prefix", "a.example", "block", DAY), ("prefix", "B.example//", "block", DAY), ("prefix", "a.example/free", "allow", DAY)], "kind string, value string, action string, listed_on timestamp_ntz")
    urls = {"http://a.example": "blocked", "http://a.example/": "blocked", "https://A.example:8080/x/y?z": "blocked", "http://b.example/q": "blocked", "http://a.example/free/x": "allowed", "http://x.a.example/": "unlisted", "http://a.example.org/": "unlisted"}
    captures = spark.createDataFrame([(u, DAY) for u in urls], "url string, fetched_at timestamp_ntz")
    for limit in (urlfilter.BROADCAST_ROWS, 0):
        assert {r.url: r.verdict for r in urlfilter.judge(captures, log, broadcast_rows=limit).collect()} == urls


def test_hot_pairs_are_joined_back_whole(spark):
    log = spark.createDataFrame([("host", "a.com", "block", DAY)], "kind string, value string, action string, listed_on timestamp_ntz")
    captures = spark.range(20000).select("id", F.lit("http://a.com/").alias("url"), F.lit(DAY).cast("timestamp_ntz").alias("fetched_at"))
    for limit in (urlfilter.BROADCAST_ROWS, 0):
        assert urlfilter.judge(captures, log, broadcast_rows=limit).where("verdict = 'blocked'").count() == 20000
