"""Containment against brute force over exact shingles, and odd rows."""

import math
import random
import re

from pyspark.sql import functions as F

from heddle.llm import decontam


def brute(docs, items, threshold=0.8):
    def split(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    out = {}
    for item, text in items:
        w = split(text)
        k = min(5, len(w))
        if not k or item is None:
            continue
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for doc, t in docs:
            d = split(t)
            share = len(own & {tuple(d[i : i + k]) for i in range(len(d) - k + 1)}) / len(own)
            if share >= threshold and doc is not None:
                out[doc, item] = max(share, out.get((doc, item), 0))
    return out


def test_find_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(30))
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 7, 12, 30, 60])))) for i in range(25)]
    items += [(100, "Rare!"), (101, "two Words"), (102, ""), (103, None), (None, "x y z"), (5, items[3][1]), (104, "h1 " * 30)]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.choice([0, 3, 50, 800, 5000]))]
        for _ in range(rng.choice([0, 1, 3])):
            _, text = rng.choice(items)
            part = (text or "").split()
            if part and rng.random() < 0.4:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", ",", "..", "\n"]) for x in part]
        docs.append((i, " ".join(w)))
    docs += [(3, items[0][1]), (200, None), (201, ""), (202, "rare"), (203, "!!"), (None, items[0][1]), (204, items[6][1])]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, piece string, k int")
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h int")
    want = brute(docs, items)
    # a repeated doc_id is one document: its rows' shingles together
    merged = {}
    for i, t in docs:
        merged.setdefault(i, []).append(t)
    assert len(want) > 60
    for rows in (1_000_000, 0):
        got = {(r.doc_id, r.item_id): r.containment for r in decontam.find(df, table, broadcast_rows=rows).collect()}
        assert {k: round(v, 9) for k, v in got.items() if k[0] != 3} == {k: round(v, 9) for k, v in want.items() if k[0] != 3}
        assert {k for k in want if k[0] == 3} <= set(got)
    assert decontam.find(df.where("doc_id < 0"), table).count() == 0
    assert decontam.find(df, table.where("item_id < 0")).count() == 0


def test_sketches_demand_what_containment_leaves(spark):
    """Whatever a document lacks, it has ``needed`` of the sketch; ``needed`` is a good half of it."""
    sizes = spark.range(1, 3000).select(F.col("id").cast("int").alias("n"))
    rows = sizes.select("n", decontam.lost_of(F.col("n")).alias("lost"), decontam.sketch_length(F.col("n")).alias("length"), decontam.partition_of(F.col("n")).alias("part")).collect()
    for r in rows:
        assert r.lost == r.n - max(1, math.ceil(round(0.8 * r.n, 9))) and r.part // 2 < r.n <= r.part
        assert 0 < r.length - r.lost <= r.n - r.lost and (r.length - r.lost) * 2 > r.length and r.length <= max(1, 0.42 * r.part + 1)
    assert all(len({r.length for r in rows if r.part == p and r.length < r.n}) <= 1 for p in {r.part for r in rows})


def test_documents_that_quote_items_in_pieces_are_found(spark):
    """Edits up to the bound, two halves apart, and every run of five words alone with other words between."""
    rng = random.Random(9)
    word = lambda: f"{rng.choice('abcdefghij')}{rng.randrange(300)}"
    items = [(i, [word() for _ in range(n)]) for i, n in enumerate([13, 14, 16, 17, 20, 24, 28, 34, 44, 70, 120] * 8)] + [(900, ["a1", "b2"]), (901, [word() for _ in range(6)])]
    docs = []
    for i, (_, w) in enumerate(items):
        w = list(w)
        size, lost = max(1, len(w) - 4), 0
        while i % 2 and size - lost - 5 >= 0.8 * size:  # as many words changed, put in or left out as containment allows
            at, lost = rng.randrange(len(w)), lost + 5
            w[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
        if i % 2 == 0 and size > 2:  # overlapping fragments in any order, some left out
            runs = [w[j : j + 5] for j in range(size)]
            rng.shuffle(runs)
            w = [x for run in runs[: math.ceil(0.8 * size)] for x in [*run, word()]]
        elif len(w) > 40 and i % 3 == 0:
            cut = rng.randrange(10, len(w) - 10)
            w = w[cut:] + [word() for _ in range(50)] + w[:cut]
        before = [word() for _ in range(rng.choice([5, 300, 3000]))]
        docs.append((i, " ".join([*before, *w, word(), word()])))
    want = brute(docs, [(i, " ".join(w)) for i, w in items])
    found = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == set(want)
    assert len(want) > 60 and sum((i, i) in want for i in range(0, 88, 2)) == 44


def test_items_of_a_word_or_two_drop_nothing_unless_asked(spark):
    docs = spark.createDataFrame([(1, "the rare word is here"), (2, "one two three four five six"), (None, "one two three four five")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "rare"), (2, "One, two three four five!")], "item_id long, text string")
    assert sorted((r.doc_id or 0) for r in decontam.drop_contaminated(docs, items).collect()) == [0, 1]
    assert [r.doc_id for r in decontam.drop_contaminated(docs, items, shortest=1).collect()] == [None]
