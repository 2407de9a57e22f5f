"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

from heddle.llm import ranking


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def direct(docs, items, top_k=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, tf, sum(tf.values())) for d, tf in own if tf]
    n, total = len(own), sum(x for _, _, x in own)
    df = Counter(t for _, tf, _ in own for t in tf)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in df}
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, wanted in asked.items():
        scores = []
        for d, tf, length in own:
            m = 100 - 90 + (90 * length * n) // total
            score = sum(weight[t] * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in wanted if t in tf)
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:top_k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, doc_schema="doc_id long, text string", **options):
    found = ranking.search(spark.createDataFrame(docs, doc_schema).repartition(3), spark.createDataFrame(items, "item_id long, text string"), **options)
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def made(seed, n_docs, n_items):
    rng = random.Random(seed)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)] + ["Été", "été", "Word", "WORD", "x9"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(pool) for _ in range(n))
    return [(i, text(rng.randrange(0, 60))) for i in range(n_docs)], [(i, text(rng.randrange(0, 9))) for i in range(n_items)]


def test_random_texts_against_direct(spark):
    docs, items = made(1, 150, 12)
    want = direct(docs, items)
    assert searched(spark, docs, items) == want
    # small windows, and questions in several blocks, change nothing
    assert searched(spark, docs, items, window=7) == want
    assert searched(spark, docs, items, block_terms=10) == want
    assert searched(spark, docs, items, top_k=3) == direct(docs, items, 3)


def test_ties_go_by_id(spark):
    docs = [(i, "same words here") for i in range(50, 0, -1)] + [(99, "other")]
    got = searched(spark, docs, [(1, "words")], window=4)
    assert got == direct(docs, [(1, "words")]) and {r[2] for r in got} == set(range(1, 11))


def test_windows_of_many_postings_end_early(spark, monkeypatch):
    docs, items = made(2, 80, 6)
    monkeypatch.setattr(ranking, "WINDOW_POSTINGS", 20)
    scores = ranking.Scores(ranking.Questions([]), None, 10, 100)
    scores.add(1, 10, Counter(range(25)))
    assert scores.full()
    assert searched(spark, docs, items) == direct(docs, items)


def test_terms_in_everything_weigh_nothing(spark):
    docs = [(i, "the " + "a" * i) for i in range(1, 600)]
    assert searched(spark, docs, [(1, "the")]) == direct(docs, [(1, "the")]) == []


def test_nulls_empty_texts_repeats_clashes_and_empty_tables(spark):
    docs = [(None, "red fox"), (1, None), (2, ""), (3, "..."), (4, "red fox"), (4, "red fox"), (5, "blue"), (6, "green"), (7, "red")]
    items = [(1, "RED, red"), (1, "fox"), (None, "blue"), (None, None), (2, None), (3, "!"), (4, "absent")]
    want = direct(docs, items)
    assert searched(spark, docs, items) == want
    assert searched(spark, [(d, t, 1, "x") for d, t in docs], items, "doc_id long, text string, rank int, item_id string") == want
    assert {r[0] for r in want} == {1, None}
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == []


def test_a_long_text_is_read_piece_by_piece(monkeypatch):
    text = "Alpha betaé gamma-delta 99 " * 40
    whole = [t for p in ranking.terms_of(text) for t in p]
    monkeypatch.setattr(ranking, "PIECE", 9)
    assert [t for p in ranking.terms_of(text) for t in p] == whole == [t.encode() for t in terms(text)]
