"""Sketches against exact sets; next and edited texts against a direct version."""

import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from heddle.llm import sketches


def corpus():
    rng = random.Random(2)
    rows = [(i * 3, " ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.choice([0, 1, 4, 5, 60, 900])))) for i in range(60)]
    rows += [(1000, None), (1001, "É è"), (1002, "é  È\n"), (7, rows[5][1]), (7, "dup id"), (None, "null id")]
    return rows


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    tie = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    ordered = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], tie[r[1] or ""]))
    got = sketches.fingerprints(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.setdefault((i, hashlib.sha256(edited.encode()).hexdigest()), []).append((t, edited, after))
    by_text = {}
    for r in got:
        t, edited, after = want[(r.doc_id, r.edited_sha256)][0]
        assert r.n_chars == len(t)
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            exact = len(shingles(t)) < 64 and len(shingles(other)) < 64
            assert abs(near - likeness(t, other)) <= (1e-9 if exact else 0.2)
        assert abs(r.n_distinct - len(shingles(t))) <= 0.35 * len(shingles(t))
        assert 0 <= r.in_next <= 1
    one = sketches.fingerprints(docs.where("doc_id = 1001")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert sketches.fingerprints(docs.where("doc_id < 0")).count() == 0


def chain(words):
    """XXH64 over the words' hashes, one seeding the next, as the SQL function folds its arguments."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), 42)), h)
    return h


def direct_sketch(text, k=128):
    w = re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower())
    w = [x for x in w if x]
    runs = [w[i : i + 5] for i in range(len(w) - 4)] or ([w] if w else [])
    return "".join(f"{h:08x}" for h in sorted({chain(r) >> 32 for r in runs})[:k])


def test_fingerprints_are_the_least_hashes(spark):
    """Strings of own and edited fingerprints against a direct bottom-k, null ids over many ranges among them."""
    rows = corpus() + [(None, f"null id {i} " + "x y z " * (i % 9)) for i in range(80)] + [(None, None)] * 3 + [(5000, "same")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    ordered = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], tie[r[1] or ""]))
    want = []
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i or -1, hashlib.sha256(edited.encode()).hexdigest(), direct_sketch(t), direct_sketch(edited)))
    got = [(r.doc_id or -1, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in sketches.fingerprints(docs).collect()]
    assert sorted(got) == sorted(want)


def test_merge_is_the_sketch_of_the_union(spark):
    df = spark.range(1).select(F.expr("transform(sequence(0, 999), x -> shiftrightunsigned(xxhash64(x), 32))").alias("h"))
    row = df.select(
        sketches.bottom(F.col("h"), 16).alias("whole"),
        sketches.merge(sketches.bottom(F.slice("h", 1, 500), 16), sketches.bottom(F.slice("h", 400, 601), 16), 16).alias("merged"),
    ).first()
    assert row.whole == row.merged and len(row.whole) == 16
    parts = spark.createDataFrame([("x", row.whole[:8]), ("x", row.whole[4:]), ("y", [])], "part string, sketch array<bigint>")
    assert [(r.key, r.sketch) for r in sketches.sketch_all(parts, "part", k=16).collect()] == [("x", row.whole)]
