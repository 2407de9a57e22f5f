"""License scans: base phrases, detections and their suppression against direct versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from heddle.llm import licenses
from heddle.llm.licenses import Rule

RULES = licenses.rules()


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def direct(text, rules=RULES, base=licenses.BASE):
    """(n_words, base places, detections that none suppresses) by comparing all of them."""
    w = words(text)
    places = [(i, i + len(p.split()), label) for p, label in base for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places.sort(key=lambda b: (b[0], -b[1]))
    line, found = f" {' '.join(w)} ", []
    for rule, r in enumerate(rules):
        if r.keyword in w:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
                start = line[: m.start()].count(" ") - 1
                found.append((start, start + m.group().count(" ") + 1, r.label, r.priority, rule))
    ahead = lambda d: (d[3], d[0] - d[1], d[4])
    kept = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and ahead(e) < ahead(d) for e in found)]
    return len(w), places, sorted(kept, key=lambda d: (d[0], -d[1], d[3], d[4]))


def scanned(spark, texts, **options):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r.n_words, [tuple(b) for b in r.base], [tuple(d) for d in r.found]) for r in licenses.find(rows, **options).orderBy("doc_id").collect()]


TEXTS = [
    None,
    "",
    " .,;\n\t",
    "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License. All rights reserved. ALL RIGHTS RESERVED",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "cc by cc by CC-BY: cc_by ccby",
    "écc by cc byé cc by cc by",  # letters beyond ASCII belong to a word, as the no-break space does
    "bacK cc by mit license İ mit licenKe",
    "SPDX-License-Identifier: GPL-2.0-or-later // and MIT License, gpl version 2 or any later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "the GNU Affero General Public License v3 and the GNU Lesser General Public License version 2.1 or the general public license",
    "an MIT paper says that public roads lead to apache country",
    "mit license " * 700 + "all rights reserved " * 300,
]


def test_texts_against_direct(spark):
    assert scanned(spark, TEXTS) == [direct(t) for t in TEXTS]


def test_every_rule_text_is_found(spark):
    """A text made from each rule: its keyword is in it and its label found or suppressed by a detection around it."""
    plain = []
    for r in RULES:
        p = re.sub(r"\(\?:[^()]*\)\?", "", re.sub(r"\(\?:[^()]*\)\?", "", r.pattern))
        p = re.sub(r"\(\?:([^()|]*)\|?[^()]*\)", r"\1", p)
        p = p.replace("(?:[^ ]+ ){1,12}?", "x ")
        p = re.sub(r"\[(.)[^\]]*\]", r"\1", p).replace("?", "")
        p = p if re.fullmatch(r.pattern, p) else None
        plain.append(p)
    assert sum(p is not None for p in plain) > 0.8 * len(plain)
    for r, p in zip(RULES, plain, strict=True):
        assert p is None or r.keyword in p.split(), (r, p)
    texts = [p for p in plain if p is not None]
    got = scanned(spark, texts)
    assert got == [direct(t) for t in texts] and all(found for _, _, found in got)


def test_suppression_in_linear_time_equals_comparing_all(spark):
    rng = random.Random(1)
    rules = [Rule(f"l{i}", "a", " ".join(rng.choice(["a", "b", "[^ ]+"]) for _ in range(rng.randrange(1, 5))), rng.randrange(4)) for i in range(24)]
    texts = [" ".join(rng.choice("aabc") for _ in range(n)) for n in (1, 2, 3, 10, 40, 150, 400)]
    assert scanned(spark, texts, own=rules) == [direct(t, rules) for t in texts]


def test_overlapping_places_of_a_phrase(spark):
    texts = ["a b a b a b a", "a", "b a b"]
    base = (("a b a", "x"), ("a", "y"))
    assert scanned(spark, texts, own=RULES[:1], base=base) == [direct(t, RULES[:1], base) for t in texts]


def test_clean_prose_has_no_detection(spark):
    rng = random.Random(2)
    prose = [" ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(300)) for _ in range(20)]
    assert all(found == [] and base == [] for _, base, found in scanned(spark, prose))


def test_clashing_names_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "mit license", 5, "x"), (1, "mit license", 5, "x"), (None, None, None, None)], "doc_id long, text string, n_words int, _license_line string")
    got = licenses.find(rows)
    assert got.columns == ["doc_id", "text", "_license_line", "n_words", "base", "found"]
    assert sorted(map(str, licenses.digest(got).collect())) == sorted(map(str, licenses.digest(licenses.find(rows)).collect()))
    assert [(r.n_words, r["_license_line"]) for r in got.orderBy(F.col("doc_id").asc_nulls_last()).collect()] == [(2, "x"), (2, "x"), (0, None)]
    assert licenses.digest(licenses.find(rows.where("false"))).count() == 0


@pytest.mark.parametrize(("text", "labels", "score"), [("All rights reserved.", "reserved", 0.4), ("MIT License", "mit", 0.7), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0", 0.9), ("nothing", "", 0.0)])
def test_digest(spark, text, labels, score):
    (row,) = licenses.digest(licenses.find(spark.createDataFrame([(7, text)], "doc_id long, text string"))).collect()
    assert (row.labels, row.score) == (labels, score)


def test_no_shuffle_and_no_python(spark):
    plan = licenses.find(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
