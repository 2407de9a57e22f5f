"""Chunking against direct versions: packing, offsets, tables, meaning and the whole of a document."""

import random
import re

import pytest
from pyspark.sql import functions as F

from heddle.functions.arrays import running
from heddle.operators import chunking as C
from heddle.operators import models

BLOCKS = "doc_id int, ord int, kind string, level int, text string"


def direct_pack(pieces, budget):
    out, n = [], 0
    for piece in pieces:
        size = len(piece.split())
        if out and (n + size <= budget or n == 0):
            out[-1] += piece
            n += size
        else:
            out.append(piece)
            n = size
    return [t for t in (x.strip(" ") for x in out) if t.strip()]


def direct_sentences(text):
    pieces = [p for p in re.sub(r"((?<=[.!?])\s+|\n{2,})", "\\1\x01", text).split("\x01") if p]
    out = []
    for piece in pieces:
        if out and (not piece.strip() or not out[-1].strip()):
            out[-1] += piece
        else:
            out.append(piece)
    return out


def corpus():
    rng = random.Random(3)
    words = ["word ", "another ", "end. ", "stop!  ", "\n\n", "x" * 9 + " ", "\n\n \n\n", "? "]
    return ["".join(rng.choice(words) for _ in range(rng.randrange(1, 150))) for _ in range(40)] + ["", " \n\n ", "one", "w " * 500, "a. " * 300]


def test_sentences_and_recursive_equal_direct_versions(spark):
    df = spark.createDataFrame(list(enumerate(corpus())), "doc_id int, text string")
    for r in df.select("text", C.sentences(F.col("text")).alias("s")).collect():
        assert r.s == direct_sentences(r.text)
    for r in C.recursive(df, 12).collect():
        parts = []
        for s in direct_sentences(r.text):
            w = s.split()
            parts += [" ".join(w[i : i + 12]) + " " for i in range(0, len(w), 12)] if len(w) > 12 else [s]
        assert r.pieces == direct_pack(parts, 12)


def test_merge_peers_equals_a_direct_version(spark):
    rng = random.Random(5)
    rows = [(d, i, "heading" if rng.random() < 0.1 else "text", 1, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([1, 3, 8, 30])))) for d in range(6) for i in range(40)]
    segmented = C.segment(spark.createDataFrame(rows, BLOCKS))
    by = {}
    for r in segmented.orderBy("doc_id", "ord").collect():
        if r.kind == "text":
            by.setdefault((r.doc_id, r.section), []).append(r.text + "\n")
    got = {}
    for r in C.merge_peers(segmented, 16).orderBy("piece").collect():
        got.setdefault((r.doc_id, r.section), []).append((r.text, r.token_count))
    assert got == {k: [(t, len(t.split())) for t in direct_pack(v, 16)] for k, v in by.items()}


def test_tables(spark):
    rows = [[str(i), "a b" if i % 2 else "", "x|y\nz" if i == 3 else None] for i in range(7)] + [["big"] * 3, [" ".join("w" * 30), "", ""]]
    df = spark.createDataFrame([(1, 4, ["Top", "Sub"], ["n", "name", "more"], rows), (2, 0, [], ["n"], [])], "doc_id int, ord int, headings array<string>, header array<string>, rows array<array<string>>")
    got = [r.text for r in C.table_chunks(df, 24).orderBy("piece").collect()]
    head = "| n | name | more |\n| --- | --- | --- |\n"
    assert all(t.startswith(head) for t in got)
    line = lambda r: "| " + " | ".join(re.sub(r"\s+", " ", c or "").strip().replace("|", "\\|") for c in r) + " |\n"
    assert [t.removeprefix(head) for t in got] == direct_pack([line(r) for r in rows], 22)
    assert len(got[-1].split()) > 24  # a row beyond the budget stays whole
    lines = [r.text for r in C.table_chunks(df, 24, "rows").orderBy("piece").collect()]
    assert "".join(lines).replace("\n", ";").startswith("n: 0;n: 1; name: a b;")
    assert C.table_chunks(df, 24, "skip").count() == 0
    with pytest.raises(ValueError):
        C.table_chunks(df, 24, "pictures")
    budgets = spark.createDataFrame([(5,), (100,)], "n int").select(C.table_budget(64, F.col("n")).alias("b"))
    assert sorted(r.b for r in budgets.collect()) == [32, 59]


def test_offsets_are_safe_with_overlap_and_repeats(spark):
    text = "ab ab ab. ab ab"
    cases = [(text, ["ab ab", "ab ab. ab", "ab ab"], [0, 3, 10]), (text, ["ab", "ab", "ab", "ab"], [0, 3, 6, 10]), (text, ["ab", "zz", "ab ab"], [0, 0, 3]), ("", [], [])]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, text string, p array<string>")
    got = {r.i: r.at for r in df.select("i", C.locate_pieces(F.col("text"), F.col("p")).alias("at")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_running_sums(spark):
    sizes = [[random.Random(i).randrange(9) for _ in range(n)] for i, n in enumerate((0, 1, 255, 256, 257, 1000))]
    df = spark.createDataFrame([(s,) for s in sizes], "s array<int>")
    for r in df.select("s", running(F.col("s")).alias("r")).collect():
        assert r.r == [sum(r.s[:i]) for i in range(len(r.s))]


def test_semantic_cuts_where_the_subject_turns(spark):
    text = "".join(f"Cats purr and cats nap {i}. " for i in range(8)) + "".join(f"Rates rise when banks lend {i}. " for i in range(8))
    parts = spark.createDataFrame([(1, 0, text), (2, 0, "One only."), (3, 0, "")], "doc_id int, section int, text string")
    rows = C.semantic(parts, lambda df: models.embed(df, models.HashingEmbedder(64), "context"), 40, 0.9, 1).orderBy("doc_id", "piece").collect()
    assert "".join(r.text.replace(" ", "") for r in rows if r.doc_id == 1) == text.replace(" ", "")
    assert all(r.token_count <= 40 for r in rows) and [r.piece for r in rows if r.doc_id == 1] == list(range(len(rows) - 1))
    mixed = [r.text for r in rows if "Cats" in r.text and "Rates" in r.text]
    assert len(mixed) <= 1  # a cut falls at the turn or one sentence beside it
    assert [r.text for r in rows if r.doc_id == 2] == ["One only."]
    groups = C.sentence_groups(parts.where("doc_id = 1"), 2).orderBy("ord").collect()
    assert all(r.context == "".join(g.sentence for g in groups[max(0, i - 2) : i + 3]) for i, r in enumerate(groups))


def document(spark):
    rows = [
        (1, 0, "title", None, "T"), (1, 1, "text", None, "intro one two"), (1, 2, "heading", 1, "A"), (1, 3, "text", None, "alpha beta. gamma delta."), (1, 4, "picture", None, "a cat"), (1, 5, "table", None, "t"),
        (1, 6, "text", None, "after the table"), (1, 7, "heading", 2, "B"), (1, 8, "text", None, "deep"), (2, 0, "heading", 1, "only a heading"),
    ]
    return spark.createDataFrame(rows, BLOCKS)


@pytest.mark.parametrize("strategy", ["fixed", "recursive", "semantic", "hybrid", "hierarchical"])
def test_a_whole_document_in_its_order(spark, strategy):
    blocks = document(spark)
    segmented = C.segment(blocks)
    tables = spark.createDataFrame([(1, 5, ["T", "A"], ["n"], [["1"], ["2"]])], "doc_id int, ord int, headings array<string>, header array<string>, rows array<array<string>>")
    rows, warnings = C.chunk(segmented, strategy, 50, embed=lambda df: models.embed(df, models.HashingEmbedder(16), "context"), tables=tables, pictures=C.picture_chunks(blocks.withColumn("page", F.lit(1))))
    got = rows.orderBy("doc_id", "chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and {r.doc_id for r in got} == {1} and not warnings
    assert [r.chunk_id for r in got] == [f"1:{i:05d}" for i in range(len(got))]
    kinds = [r.modality for r in got]
    assert kinds.count("table") == kinds.count("picture") == 1
    words = " ".join(r.text for r in got if r.modality == "text").split()
    assert sorted(words) == sorted("intro one two alpha beta. gamma delta. after the table deep".split())
    assert got[0].embed_text == "T\n" + got[0].text and got[-1].embed_text == "T\nA\nB\n" + got[-1].text
    table = next(r for r in got if r.modality == "table")
    assert table.text.startswith("| n |\n| --- |\n| 1 |") and table.headings == ["T", "A"]
    if strategy == "hierarchical":
        assert [r.text.split()[0] for r in got] == ["intro", "alpha", "a", "|", "after", "deep"]
    assert [r.doc_id for r in C.without_chunks(blocks, rows).collect()] == [2]


def test_strategies_warn_and_refuse(spark):
    segmented = C.segment(document(spark))
    assert C.chunk(segmented, "recursive", 50, overlap=5)[1] == ["The overlap of 5 is not used by the strategy recursive."]
    assert len(C.chunk(segmented, "hybrid", 50, handling="rows")[1]) == 1
    for strategy, embed in (("unheard", None), ("semantic", None)):
        with pytest.raises(ValueError):
            C.chunk(segmented, strategy, embed=embed)
    with pytest.raises(ValueError):
        C.chunk(segmented, "fixed", 5, overlap=5)
