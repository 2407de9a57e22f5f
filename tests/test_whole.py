"""Queries that once took a cut of their rows or texts, on tables where the cut shows.

The SQL is the registered one, which has no cut either; the replacements below hold for any that would.
"""

import hashlib
import re

import pytest

from heddle.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def tokens(text):
    return [t.lower() for t in re.findall(r"\w+", text)]


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables, each as (schema, rows), and gives their folder."""

    def write(**tables):
        for name, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("name", ["rerank", "gate"])
def test_every_benchmark_item_is_reranked(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name].replace(" WHERE item_id < 20", ""))


def test_rerank_and_gate_by_brute_force(spark, folder):
    docs = {1: "red apple pie", 2: "green apple", 3: "blue sky over red hills", 4: "nothing here"}
    items = {0: "red apple", 19: "green pear", 20: "blue red sky", 5000: "apple pie"}
    at = folder(documents=("doc_id long, text string", list(docs.items())), benchmark=("item_id long, text string", list(items.items())))
    share = lambda q, d: round(len(set(tokens(q)) & set(tokens(d))) / len(set(tokens(q))), 6)
    want = {(i, d, share(q, t)) for i, q in items.items() for d, t in docs.items() if set(tokens(q)) & set(tokens(t))}
    rows = QUERIES["rerank"](spark, at).collect()
    assert {(r.query_id, r.doc_id, r.score) for r in rows} == want
    first = {r.query_id: r.score for r in rows if r["rank"] == 1}
    best = {i: max(s for j, _, s in want if j == i) for i in items}
    assert first == best
    assert {(r.query_id, r.best_score, r.enough) for r in QUERIES["gate"](spark, at).collect()} == {(i, s, s >= 0.9) for i, s in best.items()}


@pytest.mark.parametrize("name", ["section_headings", "chunk_sections", "paragraph_at", "picture_headings"])
def test_lines_are_whole(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name].replace("substr(text, 1, 60) AS text", "text"))


def test_hybrid_chunks_hold_every_word(spark, folder):
    lines = ["Head", *(" ".join(f"w{n}x{i}" for i in range(n)) for n in (30, 30, 20, 90))]
    at = folder(documents=("doc_id long, text string", [(7, "\n".join(lines))]))
    rows = sorted(QUERIES["chunk_hybrid"](spark, at).collect(), key=lambda r: r.piece)
    assert [r.token_count for r in rows] == [60, 20, 90]
    whole = [f"{t}\n" for t in ("\n".join(lines[1:3]), lines[3], lines[4])]
    assert [r.text_id for r in rows] == [hashlib.sha256(t.encode()).hexdigest()[:16] for t in whole]


def test_examples_with_one_opening_are_different(spark, folder):
    turns = [(3, 0, "user", "please count the orders"), (3, 1, "user", "please count the suppliers"), (6, 0, "user", "please count the orders")]
    at = folder(conversations=("conv_id long, turn long, role string, text string", turns))
    rows = QUERIES["example_save"](spark, at).collect()
    assert sorted((r.standalone, r.turn_id) for r in rows) == [("please count the orders", 3000), ("please count the suppliers", 3001)]


def test_every_example_is_saved(same_rows):
    same_rows(QUERIES["example_save"], ORACLES["example_save"].replace("substr(text, 1, 6) AS standalone", "text AS standalone"))


def test_citations_late_in_an_answer_are_found(spark, folder):
    late = "x" * 60 + " as shown [4] and [12]."
    at = folder(conversations=("conv_id long, turn long, role string, text string", [(2, 1, "assistant", late), (2, 0, "user", "why [8]")]))
    (row,) = QUERIES["citations"](spark, at).collect()
    assert (row.cited, row.known, row.unknown) == ("2,4,12", "2,4", "12")


def test_registry_compares_every_row(spark, folder):
    at = folder(documents=("doc_id long, text string", [(i, "t") for i in (1, 2, 3, 5, 10)]), labels=("doc_id long, quality int", [(3, 1), (4, 0), (9, 1), (10, 0)]))
    assert {(r.doc_id, r.change) for r in QUERIES["registry_sync"](spark, at).collect()} == {(4, "removed"), (9, "removed"), (1, "new"), (2, "new"), (5, "new")}
    rows = {(r.doc_id, r.quality, r.has_row, r.points, r.has_collection) for r in QUERIES["library_rollup"](spark, at).collect()}
    alone = {(i, None, False, 1, True) for i in (1, 2, 5)} | {(4, 0, True, None, False), (9, 1, True, None, False)}
    assert rows == alone | {(3, 1, True, 1, True), (10, 0, True, 1, True)}


@pytest.mark.parametrize("name", ["registry_sync", "library_rollup"])
def test_registry_equals_sql_over_whole_tables(name, same_rows):
    same_rows(QUERIES[name], re.sub(r" WHERE doc_id % \d (<> 0|= 0)", "", ORACLES[name]))
