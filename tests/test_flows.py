"""Both chats with scripted models, prompts' inputs, saved turns, parsing and reading rules, dialect functions, file watching."""

import pytest
from pyspark.sql import functions as F

from heddle.functions import sqlcompat
from heddle.operators import flows
from heddle.sources import files, parse
from heddle.streaming import ingest

HITS = [flows.Hit(1, 0.0, "about cats", "c1", "a.pdf", 2, ("A", "B")), flows.Hit(2, 0.0, "about dogs", "c2")]


class Script:
    def __init__(self, **replies):
        self.replies, self.asked = replies, []

    def __call__(self, task, prompt):
        self.asked.append((task, prompt))
        reply = self.replies[task]
        return reply.pop(0) if isinstance(reply, list) else reply


def kinds(turn):
    return [e["type"] for e in turn.events]


def test_documents_answer_and_citations():
    model = Script(answer="Cats [1], dogs [2], more [7].")
    turn = flows.ask_documents("cats?", lambda q: HITS, lambda q, hits: [0.9, 0.2], model, floor=0.1)
    assert kinds(turn) == ["query", "retrieved", "graded", "done"]
    done = turn.events[-1]
    assert (done["outcome"], done["cited"], done["unknown_citations"], done["rewrites"]) == ("answered", [1, 2], [7], 0)
    assert "[1] (a.pdf, page 2, A > B)\nabout cats" in model.asked[0][1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_documents_rewrite_then_abstain(most):
    searched = []
    model = Script(rewrite=[f"other {i}" for i in range(9)])
    scored = []
    turn = flows.ask_documents("cats?", lambda q: searched.append(q) or HITS, lambda q, hits: scored.extend(hits) or [0.1] * len(hits), model, max_rewrites=most)
    assert len(searched) == most + 1 and len(scored) == 2 and turn.events[-1]["outcome"] == "abstained"
    same = flows.ask_documents("cats?", lambda q: [], lambda q, hits: [], Script(rewrite=" CATS? "), max_rewrites=most)
    assert kinds(same).count("retrieved") == 1 and kinds(same).count("rewrote") == most
    assert flows.summary(turn)["outcome"] == "abstained" and flows.summary(flows.Turn(turn.events[:-1]))["failed"]


def test_condense_only_with_a_history():
    model = Script(condense="cats in Rome?", answer="x")
    turn = flows.ask_documents("and Rome?", lambda q: HITS, lambda q, hits: [1, 1], model, history=[("user", "cats?"), ("assistant", "yes")])
    assert turn.events[0]["text"] == "cats in Rome?" and model.asked[0][0] == "condense"


def test_tables_repair_and_answer(spark):
    tables = {"orders": spark.createDataFrame([(1, 2.5), (2, 3.0)], "id long, total double")}
    model = Script(write_sql="```sql\nselect nope from orders;\n```", repair=["drop table orders", "select count(*) as n from data.orders"], answer="Two.")
    turn = flows.ask_tables(spark, "how many?", tables, model)
    assert kinds(turn) == ["query", "schema", "sql_written", "sql_checked", "sql_written", "sql_checked", "sql_written", "sql_checked", "sql_ran", "done"]
    assert turn.last("sql_ran", "rows") == [(2,)] and flows.good_answer(turn) == ("how many?", "select count(*) as n from data.orders")
    assert "Only a SELECT" in model.asked[2][1] and "nope" in model.asked[1][1]
    assert [e["seq"] for e in flows.replay(turn.events[::-1])] == list(range(10))


def test_tables_give_up(spark):
    tables = {"orders": spark.createDataFrame([(1,)], "id long")}
    stuck = flows.ask_tables(spark, "?", tables, Script(write_sql="select x from y", repair="select x from y"), max_repairs=1)
    assert stuck.last("done", "outcome") == "abstained" and kinds(stuck).count("sql_written") == 2 and flows.good_answer(stuck) is None
    assert flows.ask_tables(spark, "?", tables, Script(write_sql="CANNOT.")).last("done", "outcome") == "abstained"
    assert flows.ask_tables(spark, "?", {}, Script()).last("done", "outcome") == "abstained"
    assert "characters" in flows.ask_tables(spark, "?", tables, Script(), budget=10).last("done", "answer")


def test_reading_of(spark):
    cases = [
        ("a line\nb\n```x", True, False, ["a line", "b"], True),
        ("x" * 30 + "\nb\n" + "x" * 24 + "y", True, False, ["x" * 30, "b"], True),
        ("a\nb\nc\nb\nc", True, False, ["a"], True),
        ("a\n---\nb", True, False, ["a"], True),
        ("}\n}\n", True, True, ["}"], True),
        ("if x:\n  }\nz\n  }\nq", True, True, ["if x:", "}", "z", "}", "q"], False),
        ("a\n中", True, False, ["a"], True),
        ("中\n文", True, False, ["中", "文"], False),
        ("a\nb", False, False, ["a"], False),
        ("a\n\na", True, False, ["a"], True),
    ]
    for lenient in (False, True):
        rows = [c for c in cases if c[2] == lenient]
        frame = spark.createDataFrame([(i, t, c) for i, (t, c, *_) in enumerate(rows)], "i int, text string, complete boolean")
        got = frame.select("i", parse.reading_of(F.col("text"), F.col("complete"), lenient).alias("r")).orderBy("i").collect()
        assert [(r.r.lines, r.r.ended) for r in got] == [(kept, ended) for *_, kept, ended in rows]


def test_parse(spark):
    text = "# Top\n\nOne\ntwo\n\n| a |\n\f## Sub\n\nThree"
    blocks = parse.parse(spark.createDataFrame([("d", bytearray(text.encode()))], "doc_id string, content binary"))
    assert [(r.ord, r.kind, r.level, r.text, r.page) for r in blocks.orderBy("ord").collect()] == [(0, "heading", 1, "Top", 1), (1, "text", None, "One\ntwo", 1), (2, "table", None, "| a |", 1), (3, "heading", 2, "Sub", 2), (4, "text", None, "Three", 2)]
    row = parse.summary(blocks).first()
    assert (row.pages, row.tables, row.text_items, row.text_chars, row.scanned) == (2, 1, 4, 18, True)
    sizes = spark.createDataFrame([([0.0, 0.0, 60.0, 50.0],), ([0.0, 0.0, 60.0, 49.0],)], "b array<double>")
    assert [r[0] for r in sizes.select(parse.keeps_picture(F.col("b"))).collect()] == [True, False]


def test_dialect_functions(spark):
    row = spark.range(1).select(
        sqlcompat.to_char(F.lit("2024-03-05 17:04:09").cast("timestamp_ntz"), "YYYY/MM/DD HH24:MI:SS").alias("a"), sqlcompat.initcap(F.lit("hello big-WORLD o'neil")).alias("b"), sqlcompat.trunc(F.lit(-2.567), 2).alias("c"),
        sqlcompat.regexp_match(F.lit("foo123"), r"([a-z]+)(\d+)", 2).alias("d"), sqlcompat.regexp_match(F.lit("x"), r"\d", 0).alias("e"), sqlcompat.age(F.lit("2024-03-31").cast("date"), F.lit("2024-01-30").cast("date")).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, tuple(row.f)) == ("2024/03/05 17:04:09", "Hello Big-World O'Neil", -2.56, ["foo", "123"], None, (2, 1))


def test_watching_a_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"one%%EOF")
    stream = lambda: ingest.watch_files(spark, f"file://{folder}", "*.pdf")
    out, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    ingest.to_parquet(stream().select("doc_id", "path"), out, checkpoint).awaitTermination()
    (folder / "copy.pdf").write_bytes(b"one%%EOF")
    (folder / "b.pdf").write_bytes(b"two")
    ingest.to_parquet(stream().select("doc_id", "path"), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    scan = files.scan(spark, f"file://{folder}", "*.pdf")
    first = ingest.pending(scan, None, files.is_complete(F.col("content")))
    assert sorted(r.key.rsplit("/")[-1] for r in first.collect()) == ["a.pdf", "copy.pdf"]
    manifest = spark.createDataFrame(first.collect(), first.schema)
    (folder / "b.pdf").write_bytes(b"two%%EOF")
    scan = files.scan(spark, f"file://{folder}", "*.pdf")
    assert [r.key.rsplit("/")[-1] for r in ingest.pending(scan, manifest, files.is_complete(F.col("content"))).collect()] == ["b.pdf"]
