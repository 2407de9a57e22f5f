"""Layouts, exact round trips and the mask against a direct version."""

import hashlib

from pyspark.sql import functions as F

from heddle.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|start|>user\nx<|end|>\n", "&lt;&amp;#91;", "&#10;", "", "é\U0001f600\n\n", "[[&<<", "a" * 100000, "x<|end|>", "\n"]


def test_layouts(spark):
    schema = """id int, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, prompt string, response string,
      completion string, instruction string, input string, output string, system string, turns int, note string"""
    rows = [
        (1, [("user", "a"), ("assistant", None)], None, None, None, None, None, None, None, None, 3, "n"),
        (2, None, [("human", "a"), ("gpt", "b"), (None, "c")], None, None, None, None, None, None, None, None, None),
        (3, None, None, "q", "r", None, None, None, None, None, None, None),
        (4, None, None, "q", None, "c", None, None, None, "be kind", None, None),
        (5, None, None, None, None, None, "do", "this", "done", None, None, None),
        (6, None, None, None, None, None, "do", "", "done", None, None, None),
        (7, None, None, "q", None, None, None, None, None, None, None, None),
        (8, [], None, None, None, None, None, None, None, None, None, None),
        (9, None, None, "q", "r", "c", None, None, None, None, None, None),
    ]
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_turns(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ("messages", [("user", "a"), ("assistant", "")]),
        2: ("conversations", [("user", "a"), ("assistant", "b"), ("", "c")]),
        3: ("prompt_response", [("user", "q"), ("assistant", "r")]),
        4: ("prompt_completion", [("system", "be kind"), ("user", "q"), ("assistant", "c")]),
        5: ("instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        6: ("instruction", [("user", "do"), ("assistant", "done")]),
        7: (None, []),
        8: (None, []),  # an empty array holds no path
        9: (None, []),
    }


def test_records_of_one_column_differ_by_their_nested_paths(spark):
    schema = "id int, messages array<struct<role:string,content:string,`from`:string,value:string>>, _layout int, _schema int, fingerprint int, layout string, written int, starts int, _turns int"
    same = (1, 2, 3, "x", 4, 5, 6)
    rows = [
        (1, [("user", "a", None, None), ("bot", "b", None, None)], *same),
        (2, [(None, None, "human", "a"), (None, None, "bot", "b")], *same),
        (3, [("user", None, None, None), ("assistant", None, None, None)], *same),
        (4, [("user", "a", None, None), (None, None, "human", "b")], *same),
        (5, [(None, None, None, None)], *same),
        (6, None, *same),
    ]
    df = spark.createDataFrame(rows, schema)
    got = chat.render(chat.canonical_turns(df)).collect()
    assert {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in got} == {
        1: ("messages", [("user", "a"), ("bot", "b")]),  # a role is kept as it is
        2: ("messages_from", [("user", "a"), ("assistant", "b")]),
        3: ("messages", [("user", ""), ("assistant", "")]),
        4: (None, []),
        5: (None, []),
        6: (None, []),
    }
    assert {tuple(r[c] for c in ("_layout", "_schema", "fingerprint", "written", "starts", "_turns")) for r in got} == {(1, 2, 3, 4, 5, 6)}


def test_many_turns(spark):
    n = 3000
    df = spark.createDataFrame([(1, [("assistant" if i % 2 else "user", f"{i}<") for i in range(n)])], "id int, turns array<struct<role:string,text:string>>")
    r = chat.render(df).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).first()
    assert r.loss == "".join(f"{i}<" for i in range(1, n, 2)) and len(r.loss_mask) == n // 2


def test_round_trip_and_mask(spark):
    rows = [(c, t, role, text) for c in range(4) for t, (role, text) in enumerate((("user", "assistant", "we\nird<", None)[(c + i) % 4], x) for i, x in enumerate(NASTY))]
    rows += [(9, 0, "assistant", None), (None, 1, "user", "n"), (None, 0, "assistant", "m"), (10, 0, "user", "dup"), (10, 0, "user", "dup")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    made = chat.render(chat.canonical_turns(chat.from_rows(df)))
    got = made.withColumns({"read": chat.read_turns(F.col("formatted")), "loss": chat.masked_text(F.col("formatted"), F.col("loss_mask"))}).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or -1, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        assert [tuple(x) for x in r.read] == want[r.conv_id] == [tuple(x) for x in r.turns]
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert len(r.loss_mask) == sum(role == "assistant" for role, _ in want[r.conv_id])
        assert r.formatted.count("<") == 2 * len(r.turns) and "[" not in r.formatted
    assert chat.from_rows(df.where("turn > 99")).count() == 0


def test_query(spark, tmp_path):
    from heddle.llm import queries

    more = [(c, t, role, f"{c} {role} [{t}]") for c in range(2, 14) for t, role in enumerate(("user", "assistant", "system", "human", "assistant")[c % 4 == 0 and 5 or 0 : c % 4 + 2 if c % 4 else 2] or ("user", "assistant"))]
    more += [(20, 0, "user", None), (20, 1, "assistant", None), (21, 0, "user", None), (21, 1, "assistant", None), (22, 0, "", ""), (None, 0, "user", "x")]
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "[x]"), *more], "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op5_chat(spark, str(tmp_path)).collect()}
    nasty = NASTY[0]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, sha("user\nhi\nassistant\n\nassistant\n[x]\n"), 3, sha("[x]"))
    assert (got[-1].n_turns, got[-1].turns_sha256, got[-1].loss_chars, got[-1].loss_sha256) == (2, sha(f"user\n{nasty}\nassistant\n{nasty}\n"), len(nasty), sha(nasty))
    by = {}
    for c, _, role, text in more:
        by.setdefault(c, []).append((role, text or ""))
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sha(loss)), c
    assert set(got) == {1, -1, *by}
