"""Records, removals, names, runs, events and checks by small cases."""

import json
import math
import time
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heddle import session
from heddle.functions import sqlcompat
from heddle.functions import text as X
from heddle.operators import bookkeeping as B
from heddle.operators import flows, models, profile, search, service
from heddle.operators.lexical import sparse_search, sparse_search_batch
from heddle.sources import parse, settings, store
from heddle.streaming import ingest


def test_names(spark):
    good = ["shop", "_x", "a1", "x" * 63]
    bad = ["Shop", "1a", "a b", "", "x" * 64, "public", "pg_x", "information_schema", "é"]
    assert all(B.name_problem(n) is None for n in good) and all(B.name_problem(n) for n in bad)
    got = spark.createDataFrame([(n,) for n in good + bad], "n string").select(B.name_ok(F.col("n"))).collect()
    assert [r[0] for r in got] == [True] * len(good) + [False] * len(bad)


def test_schemas_and_tables_go_unless_registered(spark):
    name = f"heddle_test_{uuid.uuid4().hex[:8]}"
    with pytest.raises(B.RecordError, match="registered"):
        B.create_schema(spark, name, {name})
    with pytest.raises(B.RecordError, match="plain"):
        B.create_schema(spark, "no good")
    B.create_schema(spark, name)
    spark.sql(f"CREATE TABLE {name}.t USING parquet AS SELECT 1 AS a")
    assert not B.drop_table(spark, name, "t", {name}) and spark.catalog.tableExists(f"{name}.t")
    assert B.drop_table(spark, name, "t") and not spark.catalog.tableExists(f"{name}.t") and B.drop_table(spark, name, "t")
    assert not B.drop_schema(spark, name, {name}) and spark.catalog.databaseExists(name)
    assert B.drop_schema(spark, name) and not spark.catalog.databaseExists(name) and B.drop_schema(spark, name)


def test_experiments_keep_their_settings(spark):
    schema = "config_hash string, name string, config string, created_at int"
    there = spark.createDataFrame([("h1", "a", "{}", 1)], schema)
    rows = B.upsert_experiment(there, spark.createDataFrame([("h1", "a", "{}", 5), ("h2", "b", "{}", 5)], schema))
    assert {(r.config_hash, r.created_at) for r in rows.collect()} == {("h1", 1), ("h2", 5)}
    with pytest.raises(B.RecordError, match="a"):
        B.upsert_experiment(there, spark.createDataFrame([("h3", "a", "{}", 5)], schema))


def test_logs(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert B.read_log(spark, path, B.METRIC).count() == 0
    done = spark.createDataFrame([("c", "d", "parse", 500.0, 3), ("c", "d", "chunk", 0.0, 3)], "config_hash string, doc_id string, stage string, duration_ms double, items long")
    B.append(B.stage_metrics(done), path, B.METRIC)
    B.append(B.stage_metrics(done.where("stage = 'parse'").withColumn("items", F.lit(9))), path, B.METRIC)
    rows = B.read_log(spark, path, B.METRIC)
    assert rows.count() == 3 and rows.where("created_at IS NULL").count() == 0
    assert {(r.stage, r["items"], r.per_second) for r in B.latest_metrics(rows).collect()} == {("parse", 9, 18.0), ("chunk", 3, None)}
    for bad in (done.withColumn("stage", F.lit("cook")), done.withColumn("more", F.lit(1))):
        with pytest.raises(B.RecordError):
            B.append(bad, path, B.METRIC)
    B.append(spark.createDataFrame([("c", "why", 5)], "config_hash string, query string, top_k int"), f"{path}2", B.SEARCH)
    assert B.read_log(spark, f"{path}2", B.SEARCH).first().total_ms is None


def test_chats(spark):
    day = datetime(2024, 1, 1)
    rows = [("s1", "documents", 0, "first " * 30, day), ("s1", "documents", 1, "more", day + timedelta(days=9)), ("s2", "documents", 0, "hi", day + timedelta(days=5)), ("s3", "database", 0, "x", day), ("s3", "documents", 0, "x", day)]
    turns = spark.createDataFrame(rows, "session_id string, kind string, turn long, question string, created_at timestamp")
    recent = B.recent_chats(turns.where("session_id <> 's3'"), 2).collect()
    assert [(r.session_id, r.turns, r.updated_at) for r in recent] == [("s1", 2, day + timedelta(days=9)), ("s2", 1, day + timedelta(days=5))] and recent[0].title == ("first " * 30)[:80]
    assert [r.question for r in B.chat_turns(turns, "s1").collect()][1] == "more"
    assert B.without_chat(turns, "s1").count() == 3 and B.without_chat(turns, "none").count() == 5
    assert {tuple(r) for r in B.chat_problems(turns).collect()} == {("s3", "two kinds"), ("s3", "repeated turn")}
    assert B.chat_problems(turns.where("session_id <> 's3'")).count() == 0


def test_good_answers_are_what_ran_last(spark):
    steps = {1: "query sql_written sql_checked sql_written sql_ran answered", 2: "sql_written sql_ran abstained answered", 3: "sql_written sql_ran error", 4: "sql_written answered", 5: "sql_written sql_ran sql_written answered", 6: "sql_ran answered"}
    rows = [(t, i, k, f"{t}.{i}") for t, s in steps.items() for i, k in enumerate(s.split())]
    got = {tuple(r) for r in B.good_answers(spark.createDataFrame(rows, "turn int, seq int, kind string, value string")).collect()}
    assert got == {(1, "1.3"), (5, "5.0")}
    examples = spark.createDataFrame([("a", 1), ("b", 2)], "standalone string, turn_id int")
    assert [r.turn_id for r in B.unmark(examples, 1).collect()] == [2] and B.unmark(examples, 9).count() == 2


def test_removals_can_be_repeated(spark, tmp_path):
    done = []
    file = tmp_path / "d.md"
    for _ in range(2):
        file.write_text("x")
        B.delete_document("d", lambda d: done.append(("points", d)), [f"file://{file}"], lambda d: done.append(("rows", d, file.exists())), spark)
    B.delete_document("d", lambda d: None, [f"file://{file}"], lambda d: None, spark)
    assert done == [("points", "d"), ("rows", "d", False)] * 2
    path = f"file://{tmp_path}/points"
    points = spark.createDataFrame([("e", "d1", [1.0, 2.0]), ("e", "d2", [1.0, 2.0]), ("f", "d1", [3.0, 4.0])], "experiment string, doc_id string, embedding array<double>")
    store.write_documents(points, path)
    B.drop_partition(spark, path, experiment="e", doc_id="d1")
    left = spark.read.parquet(path)
    assert {(r.experiment, r.doc_id) for r in left.collect()} == {("e", "d2"), ("f", "d1")}
    assert B.count_document(left, "d1") == 1 and B.has_document(left, "d2") and not B.has_document(left, "d9")
    assert tuple(store.stats(left).first()) == (2, 2)
    B.drop_partition(spark, path, experiment="f")
    B.drop_partition(spark, path, experiment="f")
    assert spark.read.parquet(path).count() == 1


def test_points(spark):
    points = spark.createDataFrame([("d1", "b.pdf"), ("d1", "b.pdf"), ("d2", "a.pdf"), ("d3", None)], "doc_id string, source_file string")
    assert [tuple(r) for r in B.facet(points).collect()] == [("d3", 1, None), ("d2", 1, "a.pdf"), ("d1", 2, "b.pdf")]
    with pytest.raises(B.RecordError, match="3"):
        B.facet(points, limit=2)
    space = str(uuid.uuid4())
    got = points.select(B.point_id(F.col("doc_id"), space).alias("p"), "doc_id").collect()
    assert all(r.p == str(uuid.uuid5(uuid.UUID(space), r.doc_id)) for r in got)
    shop = spark.createDataFrame([("a", '{"index": {"sparse": true}}'), ("b", "{"), ("c", None), ("d", '{"index": {"sparse": true}}')], "name string, config string")
    assert [r.name for r in B.targets(shop, spark.createDataFrame([("a",), ("b",), ("c",)], "name string")).collect()] == ["a"]
    assert B.where_given(points).count() == 4 and B.where_given(points, doc_id="d1", source_file=None).count() == 2


def test_hybrid_search_needs_texts(spark):
    chunks = spark.createDataFrame([("c1", [1.0, 0.0], "red apple"), ("c2", [0.0, 1.0], "green pear"), ("c3", [0.9, 0.1], None)], "chunk_id string, embedding array<double>, text string")
    query = F.array(F.lit(1.0), F.lit(0.0))
    got = search.hybrid_search(chunks, query, ["pear"], 3, 1).collect()
    assert {r.chunk_id for r in got} == {"c1", "c2", "c3"} and search.branch_limit(1, 3) == 3 and search.branch_limit(20, 3) == 20
    with pytest.raises(ValueError, match="text"):
        search.hybrid_search(chunks.drop("text"), query, ["pear"], 3)


def test_batch_search_by_few_postings_is_exact(spark):
    """Bars from one posting up to all of them, ties and questions of common words among them, against one search each."""
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(300)] + [(900, None), (901, "")], "doc_id int, text string").repartition(5)
    asked = [(i, " ".join(rng.choices(words, weights if i % 2 else None, k=rng.randrange(1, 9)))) for i in range(12)] + [(50, "w0"), (51, "w0 w1 w2"), (52, "unknown"), (53, "w59 w0"), (54, None)]
    questions = spark.createDataFrame(asked, "query_id int, question string")
    want = {}
    for i, q in asked:
        want[i] = [(r["rank"], r.doc_id, round(r.score, 9)) for r in sparse_search(docs, (q or "").split(), 5).collect()]
    for seeds, rows in ((1, 1_000_000), (30, 0), (10_000, 1_000_000)):
        got = {i: [] for i, _ in asked}
        for r in sparse_search_batch(docs, questions, 5, seeds=seeds, broadcast_rows=rows).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r["rank"], r.doc_id, round(r.score, 9)))
        assert got == {i: sorted(v) for i, v in want.items()}
    assert sparse_search_batch(docs.where("doc_id < 0"), questions, 5).count() == 0 and sparse_search_batch(docs, questions.where("query_id < 0"), 5).count() == 0


def test_profiles_of_odd_columns(spark):
    df = spark.createDataFrame([({"k": 1}, "a.b", None, [1]), ({"k": 2}, None, None, [1])], "m map<string,int>, `odd name` string, n int, l array<int>")
    rows = {r["column"]: (r["type"], r.nulls, r["distinct"], r["min"]) for r in profile.column_profile(df).collect()}
    assert rows["m"][2] is None and rows["odd name"] == ("text", 1, 1, None) and rows["n"] == ("bigint", 2, 0, None) and rows["l"][2] == 1


def test_events_are_records(spark):
    events = [service.Query(0, "q"), service.Token(1, "x"), service.SqlRan(2, ("a",), ((1, None), (2, "é")), 2, True), service.Done(3, "answered", "ok", (1,))]
    records = [service.to_record(e) for e in events]
    assert records[2] == {"type": "sql_ran", "seq": 2, "columns": ["a"], "rows": [[1, None], [2, "é"]], "row_count": 2, "truncated": True}
    assert [service.from_record(json.loads(json.dumps(r))) for r in records] == events
    rows = service.event_rows(spark, {"t1": records[::-1], "t2": records[:1]})
    assert service.replayed(rows, "t1") == [e for e in events if not isinstance(e, service.Token)] and rows.count() == 4
    shown = list(service.server_events(records[:2]))
    assert shown[0] == 'event: query\nid: 0\ndata: {"seq": 0, "text": "q"}\n\n' and len(shown) == 2
    with pytest.raises(service.ServiceError):
        service.from_record({"type": "nothing"})


def test_health_and_setup(spark, tmp_path):
    checks = {"folder": lambda: service.can_write(spark, f"file://{tmp_path}"), "missing": lambda: False, "broken": lambda: 1 / 0, "none": lambda: None}
    assert service.problems(checks) == ["missing: not available", "broken: division by zero"] and not list(tmp_path.iterdir())
    with pytest.raises(service.ServiceError, match="(?s)missing.*broken"):
        service.check_setup(checks)
    assert {(r.name, r.ok) for r in service.health(spark, checks).collect()} == {("folder", True), ("missing", False), ("broken", False), ("none", True)}


def test_paths_stay_in_their_folder(tmp_path):
    assert service.artifact_path(str(tmp_path), "exp", "p-1.png") == (tmp_path / "exp" / "p-1.png").resolve()
    (tmp_path / "out").symlink_to("/etc")
    for parts in (("..", "x"), ("a/b",), ("",), ("/etc",), (".hidden",), ("a..b",), ("out", "passwd")):
        with pytest.raises(service.ServiceError):
            service.artifact_path(str(tmp_path), *parts)


def test_one_run_at_a_time_and_migrations(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    with service.RunLock(spark, folder), pytest.raises(service.ServiceError, match="Another run"), service.RunLock(spark, folder):
        pass
    with service.RunLock(spark, folder):
        pass
    ran = []
    step = lambda n: lambda s, f: ran.append(n)
    assert service.migrate(spark, folder, {2: step(2), 1: step(1)}) == [1, 2] and service.migrate(spark, folder, {1: step(1), 2: step(2)}) == []
    with pytest.raises(ZeroDivisionError):
        service.migrate(spark, folder, {1: step(1), 2: step(2), 3: lambda s, f: 1 / 0, 4: step(4)})
    assert service.migrate(spark, folder, {1: step(1), 2: step(2), 3: step(3)}) == [3] and ran == [1, 2, 3]
    with pytest.raises(service.ServiceError, match="Step 0"):
        service.migrate(spark, folder, {0: step(0)})


def test_evaluation_files(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('{"id": "a", "question": "q", "expect": "answer", "facts": ["x"], "source": {"file": "f.pdf", "snippets": ["s"]}}\n{"id": "b", "question": "r", "expect": "abstain"}\n')
    cases = service.read_cases(spark, f"file://{path}")
    assert cases.count() == 2 and cases.where("id = 'a'").first().source.snippets == ["s"]
    service.write_results(cases.select("id"), f"file://{tmp_path}/results")
    assert spark.read.json(f"file://{tmp_path}/results").count() == 2
    for bad in ('{"id": "a", "expect": "answer"}\n{"id": "a", "expect": "answer"}', '{"id": "a", "expect": "maybe"}', '{"expect": "answer"}'):
        path.write_text(bad)
        with pytest.raises(service.ServiceError):
            service.read_cases(spark, f"file://{path}")


def test_models(spark):
    assert models.size_label("qwen3-embedding:4b") == "4b" and models.size_label("other:1b") == "other:1b"
    assert models.size_problem("embeddinggemma-2", 100) and not models.size_problem("embeddinggemma-2", 256) and not models.size_problem("x", 100)
    one = spark.range(1).select(models.template(F.lit("cat"), "embeddinggemma-2", True).alias("q"), models.template(F.lit("cat"), "unknown", False).alias("d")).first()
    assert tuple(one) == ("task: search result | query: cat", "cat")
    calls = []

    class Flaky(models.OverlapReranker):
        def score(self, pairs):
            calls.append(len(pairs))
            return super().score(pairs)

    pairs = spark.createDataFrame([("red apple", "an apple"), (None, "x"), ("a", None), ("b", "B b")], "question string, text string")
    assert [r.score for r in models.rerank(pairs.coalesce(1), Flaky()).collect()] == [0.5, None, None, 1.0]
    label = spark.createDataFrame([("m|64",), ("m",)], "l string").select(*service.model_label(F.col("l"))).collect()
    assert [tuple(r) for r in label] == [("m", 64), ("m", None)]


def test_settings_go_together():
    make = lambda **e: settings.completed(settings.Settings(embedding=settings.Embedding(**e)))
    assert make(model="embeddinggemma-2").embedding.query.startswith("task:") and make(query="Q {text}").embedding.query == "Q {text}"
    for bad in ({"model": "embeddinggemma-2", "size": 100}, {"model": "qwen3-embedding:1b", "pictures": True}, {"query": "no place"}):
        with pytest.raises(settings.SettingsError):
            make(**bad)
    with pytest.raises(settings.SettingsError, match="overlap"):
        settings.completed(settings.Settings(chunking=settings.Chunking(max_tokens=5, overlap=5)))


def slow(content):
    time.sleep(5)
    return []


def test_parsing_takes_its_time(spark):
    files = spark.createDataFrame([("a", bytearray(b"# Top\nx\n\nbody\n\n| a | b |\n| --- | --- |\n| 1 |  |\fnext"))], "doc_id string, content binary")
    rows = parse.parse(files).collect()
    assert [(r.kind, r.page) for r in rows] == [("heading", 1), ("text", 1), ("table", 1), ("text", 2)]
    met = parse.summary(parse.parse(files)).first()
    assert (met.pages, met.tables, met.table_cells, met.text_items, met.scanned) == (2, 1, 4, 3, True)
    assert parse.timeout_s(10) == 600 and parse.timeout_s(100) == 2000 and parse.page_count(b"a\fb\fc") == 3 and parse.page_count(b"/Type /Page\n/Type/Pages /Type/Page") == 2
    with pytest.raises(parse.ParseTimeout):
        parse.in_time(slow, b"", 0.05)


def test_text_of_answers(spark):
    df = spark.createDataFrame([("The Cat sat on 12 mats.", ["cat", "12 MATS"]), ("The text does not mention it", ["it", "cat"]), ("x", [])], "a string, f array<string>")
    assert [r[0] for r in df.select(X.has_facts(F.col("f"), F.col("a"))).collect()] == [True, False, True]
    assert [r[0] for r in df.select(X.says_not_in_source(F.col("a"))).collect()] == [False, True, False]
    assert [r[0] for r in spark.createDataFrame([(None,), ("y" * 300,), ("z",)], "v string").select(X.cell(F.col("v"))).collect()] == ["NULL", "y" * 199 + "…", "z"]
    assert flows.remembered("Two.", "select 2") == "Two.\n(SQL: select 2)" and flows.remembered("Two.", "") == "Two."
    odd = spark.createDataFrame([("1.5",), ("NaN",), ("Infinity",), ("2024-01-01",), (None,)], "v string").select(sqlcompat.as_json(F.col("v"))).collect()
    assert [r[0] for r in odd] == ["1.5", "NaN", "Infinity", "2024-01-01", None]
    assert math.isclose(len(flows.extract_sql("```sql\nselect 1;\n```")), 8) and flows.extract_sql("cannot say") == "CANNOT"


def test_shared_folders_are_shared(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Fake:
        sparkContext = Cluster()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="share"):
        session.shared_dir(Fake())
    with pytest.raises(RuntimeError):
        ingest.fresh(Fake())
    assert session.shared_dir(spark) == session.shared_dir(spark)
    stored = session.Stored(spark.range(3))
    with session.Scope() as scope:
        other = session.Stored(spark.range(4))
    assert stored.df.count() == 3 and scope.made == [other]
    stored.drop()


def test_contents_once_within_a_time(spark, tmp_path):
    rows = [(i, f"t{i % 3}", datetime(2024, 1, 1) + timedelta(days=i)) for i in range(9)]
    spark.createDataFrame(rows, "i int, text string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "d"))
    stream = ingest.once_by_content(ingest.read_stream(spark, str(tmp_path / "d")), time_col="ts", within="30 days")
    assert sorted(r.text for r in ingest.run(spark, stream).collect()) == ["t0", "t1", "t2"]
