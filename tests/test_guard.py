"""The guard's refusals, limits and names, and running under a cap and a time limit."""

import threading
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from decimal import Decimal

import pytest

from heddle.operators import flows, guard
from heddle.plans.table_plans import STATEMENTS


def allowed(spark, sql, schema="shop", tables=("orders", "customers"), rows=201):
    return guard.guard(spark, sql, schema, tables, rows)


@pytest.mark.parametrize(("sql", "accepted", "limit"), STATEMENTS)
def test_statements(spark, sql, accepted, limit):
    if accepted:
        assert allowed(spark, sql)[1] == limit
    else:
        with pytest.raises(guard.Refused):
            allowed(spark, sql)


@pytest.mark.parametrize(
    ("tail", "limit"),
    [("", 201), (" limit 5", 5), (" limit 100000", 201), (" limit all", 201), (" limit 5 offset 10", 5), (" fetch first 5 rows only", 5), (" fetch next 999999 rows only", 201), (" order by total limit 7", 7)],
)
def test_limits(spark, tail, limit):
    assert allowed(spark, f"select * from orders{tail}")[1] == limit


@pytest.mark.parametrize(
    ("sql", "says"),
    [("select 1; select 2", "exactly one"), ("", "no SQL"), (";", "no SQL"), ("select * frm orders where", "could not be parsed"), ("select * from other.orders", "other"), ("select * from secrets", "secrets"), ("select pg_sleep(60)", "pg_sleep"), ("select x.y.f(1)", "not allowed")],
)
def test_messages(spark, sql, says):
    with pytest.raises(guard.Refused, match=says):
        allowed(spark, sql)


@pytest.mark.parametrize(
    "sql",
    ["select * from orders where exists (select 1 from other.x)", "select (select max(a) from secrets) from orders", "select * from orders where id in (select id from secrets)", "select * from orders union all select * from secrets", "with a as (select * from secrets) select * from a",
     "select * from orders o, lateral (select * from secrets) s", "select count(*) filter (where id in (select id from secrets)) from orders", "select * from orders order by (select max(id) from secrets)", "select * from orders where id = any (select id from secrets)",
     "select * from (select * from secrets) s", "select transform(id) using 'cat' as (a) from orders", "select * from orders tablesample (10 percent) join secrets", "select current_user()", "select input_file_name() from orders", "select version()"],
)
def test_nothing_hides_in_a_subquery(spark, sql):
    with pytest.raises(guard.Refused):
        allowed(spark, sql)


def test_comments_go_and_strings_stay(spark):
    assert allowed(spark, "select 1 -- ; drop table orders")[0] == "select 1"
    assert "';drop table orders'" in allowed(spark, "select ';drop table orders' as x from orders")[0]
    assert "`orders`" in allowed(spark, 'select * from "orders"')[0]
    assert allowed(spark, "select * from ORDERS")[1] == 201


def test_guarded_sql_passes_again(spark):
    for sql, accepted, _ in STATEMENTS:
        if accepted:
            text, _ = allowed(spark, sql)
            assert allowed(spark, text)[0] == text


def test_run(spark):
    numbers = spark.range(500).withColumnRenamed("id", "n")
    got = guard.run(spark, "select n from numbers order by n", {"numbers": numbers}, row_limit=10)
    assert got.row_count == 10 and got.truncated and got.rows[0] == (0,) and got.columns == ["n"]
    got = guard.run(spark, "select count(*) as c from shop.numbers", {"numbers": numbers}, schema="shop")
    assert got.rows == [(500,)] and not got.truncated
    with pytest.raises(TimeoutError):
        guard.run(spark, "select count(*) as c from numbers a join numbers b on a.n <> b.n join numbers c on c.n <> a.n join numbers d on d.n <> a.n where sqrt(a.n + b.n + c.n + d.n) < -1", {"numbers": numbers}, timeout_s=1)


def test_only_relations_and_columns_lose_the_schema(spark):
    orders = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    rows = lambda sql: [tuple(r) for r in guard.guarded(spark, sql, {"orders": orders, "customers": orders}, 100, "shop").collect()]
    assert rows("select 'see shop.orders' as note, shop.orders.id from shop.orders where name <> 'shop.b' order by 2") == [("see shop.orders", 1), ("see shop.orders", 2)]
    assert rows("select o.id from shop . orders o join `shop`.customers c on o.id = c.id /* shop.x */ where c.name = 'a'") == [(1,)]
    assert rows("select shop.orders.* from shop.orders where shop.orders.id = 2") == [(2, "b")]
    assert rows('with a as (select id from "shop"."orders") select count(*) from a, shop.customers') == [(4,)]


def test_questions_at_the_same_time_keep_their_tables(spark):
    numbers = {name: spark.createDataFrame([(name,)], "v string") for name in "abcdef"}
    spark.range(3).createOrReplaceTempView("t")
    frames = {name: guard.guarded(spark, "select v from t", {"t": df}, 10) for name, df in numbers.items()}
    with ThreadPoolExecutor(6) as pool:
        results = dict(zip(numbers, pool.map(lambda name: guard.run(spark, "select v from t", {"t": numbers[name]}).rows, numbers), strict=True))
    assert results == {name: [(name,)] for name in numbers} == {name: [tuple(r) for r in f.collect()] for name, f in frames.items()}
    assert spark.table("t").count() == 3  # the session's own view


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("age(date'2001-04-10', date'1957-06-13')", "43 years 9 mons 27 days"), ("age(date'1957-06-13', date'2001-04-10')", "-43 years -9 mons -27 days"), ("age(timestamp'2024-03-01 01:00:00.5', timestamp'2024-02-28 23:30:00')", "1 day 01:30:00.5"),
        ("age(date'2020-01-01', date'2020-01-01')", "00:00:00"), ("justify_interval(interval '35' day)", "1 mon 5 days"), ("justify_interval(interval '395 03:04:05' day to second)", "1 year 1 mon 5 days 03:04:05"),
        ("to_char(timestamp'2024-03-01 13:05:09', 'DD Mon YYYY HH24:MI')", "01 Mar 2024 13:05"), ("cast(to_date('01/03/2024', 'DD/MM/YYYY') as string)", "2024-03-01"), ("array_join(regexp_match('x1 y22', '([a-z])([0-9]+)'), '|')", "x|1"), ("regexp_match('x', '[0-9]')", None), ("to_number('12.5', '99.9')", Decimal("12.5")),
        ("(select string_agg(cast(i as string), ',') within group (order by i) from (select generate_series(2, 9, 3) as i) t)", "2,5,8"), ("(select count(*) from generate_series(5, 1))", 0), ("(select sum(g) from generate_series(5, 1, -2) as s(g))", 9),
    ],
)
def test_functions_of_the_other_dialect(spark, expression, value):
    assert guard.run(spark, f"select {expression} as v", {}).rows == [(value,)]


def test_functions_need_a_plain_form(spark):
    for sql in ("select regexp_match(name, name) from orders", "select heddle_age(1, 2)", "select * from generate_series2(1, 2)", "select generate_series(1) from orders"):
        with pytest.raises(guard.Refused):
            allowed(spark, sql)


def test_admission(spark):
    """No more queries than admitted run at once, the others are refused; a turn ends with its query, also with a failed one."""
    gate = guard.Admission(most=2, pool="readers")
    numbers = {"numbers": spark.range(5)}
    ask = lambda sql="select count(*) as n from numbers": guard.run(spark, sql, numbers, admission=gate).rows
    with gate.turn(spark):
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "readers"
        assert ask() == [(5,)]
        with gate.turn(spark), pytest.raises(guard.Busy, match="2 queries"):
            ask()
    for _ in range(3):
        with pytest.raises(Exception, match="(?i)divi"):
            ask("select 1 / (id - id) as x from numbers")
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None and ask() == [(5,)]
    began, running, most = threading.Barrier(4), [], []

    class Watched(guard.Admission):
        @contextmanager
        def turn(self, session):
            with super().turn(session):
                running.append(1)
                most.append(len(running))
                yield
                running.pop()

    waiting = Watched(most=2, wait_s=60)

    def one(_):
        began.wait()
        return guard.run(spark, "select count(*) as n from numbers", numbers, timeout_s=60, admission=waiting).rows

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(one, range(4))) == [[(5,)]] * 4
    assert max(most) <= 2 and len(most) == 4
    with pytest.raises(ValueError, match="at least one"):
        guard.Admission(most=0)


def test_a_busy_turn_ends(spark):
    """A refused query is not given back to the model."""
    gate, prompts = guard.Admission(most=1), []
    model = lambda kind, prompt: prompts.append(kind) or "select count(*) as n from numbers"
    with gate.turn(spark):
        turn = flows.ask_tables(spark, "How many?", {"numbers": spark.range(5)}, model, admission=gate)
    assert turn.events[-1]["outcome"] == "abstained" and "running already" in turn.events[-1]["answer"] and prompts.count("repair") == 0
