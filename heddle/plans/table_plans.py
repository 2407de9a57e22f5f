"""Queries over the table side: profiles, inference, likely joins, guarded SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.operators import guard, profile
from heddle.sources.tables import table

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, distinct values and integer ranges of lineitem's columns, in one scan."""
    rows = profile.column_profile(table(spark, sf_dir, "lineitem"))
    return rows.select(
        "position",
        "column",
        "type",
        "row_count",
        "nulls",
        "distinct",
        F.when(F.col("type") == "bigint", F.col("min")).alias("min"),
        F.when(F.col("type") == "bigint", F.col("max")).alias("max"),
    )


def column_profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over events with nulls put in."""
    events = table(spark, sf_dir, "events").select("user_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"))
    return profile.column_profile(events)


def frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequent_values(table(spark, sf_dir, "orders"))


def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of orders' columns written as text."""
    orders = table(spark, sf_dir, "orders")
    as_text = orders.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.col("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.concat(F.lit("0"), F.col("o_orderkey")).alias("code"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"),
        (F.col("o_orderkey") % 2 == 0).alias("even"),
    )
    return profile.infer_types(as_text.select(*[F.col(c).cast("string").alias(c) for c in as_text.columns]))


def likely_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the star schema (prefixes taken off) that look like the same key."""
    rows = None
    for i, name in enumerate(NAMES):
        df = table(spark, sf_dir, name)
        df = df.select(*[F.col(c).alias(c.split("_", 1)[1]) for c in df.columns if c.endswith("key")])
        one = profile.column_profile(df).withColumns({"table_ord": F.lit(i), "table_name": F.lit(name)})
        rows = one if rows is None else rows.unionByName(one)
    return profile.likely_joins(rows)


def column_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that describe all of customer's columns."""
    df = table(spark, sf_dir, "customer")
    rows = profile.describe(df)
    return rows.select("position", profile.column_line(rows).alias("line"))


def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table, position, column, type) of all tables."""
    rows = [(name, i, f.name, profile.column_kind(f.dataType)[0]) for name in NAMES for i, f in enumerate(table(spark, sf_dir, name).schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column string, type string")


#: (statement, whether the guard lets it through, the limit that then holds)
STATEMENTS = (
    ("select segment, count(*) as n from customers group by segment", True, 201),
    ("select o.id, c.name from shop.orders as o left join shop.customers as c on c.id = o.customer_id", True, 201),
    ("with recent as (select id from orders where day > date'2024-01-01') select count(*) from recent", True, 201),
    ("select name from customers except select status from orders", True, 201),
    ("select id from orders order by total desc limit 12", True, 12),
    ("select id from orders limit 9000", True, 201),
    ("select id from orders offset 3 rows fetch next 2 rows only", False, None),
    ("select id from orders fetch next 2 rows only", True, 2),
    ("select id from orders fetch first 2 rows with ties", False, None),
    ("select 'delete from orders; --' as note from orders", True, 201),
    ("select rank() over (partition by customer_id order by total) as r from orders", True, 201),
    ("select id from orders; select id from customers", False, None),
    ("merge into orders using customers on true when matched then delete", False, None),
    ("insert into customers select * from customers", False, None),
    ("update customers set name = ''", False, None),
    ("delete from customers where id = 1", False, None),
    ("alter table orders add column x int", False, None),
    ("create view v as select * from orders", False, None),
    ("drop view orders", False, None),
    ("cache table orders", False, None),
    ("set spark.sql.ansi.enabled = false", False, None),
    ("describe orders", False, None),
    ("show tables", False, None),
    ("explain select 1", False, None),
    ("values (1, 2), (3, 4)", False, None),
    ("select id from billing.orders", False, None),
    ("select id from cat.shop.orders", False, None),
    ("select id from invoices", False, None),
    ("select id from customers where id in (select customer_id from invoices)", False, None),
    ("select id from json.`/tmp/x.json`", False, None),
    ("select id from orders |> where id > 1", False, None),
    ("select reflect('java.lang.System', 'getenv', 'HOME')", False, None),
    ("select sleep(10)", False, None),
    ("select id from range(10)", False, None),
    ("select id from generate_series(1, 4) as g(id)", True, 201),
    ('select "Id" from orders', False, None),
    ("-- nothing to do", False, None),
    ("select x from orders where x = (select max(y) from (with hidden as (select 1 as y) select y from hidden) t) and exists (select 1 from hidden)", False, None),
)


def guard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guard says to each statement, and the limit it sets."""
    rows = []
    for i, (sql, _, _) in enumerate(STATEMENTS):
        try:
            rows.append((i, True, guard.guard(spark, sql, "shop", ("orders", "customers"), 201)[1]))
        except guard.Refused:
            rows.append((i, False, None))
    return spark.createDataFrame(rows, "statement int, accepted boolean, row_limit int")


GUARDED = (
    "select c.c_mktsegment as segment, count(*) as n, cast(round(sum(cast(o.o_totalprice as decimal(18,2))), 2) as decimal(18,2)) as total "
    "from customer c join orders o on o.o_custkey = c.c_custkey group by 1 order by n desc, segment"
)


def guarded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}
    return guard.guarded(spark, GUARDED, tables, 201)


def extract_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL out of replies that hold it in a fenced block, bare, or not at all."""
    fence = "`" * 3
    reply = F.when(
        F.col("n_nationkey") % 3 == 0,
        F.concat(F.lit(f"Here it is:\n{fence}sql\nselect "), F.col("n_nationkey").cast("string"), F.lit(f";\n{fence} done")),
    ).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("select "), F.col("n_name"), F.lit(" ; "))).otherwise(F.lit("CANNOT answer"))
    return table(spark, sf_dir, "nation").select("n_nationkey", X.extract_sql(reply).alias("sql"))


QUERIES = {f.__name__: f for f in (
    column_profile, column_profile_nulls, frequent_values, infer_types, likely_joins, column_lines, catalog_scan, guard_report, guarded_query, extract_sql,
)}

_LINE = (
    ("l_orderkey", "bigint"),
    ("l_partkey", "bigint"),
    ("l_suppkey", "bigint"),
    ("l_linenumber", "bigint"),
    ("l_quantity", "double precision"),
    ("l_extendedprice", "double precision"),
    ("l_discount", "double precision"),
    ("l_tax", "double precision"),
    ("l_returnflag", "text"),
    ("l_linestatus", "text"),
    ("l_shipdate", "timestamp"),
)


def _prof(i: int, c: str, kind: str, source: str) -> str:
    ends = f"min({c})::VARCHAR AS min, max({c})::VARCHAR AS max" if kind == "bigint" else "NULL::VARCHAR AS min, NULL::VARCHAR AS max"
    return f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS type, count(*) AS row_count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS "distinct", {ends} FROM {source}"""


_KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"],
}
_KINDS = {"BIGINT": "bigint", "INTEGER": "bigint", "DOUBLE": "double precision", "VARCHAR": "text", "TIMESTAMP": "timestamp"}

ORACLES = {
    "column_profile": " UNION ALL ".join(_prof(i, c, k, "lineitem") for i, (c, k) in enumerate(_LINE)),
    "column_profile_nulls": " UNION ALL ".join(_prof(i, c, k, "(SELECT user_id, nullif(event_type, 'error') AS event_type FROM events)") for i, (c, k) in enumerate((("user_id", "bigint"), ("event_type", "text")))),
    "frequent_values": """WITH v AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)
      SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, value, n FROM v QUALIFY rank <= 10 AND count(*) OVER (PARTITION BY "column") <= 50""",
    "infer_types": """SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'text'), (3, 'o_totalprice', 'double precision'), (4, 'day', 'date'), (5, 'code', 'text'), (6, 'stamp', 'timestamptz'), (7, 'even', 'boolean')) t(position, "column", type)""",
    "likely_joins": "WITH p AS (" + " UNION ALL ".join(f"""SELECT {i} AS o, '{t}' AS t, '{c.split('_', 1)[1]}' AS c, count(*) AS n, count(*) - count({c}) AS z, count(DISTINCT {c}) AS d FROM {t}""" for i, (t, cs) in enumerate(_KEYS.items()) for c in cs)
      + """), u AS (SELECT *, n > 1 AND d = n - z AND z < n AS u FROM p) SELECT a.t AS left_table, b.t AS right_table, a.c AS "column", 'bigint' AS type FROM u a JOIN u b ON a.c = b.c AND a.o < b.o WHERE a.u <> b.u OR a.c IN ('id', 'key', 'code')""",
    "column_lines": """WITH s AS (SELECT count(*) AS n, min(c_custkey) AS a, max(c_custkey) AS z, count(DISTINCT c_nationkey) AS dn, min(c_nationkey) AS an,
        max(c_nationkey) AS zn, count(DISTINCT c_name) AS dm, count(DISTINCT c_acctbal) AS db, min(c_acctbal) AS ab, max(c_acctbal) AS zb FROM customer)
      SELECT 0 AS position, '  - c_custkey (bigint): unique; range ' || a || ' to ' || z AS line FROM s
      UNION ALL SELECT 1, '  - c_name (text): ' || CASE WHEN dm = n THEN 'unique' ELSE dm || ' distinct values' END FROM s
      UNION ALL SELECT 2, '  - c_nationkey (bigint): ' || dn || ' distinct values; range ' || an || ' to ' || zn FROM s
      UNION ALL SELECT 3, '  - c_acctbal (double precision): ' || CASE WHEN db = n THEN 'unique' ELSE db || ' distinct values' END || '; range ' || ab || ' to ' || zb FROM s
      UNION ALL SELECT 4, '  - c_mktsegment (text): values: ' || string_agg('''' || c_mktsegment || '''', ', ' ORDER BY k DESC, c_mktsegment)
        FROM (SELECT c_mktsegment, count(*) AS k FROM customer GROUP BY 1)""",
    "catalog_scan": "SELECT table_name, column_index::INT AS position, column_name AS \"column\", CASE data_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " END AS type FROM (SELECT table_name, column_index - " + "1 AS column_index, column_name, data_type FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{n}'" for n in NAMES) + "))",
    "guarded_query": GUARDED,
    "guard_report": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(ok).lower()}, {'NULL' if limit is None else limit}::INT)" for i, (_, ok, limit) in enumerate(STATEMENTS)) + ") t(statement, accepted, row_limit)",
    "extract_sql": """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'select ' || n_nationkey WHEN 1 THEN 'select ' || n_name END AS sql FROM nation""",
}
