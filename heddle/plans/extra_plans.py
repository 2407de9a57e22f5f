"""Queries over dialect functions, parsing, examples and settings kept as variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import sqlcompat as S
from heddle.functions import text as X
from heddle.operators import examples, models
from heddle.sources import parse
from heddle.sources.tables import table


def compat_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        S.to_char(d, "YYYY-MM-DD HH24:MI:SS").alias("stamp"),
        S.to_char(d, "DD/MM/YY").alias("short"),
        S.age(d.cast("date"), F.to_date(F.lit("1990-06-15")))["months"].alias("months"),
    )


def compat_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        S.initcap(F.concat(F.col("p_type"), F.lit("-x1 y"))).alias("title"),
        S.regexp_replace_first(F.col("p_type"), "[AEIOU]", "*").alias("first"),
        F.element_at(S.regexp_match(F.col("p_name"), r"(\w)\w*$", 1), 1).alias("letter"),
    )


def compat_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        S.trunc(F.col("s_acctbal")).alias("whole"),
        S.justify_days(F.col("s_suppkey"))["days"].alias("days"),
    )


def compat_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select("r_regionkey", S.generate_series(F.col("r_regionkey").cast("long"), F.lit(9).cast("long"), F.lit(4).cast("long")).alias("i"))


def parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents parsed as plain text and what the parse amounts to; tests hold it against a direct version."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("content"))
    return parse.summary(parse.parse(files))


def example_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers of conversations kept once each, the first turn's."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(
        (F.col("conv_id") % 3).cast("string").alias("schema_name"),
        F.col("text").alias("question"),
        F.col("text").alias("standalone"),
        F.col("role").alias("sql"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"),
    )
    return examples.save(None, rows).select("schema_name", "standalone", "sql", "turn_id")


def example_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items most like the first one, by hashed vectors."""
    embedder = models.HashingEmbedder(64)
    rows = table(spark, sf_dir, "benchmark").select(
        F.lit("shop").alias("schema_name"),
        F.col("text").alias("standalone"),
        F.col("item_id").alias("turn_id"),
    )
    indexed = examples.index(rows, embedder)
    asked = F.array(*[F.lit(float(x)) for x in embedder.embed([rows.where("turn_id = 0").first()["standalone"]])[0]])
    return examples.retrieve(indexed, asked, "shop", embedder.label, 3, 0.1).withColumn("score", F.round("score", 4))


def variant_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the shape of their properties, read as variants."""
    v = F.try_parse_json("props")
    rows = table(spark, sf_dir, "events").select("event_id", F.schema_of_variant(v).alias("shape"))
    return rows.groupBy("shape").agg(F.count("*").alias("n"))


def sparse_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as (index, weight) vectors: CRC-32 places, colliding terms summed."""
    from heddle.operators.lexical import bm25_weights

    w = bm25_weights(table(spark, sf_dir, "benchmark"), "item_id")
    return w.groupBy("item_id", X.term_index(F.col("term")).alias("place")).agg(F.round(F.sum("weight"), 6).alias("weight"))


QUERIES = {f.__name__: f for f in (
    compat_dates, compat_strings, compat_numbers, compat_series, parse_summary, example_save, example_search, variant_shapes, sparse_vector,
)}

ORACLES = {
    "compat_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(o_orderdate, '%d/%m/%y') AS short, datesub('month', DATE '1990-06-15', o_orderdate::DATE)::INT AS months FROM orders",
    "compat_numbers": "SELECT s_suppkey, trunc(s_acctbal) AS whole, (s_suppkey % 30)::INT AS days FROM supplier",
    "compat_series": "SELECT r_regionkey, unnest(generate_series(r_regionkey::BIGINT, 9, 4)) AS i FROM region",
    "compat_strings": """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_type || '-x1 y', '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title,
      regexp_replace(p_type, '[AEIOU]', '*') AS first, regexp_extract(p_name, '(\\w)\\w*$', 1) AS letter FROM part""",
    "example_save": "SELECT (conv_id % 3)::VARCHAR AS schema_name, text AS standalone, role AS sql, min(conv_id * 1000 + turn) AS turn_id FROM conversations GROUP BY ALL",
    "parse_summary": r"""WITH pg AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS page, generate_subscripts(string_split(text, chr(12)), 1) AS n FROM documents),
      part AS (SELECT doc_id, n, regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '') AS p FROM (SELECT doc_id, n, unnest(regexp_split_to_array(page, '\n\s*\n')) AS p FROM pg)),
      b AS (SELECT doc_id, n, CASE WHEN regexp_matches(p, '^#{1,6}\s+') THEN 'heading' WHEN starts_with(p, '|') THEN 'table' ELSE 'text' END AS kind, CASE WHEN regexp_matches(p, '^#{1,6}\s+') THEN trim(regexp_extract(p, '^#{1,6}\s+(.*)', 1)) ELSE p END AS t FROM part WHERE p <> ''),
      m AS (SELECT doc_id::VARCHAR AS doc_id, count(DISTINCT n) AS pages, count(*) FILTER (kind = 'table') AS tables, coalesce(sum(CASE WHEN kind = 'table' THEN list_sum(list_transform(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_full_match(x, '[|\s:-]+')), lambda x: len(string_split(regexp_replace(trim(x), '^\||\|$', '', 'g'), '|')))) END), 0)::BIGINT AS table_cells,
        count(*) FILTER (kind <> 'table') AS text_items, coalesce(sum(length(t)) FILTER (kind <> 'table'), 0)::BIGINT AS text_chars FROM b GROUP BY doc_id)
      SELECT *, round(text_chars / pages, 1) AS chars_per_page, round(text_chars / pages, 1) < 50 AS scanned FROM m""",
    "sparse_vector": r"""WITH tok AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM benchmark), a AS (SELECT avg(len(t)) AS m FROM tok),
      tf AS (SELECT item_id, any_value(len(t)) AS n, term, count(*) AS tf FROM (SELECT item_id, t, unnest(t) AS term FROM tok) GROUP BY item_id, term),
      c AS (SELECT term, xor(4294967295, list_reduce(list_transform(range(strlen(term)), lambda i: ('0x' || substr(hex(term), 2 * i + 1, 2))::BIGINT), lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT)) AS place FROM (SELECT DISTINCT term FROM tf))
      SELECT item_id, place, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m))), 6) AS weight FROM tf JOIN c USING (term), a GROUP BY item_id, place""",
    "variant_shapes": """SELECT CASE json_structure(props)::VARCHAR WHEN '{"k":"UBIGINT"}' THEN 'OBJECT<k: BIGINT>' ELSE json_structure(props)::VARCHAR END AS shape, count(*) AS n FROM events GROUP BY 1""",
}
