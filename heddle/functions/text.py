"""Text expressions: tokens, whitespace, identities, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
NOT_IN_SOURCE = r"(?i)\b(do|does|did) not (contain|mention|provide|include|cover|address)\b"
CITED = r"\[(\d+)\]"
FENCED_SQL = r"(?is)```(?:sql)?\s*(.*?)```"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def squash(text: Column) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_id(content: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit(":"), F.lpad(index.cast("string"), 5, "0"))


def term_index(term: Column) -> Column:
    """The unsigned CRC-32 of the UTF-8 term: its place in a sparse vector."""
    return F.crc32(term.cast("binary"))


def contains_any(text: Column, snippets: Column) -> Column:
    """Whether the text has one of the snippets, whitespace aside."""
    return F.exists(snippets, lambda s: F.contains(squash(text), squash(s)))


def has_facts(facts: Column, answer: Column) -> Column:
    """Whether the answer has every fact, case aside; true for none."""
    return F.forall(facts, lambda f: F.contains(F.lower(answer), F.lower(f)))


def says_not_in_source(answer: Column) -> Column:
    return answer.rlike(NOT_IN_SOURCE)


def citations(answer: Column) -> Column:
    """The distinct numbers cited as ``[n]``, ascending."""
    return F.array_sort(
        F.array_distinct(
            F.transform(F.regexp_extract_all(answer, F.lit(CITED), F.lit(1)), lambda n: F.try_element_at(F.array(n.try_cast("int")), F.lit(1)))
        )
    )


def known_citations(cited: Column, passages: Column) -> Column:
    return F.filter(cited, lambda n: (n >= 1) & (n <= passages))


def unknown_citations(cited: Column, passages: Column) -> Column:
    return F.filter(cited, lambda n: (n < 1) | (n > passages))


def is_new_query(query: Column, tried: Column) -> Column:
    """A query that is not blank and not one of those tried, case and whitespace aside."""
    low = F.lower(squash(query))
    return (low != "") & ~F.exists(tried, lambda t: F.lower(squash(t)) == low)


def extract_sql(reply: Column) -> Column:
    """The SQL of a model's reply: the first fenced block, if there is one, or all of it, without final semicolons; null for CANNOT and where nothing is left."""
    sql = F.trim(F.when(reply.rlike(FENCED_SQL), F.regexp_extract(reply, FENCED_SQL, 1)).otherwise(reply))
    sql = F.trim(F.regexp_replace(sql, r"[;\s]+$", ""))
    return F.when((sql != "") & ~F.upper(sql).startswith("CANNOT"), sql)


def quote_identifier(name: Column) -> Column:
    return F.when(name.rlike("^[a-z_][a-z0-9_]*$"), name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def sample_value(value: Column, limit: int = 40) -> Column:
    """An example value between single quotes, at most ``limit`` characters."""
    text = squash(value.cast("string"))
    text = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def cell(value: Column, limit: int = 200) -> Column:
    text = F.coalesce(value.cast("string"), F.lit("NULL"))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def passage(number: Column, file: Column, page: Column, headings: Column) -> Column:
    """``[n] (file, page p, a > b)``; what is missing is left out."""
    where = F.concat_ws(", ", file, F.concat(F.lit("page "), page.cast("string")), F.when(F.size(headings) > 0, F.array_join(headings, " > ")))
    return F.concat(F.lit("["), number.cast("string"), F.lit("]"), F.when(where != "", F.concat(F.lit(" ("), where, F.lit(")"))).otherwise(F.lit("")))


def headings_in_order(paths: Column) -> Column:
    """Heading paths as ``a > b``, each once, in the order in which they first stand; empty ones left out."""
    return F.array_distinct(F.filter(F.transform(paths, lambda p: F.array_join(p, " > ")), lambda t: t != ""))
