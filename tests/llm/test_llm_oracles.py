"""The training-data queries that SQL can express, against DuckDB on the smallest tables, and the shape of all."""

import duckdb
import pytest

from heddle.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_urlfilter": {"page_id", "url", "verdict"},
    "op2_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op3_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op4_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5_chat": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op6_quality": {"doc_id", "held_out", "score", "predicted"},
    "op7_langid": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op9_decontamination": {"doc_id", "item_id", "containment"},
    "op10_simhash": {"doc_id", "fingerprint", "component_id"},
    "op11_licenses": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op12_variants": {"word", "form", "root", "n", "n_near", "form_n"},
    "op13_ranking": {"item_id", "rank", "doc_id", "score"},
}


def test_every_operator_has_its_query():
    assert set(queries.queries()) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    frame = queries.queries()[name](spark, DATA)
    assert sorted(frame.columns) == sorted(want.columns) and set(frame.columns) >= COLUMNS[name]
    got = sorted(map(str, (tuple(r) for r in frame.select(*want.columns).collect())))
    assert got == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(queries.oracle_sql())))
def test_query_has_a_row_for_each_document(spark, name):
    frame = queries.queries()[name](spark, DATA)
    assert set(frame.columns) >= COLUMNS[name]
    assert sorted(r.doc_id for r in frame.select("doc_id").collect()) == list(range(200))
