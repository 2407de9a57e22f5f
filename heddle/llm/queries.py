"""The queries over the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import chat, decontam, langid, licenses, oracles, pii, quality, ranking, sentencepiece, sharding, simhash, sketches, urlfilter, variants
from heddle.llm.common import table


def _remainder(n: int):
    """crc32 of the doc_id as text, modulo n: the fixed folds."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


#: A dated list for the query: (kind, value, action, day).
LIST = (
    ("domain", "spam-farm.example.org", "block", "2024-02-01"),
    ("domain", "cheap-pills.example.com", "block", "2024-01-10"),
    ("domain", "cheap-pills.example.com", "clear", "2024-06-01"),
    ("domain", "cheap-pills.example.com", "block", "2024-09-15"),
    ("domain", "example.net", "block", "2024-03-01"),
    ("domain", "example.net", "clear", "2024-05-01"),
    ("host", "tionsh.example.net", "allow", "2024-04-01"),
    ("host", "tionsh.example.net", "clear", "2024-10-01"),
    ("prefix", "tionsh.example.net/en", "block", "2024-11-01"),
    ("prefix", "tionsh.example.net/fr", "block", "2024-01-01"),
    ("prefix", "blog.tionble.example.com/en", "block", "2024-07-01"),
    ("host", "blog.tionble.example.com", "allow", "2024-07-01"),
    ("domain", "tiontion.example.com", "block", "2024-08-01"),
    ("domain", "tiontion.example.com", "allow", "2024-08-01"),
    ("prefix", "blog.ththan.example.net", "block", "2024-05-01"),
    ("host", "blog.ththan.example.net", "allow", "2024-02-01"),
)


def op1_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on all pages. The table has no fetch times: page_id days (of a year) after 1 January 2024 stand in."""
    day = F.expr("timestampadd(DAY, page_id % 366, TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_at"))
    values = ", ".join(f"('{k}', '{v}', '{a}', TIMESTAMP_NTZ '{d} 00:00:00')" for k, v, a, d in LIST)
    entries = spark.sql(f"SELECT * FROM VALUES {values} AS t(kind, value, action, listed_on)")
    return urlfilter.judge(captures, entries)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketches of all documents and of their edited texts."""
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to."""
    import public_tokenizers

    return sentencepiece.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _several_layouts(records: DataFrame) -> DataFrame:
    """(conv_id, turns) records in different layouts: one question and its answer as prompt and response, others as an array whose elements say role and content or from and value."""
    kind, turn = F.pmod("conv_id", F.lit(3)), F.col("turns")
    role = lambda i: F.get(turn, F.lit(i))["role"]
    text = lambda i: F.get(turn, F.lit(i))["text"]
    plain = F.forall(turn, lambda t: t["role"].isin("user", "assistant"))
    asked = (kind == 0) & (F.size(turn) == 2) & (role(0) == "user") & (role(1) == "assistant")
    spoken = (kind == 1) & plain
    speaker = lambda r: F.when(r == "user", "human").otherwise("gpt")
    message = lambda t, own: F.struct(F.when(~own, t["role"]).alias("role"), F.when(~own, t["text"]).alias("content"), F.when(own, speaker(t["role"])).alias("from"), F.when(own, t["text"]).alias("value"))
    return records.select(
        "conv_id",
        F.when(asked, text(0)).alias("prompt"),
        F.when(asked, text(1)).alias("response"),
        F.when((kind == 2) | spoken, F.transform(turn, lambda t: message(t, spoken))).alias("messages"),
        F.when((kind != 2) & ~asked & ~spoken | kind.isNull(), turn).alias("turns"),
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back.

    The table has one layout, so its records are first written in several, by conv_id.
    """
    columns = ("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(odd).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select(*columns).unionByName(more)
    made = chat.render(chat.canonical_turns(_several_layouts(chat.from_rows(rows))))
    read = made.withColumns({"read": chat.read_turns(F.col("formatted")), "loss": chat.masked_text(F.col("formatted"), F.col("loss_mask"))})
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; the model learns from labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(_remainder(4) != 2))
    return quality.classify(docs, model).withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; the models learn from documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_remainder(5) != 0))
    found = langid.identify(docs, model).withColumn("held_out", F.coalesce(_remainder(5) == 0, F.lit(False)))
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of all documents."""
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents contain which benchmark items."""
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by SimHash."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detections in all documents."""
    return licenses.digest(licenses.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents and what each is a spelling variant of."""
    return variants.group(table(spark, sf_dir, "documents"))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (
            op1_urlfilter,
            op2_pii,
            op3_fingerprints,
            op4_sentencepiece,
            op5_chat,
            op6_quality,
            op7_langid,
            op8_sharding,
            op9_decontamination,
            op10_simhash,
            op11_licenses,
            op12_variants,
            op13_ranking,
        )
    }


#: Exact containment of every item in every document, by distinct five-word shingles.
OP9_SQL = r"""
WITH toks AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark
), sh AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: list_slice(w, i, i + 4))) AS piece FROM toks WHERE len(w) >= 5
), n AS (SELECT id AS item_id, count(*) AS n_shingles FROM sh WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n.n_shingles, count(*) AS n_shared, count(*) / n.n_shingles AS containment
FROM sh d JOIN sh i ON d.side = 'd' AND i.side = 'i' AND d.piece = i.piece JOIN n ON n.item_id = i.id
GROUP BY d.id, i.id, n.n_shingles HAVING count(*) / n.n_shingles >= 0.8
"""


OP1_SQL = (
    "WITH log(kind, value, action, listed_on) AS (VALUES "
    + ", ".join(f"('{k}', '{v}', '{a}', TIMESTAMP '{d}')" for k, v, a, d in LIST)
    + r"""), p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id % 366)::INT) AS fetched_at,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages
), past AS (  -- all entries up to the fetch, of every target that the page falls under
  SELECT p.page_id, l.kind, l.value, l.action, l.listed_on
  FROM p JOIN log l ON l.listed_on <= p.fetched_at AND CASE l.kind
    WHEN 'host' THEN p.host = l.value WHEN 'domain' THEN p.host = l.value OR ends_with(p.host, '.' || l.value)
    ELSE p.host || p.path = l.value OR starts_with(p.host || p.path, l.value || '/') END
), newest AS (  -- what each target says at the fetch: its last day's strictest entry
  SELECT page_id, kind, value, max(listed_on) AS listed_on,
    arg_max(action, (listed_on, CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END)) AS action
  FROM past GROUP BY page_id, kind, value
), hit AS (  -- targets off the list say nothing; the most specific of the others decides
  SELECT page_id, kind, value, action, listed_on,
    row_number() OVER (PARTITION BY page_id ORDER BY CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(value) DESC) AS n
  FROM newest WHERE action <> 'clear'
)
SELECT p.page_id, p.url, p.fetched_at, CASE WHEN p.host = '' THEN 'no_url' WHEN h.action = 'block' THEN 'blocked' WHEN h.action = 'allow' THEN 'allowed' ELSE 'unlisted' END AS verdict,
  h.kind AS matched_kind, h.value AS matched_value, h.listed_on
FROM p LEFT JOIN hit h ON h.page_id = p.page_id AND h.n = 1
"""
)

OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + length('<|start|>') + 1 + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_urlfilter": OP1_SQL,
        "op3_fingerprints": oracles.sketches(),
        "op5_chat": OP5_SQL,
        "op8_sharding": oracles.sharding(),
        "op9_decontamination": OP9_SQL,
        "op10_simhash": oracles.simhash(),
        "op11_licenses": oracles.licenses(),
        "op12_variants": oracles.variants(),
        "op13_ranking": oracles.ranking(),
    }
